"""WARC not-modified revisits: each takes the latest earlier full response of its canonical URL.

All records are dealt by range of (canonical URL, time, kind, id) and sorted, so a URL with a third of all
records is spread over many parts, and so are records of one instant. A part carries the last response it
has seen forward to its revisits; what it needs from the parts before it is their last response alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import cut_lineage

# header fields of a 304 answer that may replace stored ones (RFC 9110 section 15.4.5, RFC 9111 section 3.2)
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# query parameters that name no other page
TRACKING = "^(utm_[a-z]+|gclid|fbclid|msclkid|ref)(=|$)"
HEADERS = T.MapType(T.StringType(), T.StringType())


def canonical_url(url: Column) -> Column:
    """Scheme, user, `www.`, default port, fragment and tracking parameters dropped, host lower-cased, parameters sorted, trailing slashes removed. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, url, ts, status, response_id, payload_digest, payload_length, headers) for each revisit.

    records: record_id, url, ts (long), type (`response` with a full payload, or `revisit`), headers (map of
    lower-case names), payload_digest, payload_length. Strictly earlier responses count; of several at one
    instant that with the largest record_id does, and of several of that id the one with the largest headers (as JSON),
    digest and length. Other columns are not read, whatever their names. status: `resolved` if the entity tags agree (compared
    weakly) or, without a pair of tags, the modification dates do; `mismatch` if they differ; `unverified`
    if no pair can be compared; `orphan` if no earlier response exists or url or ts is null. Headers are
    those stored with the permitted ones of the revisit laid over them; a mismatch and an orphan keep only
    their own and take no payload. Repeated rows each get a row; an empty table gives none.
    """
    rows = records.where(F.col("type").isin("response", "revisit")).select(
        canonical_url(F.col("url").cast("string")).alias("url"),
        F.col("ts").cast("long").alias("ts"),
        F.when(F.col("type") == "revisit", 0).otherwise(1).alias("kind"),  # a revisit does not see a response of its own instant
        F.col("record_id").cast("long").alias("record_id"),
        F.to_json(F.coalesce("headers", F.create_map().cast(HEADERS))).alias("headers"),
        F.col("payload_digest").cast("string").alias("payload_digest"),
        F.col("payload_length").cast("long").alias("payload_length"),
    )
    found = rows.where((F.col("kind") == 0) | (F.col("url").isNotNull() & F.col("ts").isNotNull()))
    order = ["url", "ts", "kind", "record_id", "headers", "payload_digest", "payload_length", "_tie"]
    dealt = found.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.drop("_tie").withColumn("_part", F.spark_partition_id()))
    response = F.struct("url", "ts", "record_id", "headers", "payload_digest", "payload_length")
    tails = {r["_part"]: r["tail"] for r in dealt.where("kind = 1").groupBy("_part").agg(F.max(response).alias("tail")).collect()}  # one a part
    carried, last = {}, None
    for part in range(max([*tails, -1]) + 2):
        carried[part] = None if last is None else last.asDict()
        last = tails.get(part, last)
    beyond = carried[max(carried)]
    sent = dealt.sparkSession.sparkContext.broadcast((carried, beyond))
    names = ["url", "ts", "kind", "record_id", "headers", "payload_digest", "payload_length"]
    out_schema = "record_id long, url string, ts long, own string, response_id long, stored string, payload_digest string, payload_length long"

    def carry(batches):
        carried, beyond = sent.value
        part, before = None, None
        for b in batches:
            if not b.num_rows:
                continue
            if b.column(7)[0].as_py() != part:
                part = b.column(7)[0].as_py()
                row = carried.get(part, beyond)
                before = None if row is None else pa.RecordBatch.from_pylist([{**{k: row.get(k) for k in names}, "kind": 1, "_part": part}], schema=b.schema)
            if before is not None:
                b = pa.Table.from_batches([before, b]).combine_chunks().to_batches()[0]
            kind = b.column(2).to_numpy(zero_copy_only=False)
            n = len(kind)
            last = np.maximum.accumulate(np.where(kind == 1, np.arange(n), -1))
            revisit = np.flatnonzero(kind == 0)
            at = last[revisit]
            url = b.column(0)
            known = pa.array(at, mask=at < 0)
            theirs, own = url.take(known).to_pylist(), url.take(pa.array(revisit)).to_pylist()
            own_ts = b.column(1).take(pa.array(revisit))
            same = np.array([x is not None and x == y and t is not None for x, y, t in zip(theirs, own, own_ts.to_pylist(), strict=True)], bool)
            match = pa.array(at, mask=~same)
            r = pa.array(revisit)
            yield pa.RecordBatch.from_arrays([b.column(3).take(r), url.take(r), own_ts, b.column(4).take(r), b.column(3).take(match), b.column(4).take(match), b.column(5).take(match), b.column(6).take(match)], ["record_id", "url", "ts", "own", "response_id", "stored", "payload_digest", "payload_length"])
            before = b.slice(int(last[-1]), 1) if last[-1] >= 0 else None

    met = dealt.mapInArrow(carry, out_schema).withColumns({"own": F.from_json("own", HEADERS), "stored": F.from_json("stored", HEADERS)})
    tag = lambda c: F.regexp_replace(F.element_at(c, "etag"), "^W/", "")
    a, b = tag("own"), tag("stored")
    c, d = F.element_at("own", F.lit("last-modified")), F.element_at("stored", F.lit("last-modified"))
    agree = F.when(a.isNotNull() & b.isNotNull(), a == b).when(c.isNotNull() & d.isNotNull(), c == d)
    status = F.when(F.col("response_id").isNull(), "orphan").when(agree, "resolved").when(~agree, "mismatch").otherwise("unverified")
    allowed = F.map_filter("own", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.map_contains_key(allowed, k)), allowed)
    taken = F.col("status").isin("resolved", "unverified")
    met = met.withColumn("status", status)
    return met.select("record_id", "url", "ts", "status", F.when(F.col("status") != "orphan", F.col("response_id")).alias("response_id"), F.when(taken, F.col("payload_digest")).alias("payload_digest"), F.when(taken, F.col("payload_length")).alias("payload_length"), F.when(taken, merged).otherwise(F.col("own")).alias("headers"))


def crawl(pages: DataFrame) -> DataFrame:
    """WARC records from pages: each is fetched in full once and asked for twice more, answered not modified.

    Tags, dates and gaps follow from page_id; pages with one canonical URL stand in each other's way.
    """
    pid, k = F.col("page_id"), F.col("k")
    digest = F.md5(F.coalesce("html", F.lit("")))
    etag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    base = pages.select("page_id", "url", digest.alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    full = k == 0
    own_tag = F.when(pid % 5 == 4, None).when(~full & ((pid + k) % 11 == 0), F.lit('"changed"')).when(~full & (pid % 2 == 0), F.concat(F.lit("W/"), etag)).otherwise(etag)
    fields = {
        "cache-control": F.when(full, F.concat(F.lit("max-age="), (pid % 3).cast("string"))).otherwise(F.lit("max-age=60")),
        "content-length": F.when(full, F.col("size").cast("string")).otherwise(F.lit("0")),
        "content-type": F.when(full, F.lit("text/html")),
        "etag": own_tag,
        "last-modified": F.when(pid % 7 == 6, None).otherwise(F.concat(F.lit("day "), (pid % 97).cast("string"))),
        "date": F.concat(F.lit("t"), (pid * 60 + k * 600000).cast("string")),
    }
    entries = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in fields.items())), lambda e: e["value"].isNotNull())
    return base.select((pid * 10 + k).alias("record_id"), "url", (pid * 60 + k * 600000).alias("ts"), F.when(full, "response").otherwise("revisit").alias("type"), F.map_from_entries(entries).alias("headers"), F.col("digest").alias("payload_digest"), F.col("size").alias("payload_length"))


def op4(pages: DataFrame) -> DataFrame:
    out = resolve(crawl(pages))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.select("record_id", "url", "ts", "status", "response_id", "payload_digest", "payload_length", F.array_join(lines, "\n").alias("headers"))


SQL = r"""
WITH base AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size, k
  FROM pages CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)
), records AS (
  SELECT page_id * 10 + k AS record_id, page_id * 60 + k * 600000 AS ts, k = 0 AS is_full, digest, size,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?@]*@)?', '') AS bare,
    CASE WHEN page_id % 5 = 4 THEN NULL WHEN k > 0 AND (page_id + k) % 11 = 0 THEN '"changed"'
      WHEN k > 0 AND page_id % 2 = 0 THEN 'W/"' || substr(digest, 1, 16) || '"' ELSE '"' || substr(digest, 1, 16) || '"' END AS etag,
    CASE WHEN page_id % 7 = 6 THEN NULL ELSE 'day ' || CAST(page_id % 97 AS VARCHAR) END AS modified,
    CASE WHEN k = 0 THEN 'max-age=' || CAST(page_id % 3 AS VARCHAR) ELSE 'max-age=60' END AS cache,
    't' || CAST(page_id * 60 + k * 600000 AS VARCHAR) AS date_
  FROM base
), named AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[0-9]*\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
         lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|msclkid|ref)(=|$)'))), '&'), ''), '') AS c
  FROM records
), met AS (
  SELECT v.*, r.record_id AS rid, r.digest AS rdigest, r.size AS rsize, r.etag AS retag, r.modified AS rmodified,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.record_id DESC) AS place
  FROM named v LEFT JOIN named r ON r.is_full AND r.c = v.c AND r.ts < v.ts WHERE NOT v.is_full
), judged AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL AND retag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL AND rmodified IS NOT NULL THEN CASE WHEN modified = rmodified THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unverified' END AS status
  FROM met WHERE place = 1
)
SELECT record_id, c AS url, ts, status, rid AS response_id,
  CASE WHEN status IN ('resolved', 'unverified') THEN rdigest END AS payload_digest,
  CASE WHEN status IN ('resolved', 'unverified') THEN rsize END AS payload_length,
  array_to_string(list_filter(CASE WHEN status IN ('resolved', 'unverified') THEN
      ['cache-control: ' || cache, 'content-length: ' || CAST(rsize AS VARCHAR), 'content-type: text/html', 'date: ' || date_,
       'etag: ' || coalesce(etag, retag), 'last-modified: ' || coalesce(modified, rmodified)]
    ELSE ['cache-control: ' || cache, 'content-length: 0', 'date: ' || date_, 'etag: ' || etag, 'last-modified: ' || modified] END,
    lambda x: x IS NOT NULL), chr(10)) AS headers
FROM judged
"""
