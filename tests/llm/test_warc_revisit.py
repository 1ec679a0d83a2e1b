import random

from pyspark.sql import functions as F

from corpusmill.llm import warc_revisit as W

SCHEMA = "record_id long, url string, ts long, type string, headers map<string,string>, payload_digest string, payload_length long"


def test_canonical_urls(spark):
    rows = [("HTTP://www.A.com:80/x/?b=2&utm_source=f&a=1#top", "a.com/x?a=1&b=2"), ("https://a.com/x/", "a.com/x"), ("https://u@www2.a.com", "a.com"), ("http://a.com/X.html?ref=1", "a.com/X.html"), (None, None)]
    df = spark.createDataFrame(rows, "url string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", W.canonical_url(F.col("url"))).collect())


def brute(records):
    out = []
    for r in records:
        if r[3] != "revisit":
            continue
        url = r[1].split("#")[0] if r[1] else None
        before = [s for s in records if s[3] == "response" and s[1] and url and s[2] is not None and r[2] is not None and s[1].split("#")[0] == url and s[2] < r[2]]
        if not before:
            out.append((r[0], "orphan", None))
            continue
        s = max(before, key=lambda x: (x[2], x[0]))
        tag = lambda h: (h.get("etag") or "").removeprefix("W/") or None
        a, b, c, d = tag(r[4]), tag(s[4]), r[4].get("last-modified"), s[4].get("last-modified")
        status = ("resolved" if a == b else "mismatch") if a and b else ("resolved" if c == d else "mismatch") if c and d else "unverified"
        out.append((r[0], status, s[0]))
    return sorted(out)


def test_equals_brute_force_with_a_hot_url_and_ties(spark):
    rng = random.Random(1)
    records = []
    for i in range(900):
        headers = {}
        if rng.random() < 0.7:
            headers["etag"] = rng.choice(['"a"', 'W/"a"', '"b"'])
        if rng.random() < 0.5:
            headers["last-modified"] = rng.choice(["d1", "d2"])
        url = rng.choice(["http://h.x/hot"] * 5 + [f"http://h.x/{rng.randrange(60)}", None]) if i else None
        if url and rng.random() < 0.3:
            url += "#f"
        records.append((i, url, rng.choice([None, *range(40)]), rng.choice(["response", "revisit", "request"]), headers, f"d{i}", i))
    df = spark.createDataFrame(records, SCHEMA).repartition(7)
    got = sorted((r["record_id"], r["status"], r["response_id"]) for r in W.resolve(df).collect())
    assert got == brute(records)


def test_headers_and_payload(spark):
    rows = [
        (1, "http://a.x/p", 10, "response", {"etag": '"v"', "content-type": "text/html", "cache-control": "old", "content-length": "5"}, "dig", 5),
        (2, "https://www.a.x/p/", 20, "revisit", {"etag": 'W/"v"', "cache-control": "new", "content-length": "0", "set-cookie": "x"}, None, None),
        (3, "http://a.x/p", 30, "revisit", {"etag": '"w"'}, None, None),
        (4, "http://a.x/p", 40, "revisit", None, None, None),
    ]
    got = {r["record_id"]: r for r in W.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2]["headers"] == {"etag": 'W/"v"', "content-type": "text/html", "cache-control": "new", "content-length": "5"}
    assert (got[2]["payload_digest"], got[2]["payload_length"], got[2]["response_id"]) == ("dig", 5, 1)
    assert got[3]["status"] == "mismatch" and got[3]["payload_digest"] is None and got[3]["headers"] == {"etag": '"w"'}
    assert got[4]["status"] == "unverified" and got[4]["headers"]["content-type"] == "text/html"


def test_empty_and_only_revisits(spark):
    df = spark.createDataFrame([(1, "http://a/", 1, "revisit", {}, None, None)] * 2, SCHEMA)
    assert [r["status"] for r in W.resolve(df).collect()] == ["orphan", "orphan"]
    assert W.resolve(df.limit(0)).count() == 0


def test_ties_are_settled_alike_in_and_across_parts(spark):
    tied = [(5, "http://a.x/p", 10, "response", {"etag": f'"{k}"'}, f"d{k}", k) for k in range(9)]
    later = [(100 + i, "http://a.x/p", 20 + i, "revisit", {}, None, None) for i in range(300)]
    df = spark.createDataFrame(tied + later, SCHEMA)
    for parts in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = W.resolve(df.repartition(4)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert len(got) == 300 and {(r["status"], r["payload_digest"], r["headers"]["etag"]) for r in got} == {("unverified", "d8", '"8"')}


def test_odd_records(spark):
    long = {"etag": '"e"', "x-long": "v" * 2_000_000}
    rows = [(1, "http://a.x/p", 1, "response", long, "d", 1), (2, "http://a.x/p", 2, "revisit", long, None, None), (None, "http://a.x/p", 3, "revisit", None, None, None), (3, None, None, "revisit", None, None, None), (4, "", 4, "revisit", {}, None, None), (5, None, None, "response", None, None, None), (6, "http://a.x/p", None, "revisit", {}, None, None), (7, "u", 1, None, {}, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("kind", "status", "response_id", "own", "stored", "_tie", "_part")})
    got = {r["record_id"]: r for r in W.resolve(df).collect()}
    assert {k: r["status"] for k, r in got.items()} == {2: "resolved", None: "unverified", 3: "orphan", 4: "orphan", 6: "orphan"}
    assert got[2]["headers"]["x-long"] == "v" * 2_000_000 and got[2]["response_id"] == 1
