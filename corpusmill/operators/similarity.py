"""Similarity over texts and vectors: Jaccard and cosine pairs, top-k, anti-signals, clusters, TF-IDF, suggestions."""

from __future__ import annotations

import difflib
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.operators.graph import connected_components

MAX_CLUSTER, MIN_DOC, MIN_REPEAT, HASH_LENGTH = 50, 15, 4, 12
# fixed values: an accessor's promise, accessor names, keywords that weigh twice
ACCESSOR_DOC = r"(?i)^(return|returns|get|gets|set|sets)\b.{0,40}$"
ACCESSOR_NAMES = ["name", "value", "id", "key", "path", "data", "kind", "type", "label"]
KEYWORDS = ["for", "while", "if", "elif", "else", "try", "except", "finally", "with", "return", "yield", "raise", "lambda", "async", "await"]
#: Rows of a block of vectors, and how many blocks of queries go with one scan.
BLOCK, ABREAST = 4096, 16


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; both empty: 1, one empty: 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_pairs(sets: DataFrame, threshold: float, id_col: str = "id", items: str = "items") -> DataFrame:
    """(a, b, score) with a < b for sets of at least one item that reach the threshold.

    Prefix filtering: items are ordered from rare to common, and two sets that reach the threshold share an
    item among their first ones, so only those are joined. Equal sets meet once a class, by their first id.
    """
    rows = sets.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(items)).alias("items")).where(F.size("items") > 0)
    classes = rows.groupBy("items").agg(F.min("id").alias("id"))
    item = classes.select("id", F.explode("items").alias("item"))
    often = item.groupBy("item").agg(F.count("*").alias("n"))
    ranked = item.join(often, "item").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias("items"))
    size = F.size("items")
    prefix = ranked.select("id", "items", F.explode(F.slice("items", F.lit(1), size - F.ceil(size * threshold).cast("int") + 1)).alias("item"))
    a = prefix.select(F.col("id").alias("a"), F.col("items").alias("xs"), "item")
    b = prefix.select(F.col("id").alias("b"), F.col("items").alias("ys"), "item")
    close = a.join(b, "item").where((F.col("a") < F.col("b")) & (F.size("xs") >= F.size("ys") * threshold) & (F.size("ys") >= F.size("xs") * threshold))
    return close.dropDuplicates(["a", "b"]).withColumn("score", jaccard(F.col("xs"), F.col("ys"))).where(F.col("score") >= threshold).select("a", "b", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit_matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one; zero vectors stay zero."""
    if not len(column):
        return np.zeros((0, 0))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None]


def cosine_pairs(vectors: DataFrame, threshold: float, id_col: str, vector: str, group: str) -> DataFrame:
    """(i, j, score) with i < j, of different groups, at or above the threshold: every pair is compared.

    The matrix is cut into blocks of rows; each pair of blocks is one unit of work and one matrix product. Units
    arrive one after another, so a task holds two blocks at a time.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(group).cast("string").alias("grp"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and id is not null")
    n = max(1, -(-rows.count() // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    unit = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.least(x, own).cast("long") * n + F.greatest(x, own))
    dealt = rows.select("id", "grp", "v", own.alias("block"), F.explode(unit).alias("unit"))

    def compare(u: int, held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks()
        x = _unit_matrix(t["v"].combine_chunks())
        ids, groups, block = t["id"].to_numpy(), t["grp"].to_pandas().to_numpy(), t["block"].to_numpy()
        left, right = np.flatnonzero(block == u // n), np.flatnonzero(block == u % n)
        for a in range(0, len(left), 512):
            own = left[a : a + 512]
            r, c = np.nonzero(x[own] @ x[right].T >= threshold - 1e-9)
            r, c = own[r], right[c]
            ok = groups[r] != groups[c]
            if u // n == u % n:
                ok &= ids[r] < ids[c]
            r, c = r[ok], c[ok]
            s = (x[r] * x[c]).sum(axis=1)
            keep = s >= threshold
            i, j = np.minimum(ids[r], ids[c])[keep], np.maximum(ids[r], ids[c])[keep]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(s[keep])], ["i", "j", "score"])

    def run(batches):
        unit, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(4).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for first, stop in zip(edges, edges[1:], strict=False):
                if key[first] != unit and held:
                    yield from compare(unit, held)
                    held = []
                unit = int(key[first])
                held.append(b.slice(first, stop - first))
        if held:
            yield from compare(unit, held)

    return dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "i long, j long, score double")


def top_k(scores: DataFrame, by: str, item: str, k: int, threshold: float | None = None) -> DataFrame:
    """The k best (score, then smaller item) of each query; a threshold cuts first."""
    s = scores if threshold is None else scores.where(F.col("score") >= threshold)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), item))).where(F.col("rank") <= k)


def exact_neighbours(vectors: DataFrame, queries: Column, k: int, id_col: str, vector: str, threshold: float = -1.0) -> DataFrame:
    """(query_id, vec_id, rank, score): the k best of all other rows for each row that `queries` selects.

    Queries are gone through in blocks of BLOCK, each a matrix of known size; up to ABREAST blocks are sent for one
    scan of the rows, in which a task keeps the k best of its own rows for each query.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and id is not null")
    asked = vectors.where(queries).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and id is not null")
    blocks = max(1, -(-asked.count() // BLOCK))
    met = None
    for first in range(0, blocks, ABREAST):
        sent = []
        for i in range(first, min(first + ABREAST, blocks)):
            own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow()  # about BLOCK rows
            if own.num_rows:
                sent.append(rows.sparkSession.sparkContext.broadcast((own["id"].to_numpy(), _unit_matrix(own["v"].combine_chunks()))))

        def run(batches, sent=tuple(sent)):
            for b in batches:
                if not b.num_rows:
                    continue
                x, own = _unit_matrix(b.column(1)), b.column(0).to_numpy()
                for block in sent:
                    every, q = block.value
                    for a in range(0, len(every), 256):
                        ids = every[a : a + 256]
                        s = q[a : a + 256] @ x.T
                        s[ids[:, None] == own[None, :]] = -2
                        r, c = np.nonzero(s >= max(threshold, -1.5) - 1e-9)
                        exact = (q[a : a + 256][r] * x[c]).sum(axis=1)
                        order = np.lexsort((own[c], -exact, r))
                        r, c, exact = r[order], c[order], exact[order]
                        place = np.arange(len(r)) - np.searchsorted(r, r)
                        keep = (place < k) & (exact >= threshold)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[r[keep]]), pa.array(own[c[keep]]), pa.array(exact[keep])], ["query_id", "vec_id", "score"])

        one = rows.mapInArrow(run, "query_id long, vec_id long, score double")
        met = one if met is None else met.unionByName(one)
    return top_k(met, "query_id", "vec_id", k).select("query_id", "vec_id", "rank", "score")


def is_trivial_accessor(name: Column, first_line: Column) -> Column:
    return first_line.rlike(ACCESSOR_DOC) | (name.isin(ACCESSOR_NAMES) & (F.char_length(first_line) < 2 * MIN_DOC))


def package_token(package: Column, lead: str) -> Column:
    return F.regexp_replace(package, f"^{lead}", "")


def split_pairs(pairs: DataFrame, symbols: DataFrame, lead: str = "pkg-") -> DataFrame:
    """pairs (i, j, score) with a bucket: boilerplate (both sides), parallel (a side named after its package), else duplicate.

    symbols: id, name, package, doc_first_line, doc_full. A first line of four symbols or more is generic.
    """
    line = F.lower(F.trim("doc_first_line"))
    generic = symbols.where(line != "").groupBy(line.alias("line")).agg(F.count("*").alias("n")).where(F.col("n") >= MIN_REPEAT).select("line", F.lit(True).alias("generic"))
    s = symbols.withColumn("line", line).join(generic, "line", "left")
    boiler = F.coalesce("generic", F.lit(False)) | (F.char_length("doc_full") < MIN_DOC) | is_trivial_accessor(F.col("name"), F.trim("doc_first_line"))
    first = F.element_at(F.split(F.regexp_replace("name", "^_+", ""), "_"), 1)
    s = s.select("id", boiler.alias("boiler"), ((first == package_token(F.col("package"), lead)) & (first != "")).alias("own"))
    x = s.select(F.col("id").alias("i"), F.col("boiler").alias("bi"), F.col("own").alias("oi"))
    y = s.select(F.col("id").alias("j"), F.col("boiler").alias("bj"), F.col("own").alias("oj"))
    bucket = F.when(F.col("bi") & F.col("bj"), "boilerplate").when(F.col("oi") | F.col("oj"), "parallel").otherwise("duplicate")
    return pairs.join(x, "i").join(y, "j").select("i", "j", "score", bucket.alias("bucket"))


def clusters(pairs: DataFrame, most: int = MAX_CLUSTER) -> DataFrame:
    """(cluster, members, size, max_score): connected components of the pairs, those over `most` members dropped.

    Sizes are counted before members are gathered, so no gathered list is longer than `most`.
    """
    c = connected_components(pairs, "i", "j")
    size = c.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") <= most)
    members = c.join(size, "component").groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"), F.first("size").alias("size"))
    best = pairs.join(c, pairs.i == c.node).groupBy("component").agg(F.max("score").alias("max_score"))
    return members.join(best, "component").select(F.col("component").alias("cluster"), "members", "size", "max_score")


def cluster_hash(keys: Column) -> Column:
    """First 12 hex digits of the SHA-256 of the sorted key lists as JSON; other than ASCII is escaped by code unit."""
    text = F.to_json(F.array_sort(keys))
    return F.substring(F.sha2(text.cast("binary"), 256), 1, HASH_LENGTH)


def component_hashes(components: DataFrame, key: Column) -> DataFrame:
    """(cluster, cluster_hash): for components of any size, the cluster_hash of their members' keys.

    The keys of a component go to one task, as a digest is taken in order, but are sorted outside memory and never gathered.
    """

    def run(batches):
        cluster = digest = None
        for b in batches:
            ready = []
            for c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest is not None and c == cluster:
                    digest.update(b",")
                else:
                    if digest is not None:
                        ready.append((cluster, digest))
                    cluster, digest = c, hashlib.sha256(b"[")
                digest.update(text.encode())
            yield send(ready)
        if digest is not None:
            yield send([(cluster, digest)])

    def send(ready):
        for _, digest in ready:
            digest.update(b"]")
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in ready], kind), pa.array([d.hexdigest()[:HASH_LENGTH] for _, d in ready], pa.string())], ["cluster", "cluster_hash"])

    kind = to_arrow_type(components.schema["component"].dataType)
    rows = components.select("component", key.alias("key")).repartition("component").sortWithinPartitions("component", "key")
    schema = T.StructType([T.StructField("cluster", components.schema["component"].dataType), T.StructField("cluster_hash", T.StringType())])
    return rows.select("component", F.to_json("key")).mapInArrow(run, schema)


def mark_waived(found: DataFrame, waivers: DataFrame) -> DataFrame:
    w = waivers.select(F.col("hash").alias("cluster_hash")).distinct().withColumn("acknowledged", F.lit(True))
    return found.join(w, "cluster_hash", "left").withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))


def stale_waivers(found: DataFrame, waivers: DataFrame) -> DataFrame:
    return waivers.join(found.select(F.col("cluster_hash").alias("hash")), "hash", "left_anti")


def waiver_problem(hash_: Column, reason: Column) -> Column:
    """Why a waiver is malformed; null if it is not."""
    return F.when(~F.coalesce(hash_, F.lit("")).rlike(f"^[0-9a-f]{{{HASH_LENGTH}}}$"), "hash must be 12 hex digits").when(F.trim(F.coalesce(reason, F.lit(""))) == "", "reason must not be empty")


def code_tokens(text: Column) -> Column:
    """Identifiers in lower case, then their camel-case and snake-case parts, and keywords once more for each time they stand."""
    names = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)
    parts = F.flatten(F.transform(names, lambda n: F.concat(F.array(F.lower(n)), F.filter(F.transform(F.split(n, r"(?<=[a-z])(?=[A-Z])|_"), lambda p: F.lower(p)), lambda p: p != ""))))
    return F.concat(parts, F.filter(parts, lambda p: p.isin(KEYWORDS)))


def tfidf(docs: DataFrame, tokens: Column, id_col: str) -> DataFrame:
    """(id, token, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document scaled to length 1."""
    d = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    n = d.count()
    tf = d.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    raw = (F.lit(1) + F.log("tf")) * (F.log((F.lit(1.0) + n) / (F.lit(1) + F.col("df"))) + 1)
    w = tf.join(df, "token").select("id", "token", raw.alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))  # a later ranking by id needs no further shuffle
    return w.select("id", "token", (F.col("raw") / norm).alias("weight"))


def suggestions(names: DataFrame, wanted: str, cutoff: float = 0.6, most: int = 10) -> DataFrame:
    """(name, ratio) of the names nearest to one by matching blocks, best first; the measure has no built-in equivalent."""

    @F.pandas_udf("double")
    def ratio(s: pd.Series) -> pd.Series:
        m = difflib.SequenceMatcher()
        m.set_seq2(wanted)

        def one(x: str) -> float:
            m.set_seq1(x)
            return m.ratio() if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff else 0.0

        return s.map(one)

    return names.select("name").distinct().withColumn("ratio", ratio("name")).where(F.col("ratio") >= cutoff).orderBy(F.desc("ratio"), F.desc("name")).limit(most).withColumn("ratio", F.round("ratio", 2))
