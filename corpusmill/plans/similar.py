"""Similarity queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import similarity as M
from corpusmill.plans.registry import query, values
from corpusmill.session import table

VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
PAIRS = f"{VECTORS}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE list_cosine_similarity(a.e, b.e) >= 0.4)"
LINES = "list_sort(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: len(x) >= 20)))"


def pairs(spark: SparkSession, sf_dir: str, threshold: float = 0.4) -> DataFrame:
    return M.cosine_pairs(table(spark, sf_dir, "embeddings"), threshold, "vec_id", "embedding", "label")


@query(f"WITH {PAIRS} SELECT i, j, round(score, 6) AS score FROM p")
def cosine_cross_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"""WITH {VECTORS}, s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.3) SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated queries against every vector, in blocks of queries."""
    v = table(spark, sf_dir, "embeddings")
    found = M.exact_neighbours(v, F.col("vec_id") % 100 == 0, 10, "vec_id", "embedding", 0.3)
    return found.withColumn("score", F.round("score", 6))


COMPONENTS = f"""WITH RECURSIVE {PAIRS}, e AS (SELECT i AS a, j AS b FROM p UNION SELECT j, i FROM p),
r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), c AS (SELECT node, min(root) AS component FROM r GROUP BY 1)"""


@query(COMPONENTS + " SELECT node, component FROM c")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.operators.graph import connected_components

    return connected_components(pairs(spark, sf_dir), "i", "j")


@query(COMPONENTS + """, m AS (SELECT component AS cluster, list_sort(list(node)) AS members, count(*) AS size FROM c GROUP BY 1 HAVING count(*) <= 4)
SELECT cluster, members, size, round((SELECT max(score) FROM p JOIN c ON c.node = p.i WHERE c.component = m.cluster), 6) AS max_score FROM m""", lists=("members",))
def clusters_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.clusters(pairs(spark, sf_dir), 4).withColumn("max_score", F.round("max_score", 6))


@query(COMPONENTS + """, k AS (SELECT component, list_sort(list(['p' || CAST(node % 7 AS VARCHAR), 'q' || CAST(node AS VARCHAR)])) AS keys FROM c GROUP BY 1)
SELECT component AS cluster, substr(sha256('[' || array_to_string(list_transform(keys, lambda x: '["' || x[1] || '","' || x[2] || '"]'), ',') || ']'), 1, 12) AS cluster_hash FROM k""")
def cluster_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("node")
    key = F.array(F.concat(F.lit("p"), (m % 7).cast("string")), F.concat(F.lit("q"), m.cast("string")))
    return M.component_hashes(components(spark, sf_dir), key)


WAIVERS = [("000000000000", "gone"), ("ffffffffffff", " "), ("xyz", "short")]


@query(f"""WITH {values('w', ['hash', 'reason'], WAIVERS)}, d AS (SELECT DISTINCT substr(sha256(source), 1, 12) AS cluster_hash, source FROM documents),
h AS (SELECT cluster_hash AS hash, 'kept' AS reason FROM d WHERE source LIKE 'src1%' UNION ALL SELECT * FROM w)
SELECT cluster_hash AS hash, CASE WHEN cluster_hash IN (SELECT hash FROM h) THEN 'acknowledged' ELSE 'open' END AS state FROM d
UNION ALL SELECT hash, 'stale' FROM h WHERE hash NOT IN (SELECT cluster_hash FROM d)""")
def waivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source").distinct().select(F.substring(F.sha2(F.col("source").cast("binary"), 256), 1, 12).alias("cluster_hash"), "source")
    h = d.where("source like 'src1%'").select(F.col("cluster_hash").alias("hash"), F.lit("kept").alias("reason")).unionByName(spark.createDataFrame(WAIVERS, "hash string, reason string"))
    marked = M.mark_waived(d, h).select(F.col("cluster_hash").alias("hash"), F.when(F.col("acknowledged"), "acknowledged").otherwise("open").alias("state"))
    return marked.unionByName(M.stale_waivers(d, h).select("hash", F.lit("stale").alias("state")))


@query("""WITH w AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN substr(sha256(p_name), 1, 12) WHEN 1 THEN p_name ELSE upper(substr(sha256(p_name), 1, 12)) END AS hash, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_type END AS reason FROM part)
SELECT hash, reason, CASE WHEN NOT regexp_full_match(hash, '[0-9a-f]{12}') THEN 'hash must be 12 hex digits' WHEN trim(reason) = '' THEN 'reason must not be empty' END AS problem FROM w""")
def waiver_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.substring(F.sha2(F.col("p_name").cast("binary"), 256), 1, 12)
    k = F.col("p_partkey") % 3
    w = table(spark, sf_dir, "part").select(F.when(k == 0, digest).when(k == 1, F.col("p_name")).otherwise(F.upper(digest)).alias("hash"), F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_type")).alias("reason")).distinct()
    return w.select("hash", "reason", M.waiver_problem(F.col("hash"), F.col("reason")).alias("problem"))


@query(f"""WITH s AS (SELECT doc_id, {LINES} AS xs FROM documents), d AS (SELECT min(doc_id) AS id, xs FROM s WHERE len(xs) > 0 GROUP BY xs)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.xs, b.xs)) / len(list_distinct(list_concat(a.xs, b.xs))), 6) AS score FROM d a JOIN d b ON a.id < b.id
WHERE len(list_intersect(a.xs, b.xs)) / len(list_distinct(list_concat(a.xs, b.xs))) >= 0.5""")
def line_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their longer lines; equal line sets stand for themselves once."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.char_length(x) >= 20)
    return M.jaccard_pairs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), lines.alias("items")), 0.5).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(p_name, ' ') END AS a, CASE WHEN p_partkey % 10 IN (0, 1) THEN CAST([] AS VARCHAR[]) ELSE [string_split(p_name, ' ')[1], p_brand] END AS b FROM part)
SELECT p_partkey, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS score FROM s""", doubles=("score",))
def jaccard_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets that are empty on either side, on both, or on none."""
    k, words, none = F.col("p_partkey"), F.split("p_name", " "), F.array().cast("array<string>")
    a = F.when(k % 5 == 0, none).otherwise(words)
    b = F.when((k % 10).isin(0, 1), none).otherwise(F.array(F.element_at(words, 1), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", M.jaccard(a, b).alias("score"))


@query(f"""WITH {PAIRS}, s AS (SELECT vec_id AS id, CASE vec_id % 9 WHEN 0 THEN 'name' WHEN 1 THEN 'l' || CAST(label AS VARCHAR) || '_run' WHEN 2 THEN '_l' || CAST(label AS VARCHAR) ELSE 'f' || CAST(vec_id AS VARCHAR) END AS name,
  'pkg-l' || CAST(label AS VARCHAR) AS package, CASE WHEN vec_id % 4 = 0 THEN 'Return it.' WHEN vec_id % 5 = 0 THEN 'Shared promise of many.' ELSE 'Own promise ' || CAST(vec_id AS VARCHAR) END AS line FROM embeddings),
g AS (SELECT lower(line) AS l FROM s GROUP BY 1 HAVING count(*) >= 4),
b AS (SELECT id, lower(line) IN (SELECT l FROM g) OR len(line) < 15 OR regexp_matches(line, '(?i)^(return|returns|get|gets|set|sets)\\b.{{0,40}}$') OR (name = 'name' AND len(line) < 30) AS boiler,
  string_split(ltrim(name, '_'), '_')[1] = replace(package, 'pkg-', '') AS own FROM s)
SELECT i, j, CASE WHEN x.boiler AND y.boiler THEN 'boilerplate' WHEN x.own OR y.own THEN 'parallel' ELSE 'duplicate' END AS bucket FROM p JOIN b x ON x.id = i JOIN b y ON y.id = j""")
def pair_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vid, label = F.col("vec_id"), F.col("label").cast("string")
    name = F.when(vid % 9 == 0, "name").when(vid % 9 == 1, F.concat(F.lit("l"), label, F.lit("_run"))).when(vid % 9 == 2, F.concat(F.lit("_l"), label)).otherwise(F.concat(F.lit("f"), vid.cast("string")))
    line = F.when(vid % 4 == 0, "Return it.").when(vid % 5 == 0, "Shared promise of many.").otherwise(F.concat(F.lit("Own promise "), vid.cast("string")))
    s = table(spark, sf_dir, "embeddings").select(vid.alias("id"), name.alias("name"), F.concat(F.lit("pkg-l"), label).alias("package"), line.alias("doc_first_line"), line.alias("doc_full"))
    return M.split_pairs(pairs(spark, sf_dir), s).select("i", "j", "bucket")


@query(f"WITH {PAIRS} SELECT i, j, round(score, 4) AS score FROM p ORDER BY p.score DESC, i, j LIMIT 20")
def strongest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).orderBy(F.desc("score"), "i", "j").limit(20).withColumn("score", F.round("score", 4))


TOKENS = r"list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT doc_id AS id, unnest({TOKENS}) AS token FROM documents), tf AS (SELECT id, token, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT id, token, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (token)), n AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY 1),
r AS (SELECT id, token, raw / norm AS weight, row_number() OVER (PARTITION BY id ORDER BY round(raw / norm, 9) DESC, token) AS rank FROM w JOIN n USING (id)) SELECT id, token, round(weight, 6) AS weight, rank FROM r WHERE rank <= 3""")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    tokens = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    w = M.tfidf(table(spark, sf_dir, "documents"), tokens, "doc_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("weight", 9)), "token"))
    return w.withColumn("rank", rank).where("rank <= 3").select("id", "token", F.round("weight", 6).alias("weight"), "rank")


@query("""WITH w AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w FROM part)
SELECT id, list_concat([concat('get', w[1], w[2]), 'get', w[1], w[2], 'return', 'return', concat(w[1], '_', w[2]), w[1], w[2]], ['return', 'return']) AS tokens FROM w""", lists=("tokens",))
def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("get"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("(12); return "), F.replace("p_name", F.lit(" "), F.lit("_")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), M.code_tokens(text).alias("tokens"))


@query()
def fuzzy_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.suggestions(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), "red widge")


@query("""WITH s AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)) AS score FROM embeddings WHERE vec_id <> 3)
SELECT vec_id, round(score, 6) AS score, CASE WHEN label % 2 = 0 THEN 'reuse_canonical' ELSE 'reuse_in_place' END AS verdict, label % 2 = 1 AND vec_id % 3 = 0 AS promotable FROM s WHERE score >= 0.2 ORDER BY s.score DESC, vec_id LIMIT 10""")
def retrieval_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    one = v.where("vec_id = 3").select(F.col("embedding").alias("q"))
    s = v.where("vec_id <> 3").crossJoin(F.broadcast(one)).withColumn("score", M.cosine(F.col("q"), F.col("embedding"))).where("score >= 0.2").orderBy(F.desc("score"), "vec_id").limit(10)
    canonical = F.col("label") % 2 == 0
    return s.select("vec_id", F.round("score", 6).alias("score"), F.when(canonical, "reuse_canonical").otherwise("reuse_in_place").alias("verdict"), (~canonical & (F.col("vec_id") % 3 == 0)).alias("promotable"))


@query("""SELECT doc_id, regexp_matches(l, '(?i)^(return|returns|get|gets|set|sets)\\b.{0,40}$') OR (lang = 'en' AND len(l) < 30) AS trivial
FROM (SELECT doc_id, lang, trim(string_split(trim(text, chr(10) || ' '), chr(10))[1]) AS l FROM documents)""")
def trivial_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.functions.text import first_line

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", M.is_trivial_accessor(F.when(F.col("lang") == "en", "name").otherwise("other"), first_line(F.col("text"))).alias("trivial"))
