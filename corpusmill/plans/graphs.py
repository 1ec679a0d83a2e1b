"""Iterative graph queries: ranking, reachability, cycles, closures, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import graph as G
from corpusmill.plans.corpus import facts, views
from corpusmill.plans.registry import query
from corpusmill.session import table

# parts that follow each other within an order
EDGE_SQL = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst
 FROM lineitem) WHERE dst IS NOT NULL)"""


def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null").distinct()


def _rank_sql(rounds: int) -> str:
    steps = [f"WITH {EDGE_SQL}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), k AS (SELECT count(*) AS k FROM n), o AS (SELECT src, count(*) AS out FROM e GROUP BY 1), r0 AS (SELECT node, 1.0 / (SELECT k FROM k) AS rank FROM n)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT n.node, 0.15 / (SELECT k FROM k) + 0.85 * coalesce(g.got, 0) AS rank FROM n LEFT JOIN (SELECT e.dst, sum(r{i}.rank / o.out) AS got FROM r{i} JOIN e ON e.src = r{i}.node JOIN o ON o.src = e.src GROUP BY 1) g ON g.dst = n.node)")
    return ", ".join(steps) + f" SELECT node, round(rank / (SELECT sum(rank) FROM r{rounds}), 9) AS rank FROM r{rounds}"


@query(_rank_sql(30))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(successors(spark, sf_dir)).withColumn("rank", F.round("rank", 9))


@query(facts("modules", "classes", "imports", "functions") + """
, s AS (SELECT DISTINCT name FROM (SELECT name FROM functions_ WHERE class_name IS NULL UNION ALL SELECT name FROM classes_)),
e AS (SELECT '__mod__' || module AS src, unnest(all_exports) AS dst FROM modules_ UNION ALL SELECT name, unnest(bases) FROM classes_ UNION ALL SELECT '__mod__' || module, unnest(names) FROM imports_ WHERE is_relative)
SELECT DISTINCT src, dst FROM e JOIN s ON s.name = dst WHERE src <> dst UNION ALL SELECT name, NULL FROM s""")
def symbol_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbol_edges(spark, sf_dir)


def _symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    symbols = v["functions"].where("class_name is null").select("name").unionByName(v["classes"].select("name"))
    exports = v["modules"].select("module", F.explode("all_exports").alias("name"))
    bases = v["classes"].select("name", F.explode("bases").alias("base"))
    imports = v["imports"].where("is_relative").select("module", F.explode("names").alias("name"))
    return G.symbol_edges(v["modules"], exports, bases, imports, symbols)


@query()
def symbol_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by rank; module nodes are left out after scoring."""
    return G.pagerank(_symbol_edges(spark, sf_dir)).where(~F.startswith("node", F.lit("__mod__"))).withColumn("rank", F.round("rank", 9))


@query("""WITH m AS (SELECT p_brand AS module, max(p_retailprice) / 40000 AS score, count_if(p_size > 48) AS symbols FROM part GROUP BY 1)
SELECT module, CASE WHEN symbols = 0 THEN 1 WHEN score * 100 + symbols * 0.5 > 5 THEN 5 WHEN score * 100 + symbols * 0.5 > 3 THEN 4 WHEN score * 100 + symbols * 0.5 > 1.5 THEN 3 WHEN score * 100 + symbols * 0.5 > 0.5 THEN 2 ELSE 1 END AS stars FROM m""")
def star_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("module")).agg((F.max("p_retailprice") / 40000).alias("score"), F.count_if(F.col("p_size") > 48).alias("symbols"))
    return m.select("module", G.stars(F.col("score"), F.col("symbols")).alias("stars"))


@query(f"""WITH RECURSIVE {EDGE_SQL}, r(node, depth) AS (SELECT min(src), 0 FROM e UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 5)
SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = successors(spark, sf_dir)
    return G.reach(e, e.agg(F.min("src").alias("node")), 5).select("node", "depth")


@query(facts("inside", recursive=True) + """, e AS (SELECT DISTINCT name AS src, callee AS dst FROM inside_),
r(node, depth, chain) AS (SELECT 'test_m2', 0, ['test_m2'] UNION ALL SELECT e.dst, r.depth + 1, list_append(r.chain, e.dst) FROM r JOIN e ON e.src = r.node WHERE r.depth < 5),
m AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1) SELECT r.node, r.depth, min(chain) AS chain FROM r JOIN m ON m.node = r.node AND m.depth = r.depth GROUP BY 1, 2""", lists=("chain",))
def flow_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.operators.code import callees

    e = callees(views(spark, sf_dir)).select(F.col("name").alias("src"), F.col("callee").alias("dst"))
    return G.trace(e, "test_m2", 5)


@query()
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL is too slow for it on the whole table; tests hold it against brute force."""
    return G.strong_components(successors(spark, sf_dir))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in rows of four: every third row closed to a cycle, and some parts with an edge to themselves."""
    k = "p_partkey"
    next_ = f"CASE WHEN {k} % 4 < 3 THEN {k} + 1 WHEN CAST(floor({k} / 4) AS BIGINT) % 3 = 0 THEN {k} - 3 END"
    p = table(spark, sf_dir, "part")
    e = p.selectExpr(f"{k} AS src", f"{next_} AS dst").where("dst is not null")
    return e.unionByName(p.where(f"{k} % 17 = 0").selectExpr(f"{k} AS src", f"{k} AS dst"))


@query("SELECT p_partkey AS node, CASE WHEN p_partkey // 4 % 3 = 0 THEN p_partkey // 4 * 4 ELSE p_partkey END AS component FROM part WHERE p_partkey // 4 % 3 = 0 OR p_partkey % 17 = 0")
def cycles_with_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cycles(_blocks(spark, sf_dir))


@query("SELECT list_sort(list(p_partkey)) AS members FROM part WHERE p_partkey // 4 % 3 = 1 GROUP BY p_partkey // 4 UNION ALL SELECT [p_partkey] FROM part WHERE p_partkey // 4 % 9 = 0 AND p_partkey % 17 = 0", lists=("members",))
def new_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows closed by new edges, and loops that stood inside a cycle until an edge of it went."""
    row = "CAST(floor(p_partkey / 4) AS BIGINT)"
    p = table(spark, sf_dir, "part")
    adds = p.where(f"{row} % 3 = 1 and p_partkey % 4 = 3").selectExpr("p_partkey AS src", "p_partkey - 3 AS dst")
    gone = p.where(f"{row} % 9 = 0 and p_partkey % 4 = 0").selectExpr("p_partkey AS src", "p_partkey + 1 AS dst")
    return G.new_cycles(_blocks(spark, sf_dir), adds, gone)


@query(f"""WITH RECURSIVE {EDGE_SQL}, r(node) AS (SELECT min(src) FROM e UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is reached from the smallest part."""
    e = successors(spark, sf_dir)
    return G.reach(e, e.agg(F.min("src").alias("node"))).select("node")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION SELECT p_partkey, p_partkey // 5 FROM part),
m(node) AS (SELECT e.dst FROM e WHERE src % 100 = 51 UNION SELECT e.dst FROM m JOIN e ON e.src = m.node), r(node) AS (SELECT e.dst FROM e WHERE src % 100 = 62 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
SELECT node FROM m WHERE node IN (SELECT node FROM r) AND node % 100 NOT IN (51, 62)""")
def shared_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both moved parts and remaining ones lead to."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    e = p.select(k.alias("src"), F.floor(k / 2).alias("dst")).unionByName(p.select(k.alias("src"), F.floor(k / 5).alias("dst")))
    pick = lambda n: p.where(k % 100 == n).select(k.alias("node"))
    return G.shared_helpers(e, pick(51), pick(62))


DAG = "SELECT DISTINCT l_partkey AS src, l_partkey // 3 - l_suppkey % 5 AS dst FROM lineitem WHERE l_partkey // 3 - l_suppkey % 5 > 0"


@query(f"""WITH RECURSIVE e AS ({DAG}), r(node, level) AS (SELECT DISTINCT dst, 0 FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.node) SELECT node, max(level) AS level FROM r GROUP BY 1""")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    e = li.select(F.col("l_partkey").alias("src"), (F.floor(F.col("l_partkey") / 3) - F.col("l_suppkey") % 5).alias("dst")).where("dst > 0").distinct()
    return G.topological_levels(e, e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))))
