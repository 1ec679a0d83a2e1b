"""Docstrings, rescued duplicate tests, naming verdicts, shortlists and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.docstring import parse_docstring
from corpusmill.plans.registry import query
from corpusmill.plans.rules import sources
from corpusmill.plans.similar import COMPONENTS, pairs
from corpusmill.session import cut_lineage, table


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 4 < 3 THEN concat(upper(p_name[1]), p_name[2:], '.') END AS summary,
CASE p_partkey % 4 WHEN 0 THEN concat('ValueError=bad ', p_size, ' input.;KeyError=gone.') WHEN 1 THEN concat('ValueError=If ', p_size, '.') WHEN 2 THEN concat('OSError=when ', p_size, ' closed') ELSE '' END AS raises,
CASE p_partkey % 4 WHEN 0 THEN concat('>>> f(', p_size, ')', chr(10), '1') WHEN 1 THEN concat('>>> g()', chr(10), p_size) ELSE '' END AS examples FROM part""")
def docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docstrings of three styles, and none."""
    lead = "concat(upper(substring(p_name, 1, 1)), substring(p_name, 2, 1000))"
    text = rf"""CASE p_partkey % 4 WHEN 0 THEN concat({lead}, '.\n\nArgs:\n    x: y\n\nRaises:\n    ValueError: bad ', p_size, '\n        input.\n    KeyError: gone.\n\nExample:\n    >>> f(', p_size, ')\n    1\n')
     WHEN 1 THEN concat(replace({lead}, ' ', '\n'), '.\n\nRaises\n------\nValueError\n    If ', p_size, '.\n\nExamples\n--------\n>>> g()\n', p_size)
     WHEN 2 THEN concat({lead}, '.\n\n:param x: y\n:raises OSError: when ', p_size, '\n    closed\n:returns: z') END"""
    d = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", f"{text} AS text").withColumn("p", parse_docstring(F.col("text")))
    return d.select("k", "p.summary", F.array_join(F.transform("p.raises", lambda x: F.concat(x["name"], F.lit("="), x["text"])), ";").alias("raises"), F.array_join("p.examples", "\n").alias("examples"))


@query("""WITH n AS (SELECT concat('test_', p_partkey) AS file, p_type AS tier, concat('test_', CASE WHEN p_partkey % 7 = 0 THEN p_partkey ELSE p_partkey // 3 END) AS canonical, p_size % 3 + 1 AS names FROM part),
c AS (SELECT *, count(*) OVER (PARTITION BY tier, canonical) > 1 AS collide FROM n)
SELECT file, canonical <> file AS mismatch, canonical <> file AND names > 1 AS split, collide FROM c""")
def naming_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test files whose name is not what their tests are about, that are about several things, or that share a name."""
    k = F.col("p_partkey")
    about = F.when(k % 7 == 0, k).otherwise(F.floor(k / 3))
    n = table(spark, sf_dir, "part").select(F.concat(F.lit("test_"), k).alias("file"), F.col("p_type").alias("tier"), F.concat(F.lit("test_"), about).alias("canonical"), (F.col("p_size") % 3 + 1).alias("names"))
    other = F.col("canonical") != F.col("file")
    return n.select("file", other.alias("mismatch"), (other & (F.col("names") > 1)).alias("split"), (F.count("*").over(Window.partitionBy("tier", "canonical")) > 1).alias("collide"))


@query("SELECT concat('tests/test_c', c_custkey, '.py') AS path, 'test_always' AS name FROM customer WHERE c_custkey % 5 = 0")
def tests_without_package_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests whose calls name nothing that the package defines."""
    from corpusmill.sources import python_source as P

    v = P.views(cut_lineage(P.parse_modules(sources(spark, sf_dir))))
    package = v["definitions"].where("path like 'src/%'").select(F.col("name").alias("symbol")).distinct()
    inside = v["definitions"].where("path like 'tests/%' and name like 'test_%'").alias("d")
    c = v["calls"].alias("c")
    uses = inside.join(c, (F.col("c.path") == F.col("d.path")) & F.col("c.pos").between(F.col("d.start"), F.col("d.end"))).select(F.col("d.path").alias("path"), F.col("d.name").alias("name"), F.col("c.symbol").alias("symbol"))
    return inside.select("path", "name").join(uses.join(package, "symbol", "left_semi"), ["path", "name"], "left_anti")


@query(COMPONENTS + """, m AS (SELECT component AS cluster, count(*) AS size FROM c GROUP BY 1), s AS (SELECT c.component AS cluster, max(score) AS best FROM p JOIN c ON c.node = p.i GROUP BY 1)
SELECT cluster, size, round(best, 6) AS best, (SELECT count(*) FROM m) AS total FROM m JOIN s USING (cluster) WHERE size <= 50 AND cluster NOT IN (SELECT min(cluster) FROM m) ORDER BY s.best DESC, cluster LIMIT 30""")
def cluster_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest clusters that are not waived (here: the first is), with how many there are in all."""
    from corpusmill.operators import similarity as M
    from corpusmill.operators.graph import connected_components

    p = pairs(spark, sf_dir)
    c = connected_components(p, "i", "j")
    sizes = c.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("size"))
    facts = sizes.agg(F.count("*").alias("total"), F.min("cluster").alias("waived"))
    best = p.join(c, p.i == c.node).groupBy(F.col("component").alias("cluster")).agg(F.max("score").alias("best"))
    found = sizes.where(F.col("size") <= M.MAX_CLUSTER).join(best, "cluster").crossJoin(F.broadcast(facts)).where("cluster <> waived")
    return found.orderBy(F.desc("best"), "cluster").limit(30).select("cluster", "size", F.round("best", 6).alias("best"), "total")


@query("""WITH n AS (SELECT p_size AS g, CASE WHEN p_size % 5 = 0 AND p_partkey % 3 = 0 THEN concat('c', p_partkey) ELSE concat(CASE WHEN p_size % 2 = 0 THEN 'shop' ELSE concat('a', p_partkey % 2) END, '.m', p_partkey) END AS name FROM part),
w AS (SELECT name, min(split_part(name, '.', 1)) OVER g = max(split_part(name, '.', 1)) OVER g AND bool_and(contains(name, '.')) OVER g AS shared FROM n WINDOW g AS (PARTITION BY g))
SELECT name, CASE WHEN shared THEN regexp_replace(name, '^[^.]*\\.', '') ELSE name END AS short FROM w""")
def stripped_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first segment is dropped where all names of a group share it."""
    k, size = F.col("p_partkey"), F.col("p_size")
    lead = F.when(size % 2 == 0, "shop").otherwise(F.concat(F.lit("a"), k % 2))
    n = table(spark, sf_dir, "part").select(size.alias("g"), F.when((size % 5 == 0) & (k % 3 == 0), F.concat(F.lit("c"), k)).otherwise(F.concat(lead, F.lit(".m"), k)).alias("name"))
    w = Window.partitionBy("g")
    first = F.substring_index("name", ".", 1)
    shared = (F.min(first).over(w) == F.max(first).over(w)) & F.every(F.contains("name", F.lit("."))).over(w)
    return n.select("name", F.when(shared, F.regexp_replace("name", "^[^.]*\\.", "")).otherwise(F.col("name")).alias("short"))


@query("SELECT r_name AS name, rpad(r_name, 12, ' ') || '| ' || lpad(CAST(n AS VARCHAR), 4, ' ') AS line FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON n_regionkey = r_regionkey")
def aligned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "region").join(n, "r_regionkey").select(F.col("r_name").alias("name"), F.concat(F.rpad("r_name", 12, " "), F.lit("| "), F.lpad(F.col("n").cast("string"), 4, " ")).alias("line"))
