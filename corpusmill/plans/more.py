"""Further code queries: workspaces, test mapping, context, rendering, snapshots; and the stream extension."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.operators import code as C
from corpusmill.plans.code import TOP
from corpusmill.plans.corpus import BROKEN, docs, facts, named, sources, views
from corpusmill.plans.registry import QUERIES, query, values
from corpusmill.session import ensure_checkpoint_dir, table
from corpusmill.sources.logs import line_slice
from corpusmill.streaming import events as E

HEADER = f"""h_ AS (SELECT m, path, CASE WHEN broken THEN 'def broken(:' ELSE concat(chr(34), chr(34), chr(34), 'Module ', m, '.', chr(34), chr(34), chr(34), chr(10),
  CASE m % 4 WHEN 0 THEN 'import json' WHEN 1 THEN concat('from p', t % 5, '.m', t, ' import ', {named('8 * t + 1')}, ', ', {named('8 * t + 2')}) WHEN 2 THEN concat('from . import m', t) ELSE concat('from .m', t, ' import ', {named('8 * t + 1')}) END, chr(10),
  CASE m % 3 WHEN 0 THEN concat('__all__ = ["', {named('8 * m + 1')}, '", "', {named('8 * m + 2')}, '", "', {named('8 * t + 1')}, '"]') WHEN 1 THEN '__all__ = []' ELSE concat('LIMIT', m, ': int = ', m) END) END AS text FROM mods_
  UNION ALL SELECT m, path, concat('from p', m % 5, '.m', m, ' import ', {named('8 * m + 1')}, chr(10), chr(10)) FROM tests_)"""


@query(facts("functions", "classes") + f", {TOP} SELECT name, module, CASE WHEN starts_with(name, 'C') THEN 'class' ELSE 'function' END AS kind FROM s_ WHERE name IN ('h3', 'C8')")
def inspect_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    f = v["functions"].where("class_name is null").select("name", "module", F.lit("function").alias("kind"))
    return f.unionByName(v["classes"].select("name", "module", F.lit("class").alias("kind"))).where("name in ('h3', 'C8')")


@query(facts("mods", "tests") + f", {HEADER} SELECT path, text FROM h_")
def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_slice(sources(spark, sf_dir), 1, 3)


@query(facts("tests") + f"SELECT path, true AS direct FROM tests_ WHERE contains(concat({named('8 * m + 1')}, ' ', {named('8 * m + 5')}), 'f17') UNION ALL SELECT path, false FROM tests_ WHERE m = 4")
def tests_of_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test files that name a symbol (any test of f17...), and those of a symbol that none names, found by their import of its module."""
    t = sources(spark, sf_dir).where("path like 'tests/%'")
    direct = C.tests_naming(t, "f17", "p2.m2").select("path", F.lit(True).alias("direct"))
    return direct.unionByName(C.tests_naming(t, "never_named", "p4.m4").select("path", F.lit(False).alias("direct")))


@query(facts("imports") + "SELECT DISTINCT module FROM imports_ WHERE NOT is_relative AND list_contains(names, 'f1')")
def importers_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that import the exported symbol by an absolute import."""
    i = views(spark, sf_dir)["imports"]
    return i.where(F.array_contains("names", "f1") & ~F.col("is_relative")).select("module").distinct()


@query(facts("imports", "modules") + """, i AS (SELECT split_part(module, '.', 1) AS src, split_part(target, '.', 1) AS dst, target FROM imports_ WHERE NOT is_relative)
SELECT src, dst, CASE WHEN target IN (SELECT module FROM modules_) THEN target ELSE dst END AS target FROM i WHERE src <> dst AND dst IN (SELECT split_part(module, '.', 1) FROM modules_)""")
def cross_package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of other packages, resolved to the submodule if there is one, else to the package."""
    return C.package_edges(views(spark, sf_dir))


@query("SELECT DISTINCT concat('p', p_partkey % 5) AS src, concat('p', p_size % 9) AS dst FROM part WHERE p_size % 9 < 5 AND p_partkey % 5 <> p_size % 9")
def declared_package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared dependencies on other packages of the workspace; those on anything else are left out."""
    p = table(spark, sf_dir, "part")
    d = p.select(F.concat(F.lit("p"), F.col("p_partkey") % 5).alias("src"), F.concat(F.lit("p"), F.col("p_size") % 9).alias("dst")).distinct()
    members = d.select(F.col("src").alias("dst")).distinct()
    return d.join(members, "dst", "left_semi").where("src <> dst").select("src", "dst")


@query(facts("modules", "functions", "classes") + """
SELECT split_part(module, '.', 1) AS package, count(*) AS modules, CAST(sum(coalesce(f, 0)) AS BIGINT) AS functions, CAST(sum(coalesce(c, 0)) AS BIGINT) AS classes FROM modules_
LEFT JOIN (SELECT module, count(*) AS f FROM functions_ WHERE class_name IS NULL GROUP BY 1) USING (module) LEFT JOIN (SELECT module, count(*) AS c FROM classes_ GROUP BY 1) USING (module) GROUP BY 1""")
def workspace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = C.describe(views(spark, sf_dir), "toc")
    return toc.groupBy(F.substring_index("module", ".", 1).alias("package")).agg(F.count("*").alias("modules"), F.sum("functions").alias("functions"), F.sum("classes").alias("classes"))


STACK = [("metal", ["bolt", "rod"]), ("round", ["ring", "gear", "widget"]), ("size", ["small", "large"])]


@query(f"""WITH {values('k', ['i', 'category', 'name'], [(i, c, n) for i, (c, ns) in enumerate(STACK) for n in ns])}, d AS (SELECT DISTINCT replace(p_name, ' ', '-') AS dep FROM part UNION SELECT string_split(p_name, ' ')[-1] FROM part),
f AS (SELECT dep, min_by(category, i) AS category FROM d JOIN k ON starts_with(dep, k.name) GROUP BY 1) SELECT category, list_sort(list(dep)) AS deps FROM f GROUP BY 1""", lists=("deps",))
def dependency_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first category whose known name equals or begins the dependency."""
    known = spark.createDataFrame([(i, c, n) for i, (c, ns) in enumerate(STACK) for n in ns], "k int, category string, name string")
    p = table(spark, sf_dir, "part")
    deps = p.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("dep")).unionByName(p.select(F.substring_index("p_name", " ", -1).alias("dep"))).distinct()
    first = deps.join(F.broadcast(known), F.startswith("dep", "name")).groupBy("dep").agg(F.min_by("category", "k").alias("category"))  # a handful of names
    return first.groupBy("category").agg(F.array_sort(F.collect_list("dep")).alias("deps"))


@query(facts("mods") + """, t AS (SELECT concat('test_m', o_custkey) AS name, o_orderstatus AS tier FROM orders)
SELECT name, tier, count(*) AS n FROM t WHERE tier <> 'F' AND name IN (SELECT concat('test_m', m) FROM mods_) GROUP BY 1, 2""")
def scenario_named_like_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integration and end-to-end tests named after a source module."""
    t = table(spark, sf_dir, "orders").select(F.concat(F.lit("test_m"), "o_custkey").alias("name"), F.col("o_orderstatus").alias("tier"))
    stem = F.regexp_extract("path", r"([^/]+)\.py$", 1)
    m = sources(spark, sf_dir).where("path like 'src/%'").select(F.concat(F.lit("test_"), F.regexp_replace(stem, "^_+", "")).alias("name"))
    return t.where("tier <> 'F'").join(m, "name", "left_semi").groupBy("name", "tier").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderpriority AS rule_id, o_totalprice > 1000 AS passed, CAST(floor(o_totalprice / 6000) AS INTEGER) AS score FROM orders)
SELECT rule_id, score, count(*) AS n FROM c WHERE passed AND score < 100 GROUP BY 1, 2""")
def improvable_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rule_id"), (F.col("o_totalprice") > 1000).alias("passed"), F.floor(F.col("o_totalprice") / 6000).cast("int").alias("score"))
    return c.where("passed and score < 100").groupBy("rule_id", "score").agg(F.count("*").alias("n"))


@query(facts("modules", "functions", "classes") + f""", {TOP}, r AS (SELECT module, count(*) * 0.5 AS weight FROM s_ GROUP BY 1)
SELECT module, weight FROM r ORDER BY weight DESC, module LIMIT 5""", doubles=("weight",))
def top_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    s = v["functions"].where("class_name is null").select("module").unionByName(v["classes"].select("module"))
    return s.groupBy("module").agg((F.count("*") * 0.5).alias("weight")).orderBy(F.desc("weight"), "module").limit(5)


@query(facts("modules") + ", n AS (SELECT count(*) AS n FROM modules_) SELECT module AS line, CAST(row_number() OVER (ORDER BY module) AS INTEGER) AS place FROM modules_ QUALIFY row_number() OVER (ORDER BY module) <= 4 UNION ALL SELECT '… ' || CAST(n - 4 AS VARCHAR) || ' more', 5 FROM n")
def listing_with_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views(spark, sf_dir)["modules"].select("module").orderBy("module")
    shown = m.limit(4).withColumn("place", F.row_number().over(Window.orderBy("module")))
    rest = m.agg(F.concat(F.lit("… "), (F.count("*") - 4).cast("string"), F.lit(" more")).alias("line")).select("line", F.lit(5).alias("place"))
    return shown.select(F.col("module").alias("line"), "place").unionByName(rest)


@query(facts("imports", "functions", "classes") + f"""
, {TOP}, i AS (SELECT module, unnest(names) AS name FROM imports_) SELECT i.module, i.name, d.module AS home FROM i JOIN s_ d USING (name) WHERE i.module <> d.module""")
def import_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an imported name is defined, one re-export followed."""
    v = views(spark, sf_dir)
    i = v["imports"].select("module", F.explode("names").alias("name"))
    d = v["functions"].where("class_name is null").select(F.col("module").alias("home"), "name").unionByName(v["classes"].select(F.col("module").alias("home"), "name"))
    return i.join(d, "name").where("module <> home").select("module", "name", "home")


@query(facts("functions") + f"""
, b AS (SELECT module, name, signature FROM functions_ WHERE class_name IS NULL),
h AS (SELECT module, name, CASE WHEN contains(signature, 'list[') THEN replace(signature, ' -> str', ' -> bytes') ELSE signature END AS signature FROM b WHERE NOT starts_with(name, '_') UNION ALL SELECT concat('p', m % 5, '.m', m), concat('fresh', m), 'def fresh()' FROM (SELECT DISTINCT m FROM base_ WHERE m % 9 = 0 AND NOT {BROKEN}))
SELECT * FROM (SELECT coalesce(b.module, h.module) AS module, coalesce(b.name, h.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN h.name IS NULL THEN 'removed' WHEN b.signature <> h.signature THEN 'modified' END AS change FROM b FULL JOIN h ON b.module = h.module AND b.name = h.name) WHERE change IS NOT NULL""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of one source tree, as a scan of each would give them: in the second, files are edited and parsed again."""
    from corpusmill.sources import python_source as P

    files = sources(spark, sf_dir)
    text = F.regexp_replace(F.regexp_replace("text", r"(?m)^(def f\d+\(a: list\[.*) -> str:", "$1 -> bytes:"), r"(?m)^def _f", "class _F:\n  def f")
    m = F.regexp_extract("path", r"^src/p\d+/m(\d+)\.py$", 1).try_cast("int")
    text = F.when((m % 9 == 0) & (m % 50 != 49), F.concat(text, F.lit("\n\ndef fresh"), m, F.lit("():\n    pass\n"))).otherwise(text)
    top = lambda f: P.views(P.parse_modules(f))["functions"].where("class_name is null").select("module", "name", "signature")
    fresh = F.when(F.startswith("name", F.lit("fresh")), "def fresh()").otherwise(F.col("signature"))
    return C.structural_diff(top(files), top(files.withColumn("text", text)).withColumn("signature", fresh), ["module", "name"], "signature").select("module", "name", "change")


@query("""WITH e AS (SELECT r_name AS src, n_name AS dst FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT 'graph TD' || chr(10) || string_agg('  ' || src || ' --> ' || dst, chr(10) ORDER BY src, dst) AS text, '[' || string_agg('{"src":"' || src || '","dst":"' || dst || '"}', ',' ORDER BY src, dst) || ']' AS json FROM e""")
def rendered_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    rows = F.array_sort(F.collect_list(F.struct("src", "dst")))  # a rendered graph is one text, whatever its size
    lines = F.transform(rows, lambda x: F.concat(F.lit("  "), x["src"], F.lit(" --> "), x["dst"]))
    return e.agg(F.concat(F.lit("graph TD\n"), F.array_join(lines, "\n")).alias("text"), F.to_json(rows).alias("json"))


@query(facts("docs") + "SELECT path FROM docs_ WHERE contains(path, 'm1') OR contains(path, '2.md')")
def docs_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(F.lower("path").rlike("\\Qm1\\E|\\Q2.md\\E")).select("path")


@query("SELECT l_shipdate AS k, count(*) AS total, count(*) > 40 AS truncated FROM lineitem GROUP BY 1")
def capped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cap of forty would cut, told with the whole count."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("k")).agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > 40)


@query()
def registered_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.plans.tools import discover

    return spark.createDataFrame([(n,) for n in sorted(discover("compaction_*, nothing")) if n in QUERIES], "name string")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT start, event_type, n, total FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the same windows from a stream of files; those the watermark has not closed are not out yet."""
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").select("ts", "event_type", "value").schema
    stream = E.read_stream(spark, sf_dir, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    E.run_once(E.windowed(stream, "ts", ["event_type"], "value"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions by a gap."""
    return E.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "2 hours")
