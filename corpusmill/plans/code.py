"""Code queries over a source tree written from `part`, and over the shared tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import is_test_module
from corpusmill.operators import code as C
from corpusmill.plans.corpus import docs, facts, named, sources, views
from corpusmill.plans.registry import query
from corpusmill.session import cut_lineage, table
from corpusmill.sources import python_source as P

TOP = "s_ AS (SELECT module, name, line_start AS line, docstring FROM functions_ WHERE class_name IS NULL UNION ALL SELECT module, name, line_start, NULL FROM classes_)"


@query(facts("functions") + "SELECT module, class_name, name, kind, signature, line_start, line_end, return_type, docstring FROM functions_", longs=("line_start", "line_end"))
def parse_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views(spark, sf_dir)["functions"]
    return f.select("module", "class_name", "name", "kind", "signature", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "return_type", "docstring")


@query(facts("modules") + "SELECT path, module, error, docstring, all_exports, main_guard_line FROM modules_", lists=("all_exports",), longs=("main_guard_line",))
def parse_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir)["modules"].withColumn("main_guard_line", F.col("main_guard_line").cast("long"))


@query(facts("classes", "variables") + "SELECT module, name, array_to_string(bases, ',') AS value, line_start AS line FROM classes_ UNION ALL SELECT module, name, value_repr, line FROM variables_", longs=("line",))
def parse_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    line = F.col("line").cast("long").alias("line")
    return v["classes"].withColumnRenamed("line_start", "line").select("module", "name", F.array_join("bases", ",").alias("value"), line).unionByName(v["variables"].select("module", "name", F.col("value_repr").alias("value"), line))


@query(facts("imports") + "SELECT module, target, names, is_relative, CAST(level AS BIGINT) AS level FROM imports_", lists=("names",))
def parse_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir)["imports"].select("module", "target", "names", "is_relative", F.col("level").cast("long").alias("level"))


@query(facts("calls") + "SELECT module, symbol, line, context FROM calls_", longs=("line",))
def parse_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir)["calls"].select("module", "symbol", F.col("line").cast("long").alias("line"), "context")


@query(facts("refs") + "SELECT module, name FROM refs_")
def parse_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names used other than by calling them."""
    return views(spark, sf_dir)["refs"].select("module", "name")


@query(facts("modules") + "SELECT path, module FROM modules_ WHERE error IS NULL AND NOT contains(path, 'tests/') AND NOT regexp_matches(path, '(^|/)p3/')")
def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery: Python files outside the folders that are skipped (here tests, and one package), that parse."""
    files = sources(spark, sf_dir)
    return P.parse_modules(files.where(P.is_source(F.col("path"), [*P.SKIPPED_SEGMENTS, "tests", "p3"]))).where("error is null").select("path", "module")


@query("""WITH b AS (SELECT p_partkey AS path, p_size AS modified FROM part WHERE p_partkey % 7 <> 0), a AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS modified FROM part WHERE p_partkey % 5 <> 0)
SELECT CAST(path AS VARCHAR) AS path, CASE WHEN b.modified IS NULL THEN 'added' WHEN a.modified IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN a USING (path) WHERE a.modified IS DISTINCT FROM b.modified""")
def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fingerprints (path, modified) of a source tree: what a cache of it must drop or read again."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").cast("string").alias("path"), F.col("p_size").cast("long").alias("modified"))
    after = p.where("k % 5 <> 0").withColumn("modified", F.col("modified") + (F.col("k") % 11 == 0).cast("int"))
    return P.tree_changes(p.where("k % 7 <> 0"), after)


@query(facts("functions", "classes", "variables") + """
SELECT module, class_name, name, kind AS symbol_kind, line_start AS line FROM functions_ WHERE contains(name, '12') AND NOT contains(coalesce(class_name, ''), '12')
UNION ALL SELECT module, NULL, name, 'class', line_start FROM classes_ WHERE contains(name, '12')
UNION ALL SELECT module, NULL, name, 'variable', line FROM variables_ WHERE contains(name, '12')""", longs=("line",))
def search_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.search(views(spark, sf_dir), name="12"))


def _lines(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns or ("line",)})


@query(facts("functions", "variables") + """
SELECT module, class_name, name, kind AS symbol_kind, line_start AS line FROM functions_
UNION ALL SELECT module, NULL, name, 'variable', line FROM variables_""", longs=("line",))
def search_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a name no class is returned, though its methods are."""
    return _lines(C.search(views(spark, sf_dir)))


@query(facts("functions") + """
SELECT module, class_name, name, kind AS symbol_kind, line_start AS line FROM functions_ WHERE contains(return_type, 'C1') AND (contains(name, 'C1') OR contains(coalesce(class_name, ''), 'C1'))""", longs=("line",))
def search_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.search(views(spark, sf_dir), name="C1", returns="C1"))


@query(facts("functions") + "SELECT module, class_name, name, kind AS symbol_kind, line_start AS line FROM functions_ WHERE kind = 'property'", longs=("line",))
def search_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.search(views(spark, sf_dir), kind="property"))


@query(facts("classes") + "SELECT module, CAST(NULL AS VARCHAR) AS class_name, name, 'class' AS symbol_kind, line_start AS line FROM classes_ WHERE list_contains(bases, 'Outside')", longs=("line",))
def search_inherits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.search(views(spark, sf_dir), inherits="Outside", returns="ignored"))


@query(facts("variables") + "SELECT module, CAST(NULL AS VARCHAR) AS class_name, name, 'variable' AS symbol_kind, line FROM variables_ WHERE contains(name, 'LIMIT')", longs=("line",))
def search_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.search(views(spark, sf_dir), name="LIMIT", kind="variable"))


@query(facts("modules") + "SELECT path, module FROM modules_ WHERE contains(lower(module), 'm1') OR contains(lower(module), 'p2.')")
def module_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filter_modules(views(spark, sf_dir)["modules"], ["M1", "p2."]).select("path", "module")


@query(facts("modules", "functions", "classes") + """
SELECT module, coalesce(f, 0) AS functions, coalesce(c, 0) AS classes, coalesce(len(all_exports), -1) AS exports FROM modules_
LEFT JOIN (SELECT module, count(*) AS f FROM functions_ WHERE class_name IS NULL GROUP BY 1) USING (module) LEFT JOIN (SELECT module, count(*) AS c FROM classes_ GROUP BY 1) USING (module)""", longs=("exports",))
def describe_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.describe(views(spark, sf_dir), "toc"), "exports")


SHOWN = "CASE WHEN all_exports IS NULL THEN NOT starts_with(name, '_') ELSE list_contains(all_exports, name) END"


@query(facts("modules", "functions") + f"SELECT f.module, signature, line_start FROM functions_ f JOIN modules_ m USING (module) WHERE class_name IS NULL AND {SHOWN}", longs=("line_start",))
def describe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.describe(views(spark, sf_dir), "summary"), "line_start")


@query(facts("modules", "functions") + f"SELECT f.module, signature, line_start, line_end, f.docstring, len(annotations) AS n_params, decorators FROM functions_ f JOIN modules_ m USING (module) WHERE class_name IS NULL AND {SHOWN}", lists=("decorators",), longs=("line_start", "line_end", "n_params"))
def describe_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.describe(views(spark, sf_dir), "detailed"), "line_start", "line_end", "n_params")


def _symbols(spark: SparkSession, *names: str, column: str = "name") -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


@query(facts("calls") + "SELECT symbol AS name, module, line, context FROM calls_ WHERE symbol IN ('f1', 'h3', 'C8')", longs=("line",))
def callers_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.callers(views(spark, sf_dir), _symbols(spark, "f1", "h3", "C8")).select("name", "module", "line", "context"))


@query(facts("calls") + "SELECT symbol AS name, split_part(module, '.', 1) || '::' || module AS module, line FROM calls_ WHERE symbol IN ('f1', 'h3', 'C8')", longs=("line",))
def callers_in_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.workspace_callers(views(spark, sf_dir), _symbols(spark, "f1", "h3", "C8")).select("name", "module", "line"))


TYPE_USES = r"""t_ AS (SELECT CASE WHEN class_name IS NULL THEN name ELSE class_name || '.' || name END AS function, module, line_start AS line,
  CASE WHEN len(list_filter(annotations, lambda a: regexp_matches(a, '(^|[^\w.])C8($|[^\w.])'))) > 0 THEN 'param' WHEN regexp_matches(return_type, '(^|[^\w.])C8($|[^\w.])') THEN 'return' END AS ref_type FROM functions_
  UNION ALL SELECT name, module, line, CASE WHEN regexp_matches(coalesce(annotation, '') || ' ' || coalesce(value_repr, ''), '(^|[^\w.])C8($|[^\w.])') THEN 'alias' END FROM variables_)"""


@query(facts("functions", "variables") + f", {TYPE_USES} SELECT * FROM t_ WHERE ref_type IS NOT NULL", longs=("line",))
def type_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.type_refs(views(spark, sf_dir), "C8"))


@query(facts("calls", "refs") + r"""
, c AS (SELECT module, regexp_matches(module, '(^|\.)(tests($|\.)|test_)') AS test FROM calls_ WHERE symbol LIKE 'f1%'), r AS (SELECT module, regexp_matches(module, '(^|\.)(tests($|\.)|test_)') AS test FROM refs_ WHERE name = 'a')
SELECT 'all' AS mode, (SELECT count(*) FROM c) AS callers, (SELECT count(*) FROM r) AS uses UNION ALL SELECT 'none', (SELECT count(*) FROM c WHERE NOT test), (SELECT count(*) FROM r WHERE NOT test)
UNION ALL SELECT 'related', (SELECT count(*) FROM c), (SELECT count(*) FROM r WHERE NOT test) UNION ALL SELECT 'flag', (SELECT count(*) FROM c WHERE NOT test), (SELECT count(*) FROM r WHERE NOT test)""")
def test_filter_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many callers and uses each mode leaves: none, all, related, and the flag alone."""
    v = views(spark, sf_dir)
    calls, uses = v["calls"].where("symbol like 'f1%'"), v["refs"].where("name = 'a'")
    out = None
    for name, mode, flag in (("all", "all", True), ("none", "none", False), ("related", "related", False), ("flag", None, True)):
        c, u = C.filter_tests(calls, uses, mode, flag)
        one = c.agg(F.count("*").alias("callers")).crossJoin(u.agg(F.count("*").alias("uses"))).select(F.lit(name).alias("mode"), "callers", "uses")
        out = one if out is None else out.unionByName(one)
    return out


@query(facts("imports") + "SELECT module, target, coalesce(target = 'json', false) AS outside FROM imports_ WHERE target IS NOT NULL")
def standard_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which imports reach the language's own library."""
    return views(spark, sf_dir)["imports"].where("target is not null").select("module", "target", C.is_outside(F.col("target")).alias("outside"))


@query(facts("imports") + "SELECT path, names FROM imports_ WHERE target = 'p0.m0' AND NOT is_relative AND list_has_any(names, ['f1', 'f9'])", lists=("names",))
def move_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to be changed if two names of a module move elsewhere."""
    return C.move_callers(sources(spark, sf_dir), "p0.m0", ["f1", "f2", "f9"])


@query(facts("modules", "functions", "classes") + f"""
, c AS (SELECT module, name, 'function' AS kind, signature, docstring AS doc_first_line FROM functions_ WHERE class_name IS NULL UNION ALL SELECT c.module, c.name, 'class', concat('class ', c.name, '(', array_to_string(bases, ', '), ')'), concat(p_name, ' keeper.') FROM classes_ c JOIN base_ ON j = 0 AND c.name = concat('C', k))
SELECT module || '.' || name AS qualname, kind, signature, doc_first_line FROM c JOIN modules_ USING (module) WHERE error IS NULL AND NOT starts_with(modules_.path, 'tests/') AND {SHOWN}""")
def symbol_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public functions and classes outside tests, as similarity takes them."""
    return C.symbol_corpus(views(spark, sf_dir), ["tests"])


@query(facts("inside") + "SELECT module, name, callee, line FROM inside_", longs=("line",))
def callees_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.callees(views(spark, sf_dir)).select("module", "name", "callee", "line").distinct())


@query(facts("imports", "modules") + """
, e AS (SELECT module AS src, CASE WHEN NOT is_relative THEN target WHEN target IS NULL THEN split_part(module, '.', 1) || '.' || names[1] ELSE split_part(module, '.', 1) || '.' || target END AS dst FROM imports_)
SELECT src, dst FROM e WHERE dst IN (SELECT module FROM modules_) AND src <> dst""")
def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.import_edges(views(spark, sf_dir))


@query(facts("functions") + "SELECT module, class_name, name, line_start AS line FROM functions_ WHERE class_name = 'C8' AND name = 'run'", longs=("line",))
def definition_dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.definition(views(spark, sf_dir), "C8.run"))


@query(facts("functions", "classes") + f", {TOP} SELECT module, CAST(NULL AS VARCHAR) AS class_name, name, line FROM s_ WHERE name = 'f9'", longs=("line",))
def definition_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.definition(views(spark, sf_dir), "f9"))


@query(facts("modules", "imports", "functions", "classes") + f"""
, {TOP} SELECT DISTINCT module FROM (SELECT module FROM modules_ WHERE list_contains(all_exports, 'f1') UNION ALL SELECT module FROM imports_ WHERE list_contains(names, 'f1')) WHERE module NOT IN (SELECT module FROM s_ WHERE name = 'f1')""")
def reexports_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reexports(views(spark, sf_dir), "f1")


ENTRIES = """e_ AS (SELECT name, module, CASE WHEN starts_with(name, 'test_') THEN 'test' ELSE 'decorator' END AS kind, CASE WHEN starts_with(name, 'test_') THEN 'pytest' ELSE 'cyclopts' END AS framework, line_start AS line
FROM functions_ WHERE starts_with(name, 'test_') OR list_contains(decorators, 'app.command')
UNION ALL SELECT '__main__', module, 'main_guard', 'main', main_guard_line FROM modules_ WHERE main_guard_line IS NOT NULL
UNION ALL SELECT x.name, x.module, 'export', 'all', coalesce(d.line, 0) FROM (SELECT module, unnest(all_exports) AS name FROM modules_) x LEFT JOIN s_ d ON d.module = x.module AND d.name = x.name)"""


@query(facts("functions", "modules", "classes") + f", {TOP}, {ENTRIES} SELECT * FROM e_", longs=("line",))
def find_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.entry_points(views(spark, sf_dir)))


@query(facts("functions", "modules", "classes", "calls", "refs", "imports") + f"""
, {TOP}, {ENTRIES}, n AS (SELECT unnest(names) AS name FROM imports_),
used AS (SELECT symbol AS name FROM calls_ UNION SELECT name FROM refs_ UNION SELECT name FROM e_ UNION SELECT name FROM n WHERE name NOT IN (SELECT split_part(module, '.', -1) FROM modules_)),
spaces AS (SELECT module FROM modules_ WHERE split_part(module, '.', -1) IN (SELECT unnest(names) FROM imports_ WHERE target IS NULL OR target <> names[1] UNION SELECT split_part(target, '.', -1) FROM imports_ WHERE target = names[1])),
x AS (SELECT module, unnest(all_exports) AS name FROM modules_), b AS (SELECT module, name AS class_name, unnest(bases) AS base FROM classes_),
alive AS (SELECT f.module, f.class_name, f.name FROM functions_ f JOIN b USING (module, class_name) WHERE base NOT IN (SELECT name FROM classes_) AND NOT starts_with(f.name, '_')
  UNION SELECT f.module, f.class_name, f.name FROM functions_ f JOIN b USING (module, class_name) JOIN functions_ o ON o.class_name = b.base AND o.name = f.name WHERE f.name IN (SELECT symbol FROM calls_))
SELECT module, class_name, name, CASE WHEN class_name IS NULL THEN 'function' ELSE 'method' END AS kind FROM functions_ f
WHERE NOT starts_with(module, 'tests.') AND len(decorators) = 0 AND name NOT IN (SELECT name FROM used) AND (module, name) NOT IN (SELECT (module, name) FROM x)
  AND (class_name IS NOT NULL OR starts_with(name, '_') OR module NOT IN (SELECT module FROM spaces))
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.module = f.module AND b.class_name = f.class_name AND base = 'Protocol')
  AND NOT EXISTS (SELECT 1 FROM alive a WHERE a.module = f.module AND a.class_name = f.class_name AND a.name = f.name)
UNION ALL SELECT module, NULL, name, 'class' FROM classes_ WHERE name NOT IN (SELECT name FROM used) AND name NOT IN (SELECT base FROM b) AND NOT list_contains(bases, 'Protocol') AND (module, name) NOT IN (SELECT (module, name) FROM x)""")
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dead_symbols(views(spark, sf_dir)).select("module", "class_name", "name", "kind")


@query("""
WITH b AS (SELECT o_custkey AS k, min(o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), h AS (SELECT o_custkey AS k, max(o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT * FROM (SELECT coalesce(b.k, h.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN h.k IS NULL THEN 'removed' WHEN b.s IS DISTINCT FROM h.s THEN 'modified' END AS change, b.s AS before, h.s AS after FROM b FULL JOIN h ON b.k = h.k) WHERE change IS NOT NULL""")
def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    base = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.min("o_orderpriority").alias("s"))
    head = o.where("o_orderstatus = 'O'").groupBy("k").agg(F.max("o_orderpriority").alias("s"))
    return C.structural_diff(base, head, ["k"], "s")


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE contains(p_name, 'ring') AND p_brand = 'Brand#17' AND p_size > 10")
def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.where(F.contains("p_name", F.lit("ring")) & (F.col("p_brand") == "Brand#17") & (F.col("p_size") > 10)).select("p_partkey", "p_name", "p_brand", "p_size")


@query("SELECT o_orderkey AS symbol, l_suppkey AS module, l_linenumber AS line, CASE WHEN l_discount > 0.05 THEN 0.5 ELSE 1.0 END AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'", doubles=("confidence",))
def callers_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    li = table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_orderkey").alias("symbol"), F.col("l_suppkey").alias("module"), F.col("l_linenumber").alias("line"), F.when(F.col("l_discount") > 0.05, 0.5).otherwise(1.0).alias("confidence"))


INTERVALS = """i AS (SELECT user_id, event_id, ts AS first, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events WHERE event_type = 'signup')"""


@query(f"WITH {INTERVALS} SELECT i.event_id AS definition, e.event_id AS call FROM i JOIN events e ON e.user_id = i.user_id AND e.ts >= i.first AND e.ts < i.last AND e.event_type <> 'signup'")
def callees_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    i = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("definition"), F.col("ts").alias("first"), F.lead("ts").over(w).alias("last")).alias("i")
    c = e.where("event_type <> 'signup'").select("user_id", F.col("event_id").alias("call"), "ts").alias("c")
    return i.join(c, (F.col("i.user_id") == F.col("c.user_id")) & (F.col("c.ts") >= F.col("i.first")) & (F.col("c.ts") < F.col("i.last"))).select("definition", "call")


@query("""WITH b AS (SELECT DISTINCT trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark), d AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT DISTINCT doc_id FROM d WHERE line <> '' AND line IN (SELECT line FROM b) AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def reexports_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a line of the benchmark (semi) and are not labelled (anti)."""
    lines = lambda name, *keep: table(spark, sf_dir, name).select(*keep, F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''")
    held = lines("documents", "doc_id").join(lines("benchmark"), "line", "left_semi").select("doc_id").distinct()
    return held.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dead_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT o_custkey AS name FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus <> 'F')")
def stale_forall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers none of whose orders has the status."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.every(F.col("o_orderstatus") != "F").alias("ok")).where("ok").select("name")


@query("""WITH d AS (SELECT doc_id FROM documents WHERE lang <> 'es'), l AS (SELECT DISTINCT doc_id FROM labels)
SELECT CAST(coalesce(d.doc_id, l.doc_id) AS VARCHAR) AS name, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'orphan' END AS problem FROM d FULL JOIN l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def mirror_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("doc_id").cast("string").alias("name")
    return C.mirror(table(spark, sf_dir, "documents").where("lang <> 'es'").select(name), table(spark, sf_dir, "labels").select(name).distinct())


@query(facts("modules") + """
, m AS (SELECT split_part(module, '.', -1) AS name FROM modules_ WHERE starts_with(path, 'src/')), t AS (SELECT replace(split_part(module, '.', -1), 'test_', '') AS name FROM modules_ WHERE starts_with(path, 'tests/'))
SELECT name, 'missing' AS problem FROM m WHERE name NOT IN (SELECT name FROM t) UNION ALL SELECT 'test_' || name, 'orphan' FROM t WHERE name NOT IN (SELECT name FROM m)""")
def test_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views(spark, sf_dir)["modules"].withColumn("name", F.regexp_extract("path", r"([^/]+)\.py$", 1))
    return C.mirror(m.where("path like 'src/%' and name <> '__init__'"), m.where("path like 'tests/%'"))


MARKED = f"""t_ AS (SELECT path, 3 AS line, {named('8 * m + 3')} AS stretch, false AS heading FROM docs_ UNION ALL SELECT path, 1, concat('Module m', m), true FROM docs_
 UNION ALL SELECT path, unnest([6, 13]), concat({named('8 * m + 5')}, ' and more'), true FROM docs_),
r_ AS (SELECT DISTINCT s.name AS symbol, path, line FROM t_ JOIN (SELECT DISTINCT name FROM s_) s ON CASE WHEN heading THEN contains(lower(stretch), lower(s.name)) ELSE contains(stretch, s.name) END)"""


@query(facts("docs", "functions", "classes") + f", {TOP}, {MARKED} SELECT * FROM r_", longs=("line",))
def doc_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.doc_refs(docs(spark, sf_dir), _defined(spark, sf_dir)))


def _defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of functions outside classes and of classes: one parse, of which only the names are kept."""
    m = P.parse_modules(sources(spark, sf_dir))
    names = F.concat(F.transform(F.filter("functions", lambda f: f["class_name"].isNull()), lambda f: f["name"]), F.transform("classes", lambda c: c["name"]))
    return cut_lineage(m.select(F.explode(names).alias("symbol")).distinct())


@query(facts("docs", "functions", "classes") + f", {TOP}, {MARKED} SELECT DISTINCT name AS symbol FROM s_ WHERE name NOT IN (SELECT symbol FROM r_)")
def undocumented_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.undocumented(docs(spark, sf_dir), _defined(spark, sf_dir))


@query(facts("docs", "functions") + f"""
SELECT {named('8 * m + 1')} AS name, path, 9 AS line, concat('def ', {named('8 * m + 1')}, '(a: C', 8 * m, ', b = -1) -> str') AS doc_sig FROM docs_ WHERE m % 8 = 4 AND {named('8 * m + 1')} IN (SELECT name FROM functions_)""", longs=("line",))
def stale_doc_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.stale_signatures(docs(spark, sf_dir), views(spark, sf_dir)["functions"].select("name", "signature")))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
h AS (SELECT doc_id AS path, CAST(line AS INTEGER) AS line, line_text FROM l WHERE contains(line_text, 'token'))
SELECT *, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 5 AS truncated FROM h ORDER BY path, line LIMIT 5""")
def grep_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.grep(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"), "token", cap=5)


@query(facts("calls") + """SELECT CASE WHEN NOT contains(f, 'test') THEN 'production' WHEN contains(f, 'm2') THEN 'test_direct' ELSE 'test_indirect' END AS kind, path, list_sort(list(DISTINCT line)) AS lines
FROM (SELECT *, string_split(path, '/')[-1] AS f FROM calls_ WHERE starts_with(symbol, 'f1')) GROUP BY 1, 2""", lists=("lines",))
def caller_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify_callers(views(spark, sf_dir)["calls"].where("startswith(symbol, 'f1')"), "p2.m2")


@query(facts("classes", "functions") + """SELECT c.module, c.name, line_end - line_start + 1 AS n_lines, coalesce(n, 0) AS n_methods FROM classes_ c LEFT JOIN (SELECT module, class_name AS name, count(*) AS n FROM functions_ WHERE class_name IS NOT NULL GROUP BY 1, 2) f USING (module, name)
WHERE line_end - line_start + 1 > 13 OR coalesce(n, 0) > 3""", longs=("n_lines",))
def god_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(C.god_classes(views(spark, sf_dir), 13, 3), "n_lines")


@query(facts("modules") + r"SELECT module, regexp_matches(module, '(^|\.)(tests($|\.)|test_)') AS test FROM modules_")
def test_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir)["modules"].select("module", is_test_module(F.col("module")).alias("test"))
