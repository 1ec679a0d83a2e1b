"""Audit rules over sources written from shared tables, governance checks over projects' files, and extensions on the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import score as S
from corpusmill.operators import governance as V
from corpusmill.plans.registry import query
from corpusmill.session import cut_lineage, release, table
from corpusmill.sources import python_rules as R

Q = "concat(chr(34), chr(34), chr(34))"


def _files(spark: SparkSession, sf_dir: str, path: str, text: str, where: str = "true", name: str = "customer", key: str = "c_custkey") -> DataFrame:
    """(path, text) from expressions over k, the key of a table."""
    return table(spark, sf_dir, name).selectExpr("*", f"{key} AS k").where(where).selectExpr(f"{path} AS path", f"{text} AS text")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module and, for some, a test file a customer, each with the faults that its key decides."""
    body = r"""concat('import time, requests\n\n\nasync def wait(t):\n    ', CASE WHEN k % 2 = 0 THEN 'time.sleep(1)' ELSE 'pass' END, '\n    try:\n        requests.get("u"', CASE WHEN k % 3 = 0 THEN '' ELSE ', timeout=1' END, ')\n    except', CASE WHEN k % 4 = 0 THEN '' ELSE ' ValueError' END, ':\n        pass\n')"""
    tests = r"""concat('from r.c', k, ' import ', CASE WHEN k % 2 = 0 THEN '_hidden' ELSE 'LIMIT, __version__' END, '\n\n\ndef test_always():\n    assert ', CASE k % 3 WHEN 0 THEN 'True' WHEN 1 THEN '1 == 1' ELSE 'wait is not None' END, CASE WHEN k % 10 = 0 THEN '\n\n\ndef test_calls():\n    assert wait(1)' ELSE '' END, '\n')"""
    return _files(spark, sf_dir, "concat('src/r/c', k, '.py')", body).unionByName(_files(spark, sf_dir, "concat('tests/test_c', k, '.py')", tests, "k % 5 = 0"))


FOUND = """c AS (SELECT c_custkey AS k, concat('src/r/c', c_custkey, '.py') AS path, concat('tests/test_c', c_custkey, '.py') AS test FROM customer),
f AS (SELECT path, 'PRACTICE_BLOCKING_IO' AS rule_id, 'wait' AS name, 5 AS line, 'sleep in async' AS detail FROM c WHERE k % 2 = 0
 UNION ALL SELECT path, 'PRACTICE_BLOCKING_IO', 'wait', 7, 'no timeout' FROM c WHERE k % 3 = 0
 UNION ALL SELECT path, 'PRACTICE_BARE_EXCEPT', 'wait', 8, 'except without a type' FROM c WHERE k % 4 = 0
 UNION ALL SELECT test, 'TEST_QUALITY_PRIVATE_IMPORTS', '_hidden', 1, concat('r.c', k) FROM c WHERE k % 10 = 0
 UNION ALL SELECT test, 'TEST_QUALITY_TAUTOLOGY', 'test_always', 5, CASE k % 3 WHEN 0 THEN 'constant' ELSE 'compares itself' END FROM c WHERE k % 5 = 0 AND k % 3 < 2)"""


@query(f"WITH {FOUND} SELECT * FROM f", longs=("line",))
def source_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scan_findings(sources(spark, sf_dir)).drop("severity").withColumn("line", F.col("line").cast("long"))


@query(f"""WITH {FOUND}, p(rule_id, penalty) AS (VALUES ('PRACTICE_BLOCKING_IO', 15), ('PRACTICE_BARE_EXCEPT', 20), ('TEST_QUALITY_PRIVATE_IMPORTS', 5), ('TEST_QUALITY_TAUTOLOGY', 2), ('QUALITY_LINT', 2)), w AS (SELECT * FROM f WHERE regexp_matches(path, 'c1?[0-9]\\.py'))
SELECT rule_id, count(path) AS n, CAST(greatest(0, 100 - count(path) * min(penalty)) AS INTEGER) AS score, greatest(0, 100 - count(path) * min(penalty)) >= CASE rule_id WHEN 'QUALITY_LINT' THEN 100 ELSE 90 END AS passed FROM p LEFT JOIN w USING (rule_id) GROUP BY 1""")
def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of one project: the first twenty modules and their tests."""
    rules = spark.createDataFrame([(r,) for r in ("PRACTICE_BLOCKING_IO", "PRACTICE_BARE_EXCEPT", "TEST_QUALITY_PRIVATE_IMPORTS", "TEST_QUALITY_TAUTOLOGY", "QUALITY_LINT")], "rule_id string")
    return S.rule_scores(R.scan_findings(sources(spark, sf_dir).where(F.col("path").rlike(r"c1?[0-9]\.py"))), rules)


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function a part, its conditions nested as deep as the part's size says."""
    text = r"concat('def tangled(a):\n', array_join(transform(sequence(1, p_size % 8 + 1), i -> concat(repeat('    ', i), 'if a', CASE WHEN p_size % 2 = 0 AND i = 1 THEN ' and b or c' ELSE '' END, ':\n')), ''), repeat('    ', p_size % 8 + 2), 'return 1\n')"
    return _files(spark, sf_dir, "concat('src/n', k, '.py')", text, name="part", key="p_partkey")


NESTED = """n AS (SELECT concat('src/n', p_partkey, '.py') AS path, p_size % 8 + 1 AS d, p_size % 2 = 0 AS extra FROM part),
m AS (SELECT path, 1 + d + CASE WHEN extra THEN 2 ELSE 0 END AS cyclomatic, d * (d + 1) // 2 + CASE WHEN extra THEN 2 ELSE 0 END AS cognitive FROM n)"""


@query(f"WITH {NESTED} SELECT path, cyclomatic, cognitive FROM m", longs=("cyclomatic", "cognitive"))
def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested conditions weigh by their depth, chains of boolean operators by their changes."""
    m = R.scan_metrics(_nested(spark, sf_dir))
    return m.select("path", F.col("cyclomatic").cast("long").alias("cyclomatic"), F.col("cognitive").cast("long").alias("cognitive"))


@query(f"WITH {NESTED} SELECT path, CASE WHEN cyclomatic > 10 AND cognitive > 15 THEN 'cc+cog' WHEN cyclomatic > 10 THEN 'cc' ELSE 'cog' END AS reason FROM m WHERE cyclomatic > 10 OR cognitive > 15")
def complexity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.scan_metrics(_nested(spark, sf_dir))
    return m.select("path", R.complexity_reason(F.col("cyclomatic"), F.col("cognitive")).alias("reason")).where("reason is not null")


@query("SELECT p_partkey, greatest(p_size, p_partkey % 60) AS worst FROM part WHERE p_size > 10 OR p_partkey % 60 > 15 ORDER BY 2 DESC, 1 LIMIT 25")
def top_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("cog", F.col("p_partkey") % 60)
    return p.where(R.complexity_reason(F.col("p_size"), F.col("cog")).isNotNull()).select("p_partkey", F.greatest("p_size", "cog").alias("worst")).orderBy(F.desc("worst"), "p_partkey").limit(25)


@query("""WITH c AS (SELECT concat('src/c', p_partkey, '.py') AS copy, p_size, p_brand FROM part), f AS (SELECT p_size, p_brand, min(copy) AS source FROM c GROUP BY 1, 2)
SELECT source, copy FROM c JOIN f USING (p_size, p_brand) WHERE source <> copy""")
def clone_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of six lines and more that are equal but for their docstrings."""
    from corpusmill.operators.aggregate import clone_pairs

    text = rf"""concat('def same{{}}(x):\n', CASE WHEN k % 2 = 0 THEN concat('    ', {Q.replace('chr(34)', "char(34)")}, p_name, {Q.replace('chr(34)', "char(34)")}, '\n') ELSE '' END, '    y = x + ', p_size, '\n    z = "', p_brand, '"\n    if z > 3:\n        z = 3\n    return z\n')""".replace("same{}", "same")
    files = _files(spark, sf_dir, "concat('src/c', k, '.py')", text, name="part", key="p_partkey")
    return clone_pairs(R.scan_metrics(files).where("n_lines >= 6"), F.md5("fingerprint"), "path").select("source", "copy")


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tests a file, one a part: alike but for a statement more in some, with calls and names that others have too."""
    body = r"concat('def test_k', k % 997, '():\n    r = apply(', p_size, ', \"', p_brand, '\")\n', CASE WHEN k % 4 = 3 THEN '    s = [1, 2]\n' ELSE '' END, '    assert r == ', k, '\n')"
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size", "p_brand").selectExpr("CAST(floor(k / 4) AS BIGINT) AS g", "k", f"{body} AS body")
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g")  # parsing takes long for so few bytes
    return p.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "body"))).alias("b")).selectExpr("concat('tests/test_g', g, '.py') AS path", r"array_join(transform(b, x -> x.body), '\n\n') AS text")


PAIRS = """t AS (SELECT p_partkey AS k, concat('tests/test_g', p_partkey // 4, '.py') AS path, concat('test_k', p_partkey % 997) AS name, p_size AS s, p_brand AS b, p_partkey % 4 = 3 AS odd FROM part),
x AS (SELECT *, concat(path, '::', name) AS key FROM t),
every AS (SELECT a.key AS a, b.key AS b, 0 AS o, 'same_name' AS signal FROM x a JOIN x b ON a.name = b.name AND a.path <> b.path AND a.key < b.key AND a.odd = b.odd
 UNION ALL SELECT a.key, b.key, 1, 'same_file' FROM x a JOIN x b ON a.path = b.path AND a.key < b.key AND a.odd = b.odd
 UNION ALL SELECT a.key, b.key, 2, 'same_calls' FROM x a JOIN x b ON a.s = b.s AND a.b = b.b AND a.key < b.key),
p AS (SELECT a, b, min_by(signal, o) AS signal FROM every GROUP BY 1, 2)"""


@query(f"WITH {PAIRS} SELECT a, b, signal FROM p")
def duplicate_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.test_pairs(R.scan_tests(tests(spark, sf_dir)))


@query(f"""WITH RECURSIVE {PAIRS}, q AS (SELECT a, b FROM p WHERE signal <> 'same_name'), e AS (SELECT a, b FROM q UNION SELECT b, a FROM q), r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE e.b <> r.root),
c AS (SELECT node, least(min(root), node) AS cluster FROM r GROUP BY node) SELECT cluster, count(*) AS members, min(node) AS first, max(node) AS last FROM c GROUP BY 1""")
def merged_test_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that share a test are one."""
    from corpusmill.operators.graph import connected_components

    c = connected_components(R.test_links(R.scan_tests(tests(spark, sf_dir))), "a", "b")
    return c.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("members"), F.min("node").alias("first"), F.max("node").alias("last"))


@query()
def rescued_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of alike tests with what makes them only ambiguously so; a unit test holds the conditions against plain ones."""
    from corpusmill.operators import rescue

    files = tests(spark, sf_dir)
    found = cut_lineage(R._scan(files, rescue.scan, rescue.SCAN, [c.split()[0] for c in rescue.SCAN.split(", ")]))
    scanned = found.withColumn("raises", F.col("called")).select("path", "name", "class_name", "line", "call_sig", "raises", "statements")
    pairs = R.test_pairs(scanned, judge=lambda members: rescue.judge(members, found.drop("called")))
    release(found)
    return pairs


@query("""WITH f AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS io, c_custkey % 3 = 0 AS process, c_custkey % 5 < 3 AS public, c_custkey % 7 < 2 AS internal FROM customer)
SELECT k, CASE WHEN process THEN 'e2e' WHEN NOT io AND public AND NOT internal THEN 'unit' WHEN io THEN 'integration' ELSE 'unit' END AS level FROM f""")
def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), R.pyramid_level(k % 2 == 0, k % 3 == 0, k % 5 < 3, k % 7 < 2).alias("level"))


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, text): files of a project a supplier, those that its key decides."""
    toml = r"""concat('[project]\nname = "s', k, '"\ndynamic = ["version"]\n', CASE WHEN k % 3 = 0 THEN 'readme = "README.md"\nlicense = "MIT"\n' ELSE '' END, CASE WHEN k % 5 = 0 THEN '\n[project.urls]\nHomepage = "h"\nDocumentation = "d"\nRepository = "r"\nIssues = "i"\n' ELSE '' END,
 '\n[tool.mypy]\npython_version = "3.12"\n', CASE WHEN k % 3 = 1 THEN 'strict = true\n' ELSE '' END, '\n[tool.other]\nstrict = true\n', CASE WHEN k % 7 = 0 THEN '\n[tool.ruff.lint]\nselect = ["ALL"]\n' ELSE '' END, CASE WHEN k % 11 = 0 THEN '\nbroken = [' ELSE '' END)"""
    files = [
        ("'pyproject.toml'", toml, "k % 2 = 0"),
        ("'README.md'", r"concat('# S\n## Features\n## Installation\n## Development\n', CASE WHEN k % 5 = 0 THEN '## License\n' ELSE '' END)", "k % 4 < 3"),
        ("'LICENSE'", "'MIT'", "k % 3 = 0"),
        ("'CHANGELOG.md'", "'x'", "k % 6 = 0"),
        ("'.github/workflows/ci.yml'", "concat('jobs: lint', CASE WHEN k % 8 = 0 THEN ' audit' ELSE '' END)", "k % 4 = 0"),
        ("'src/s/__init__.py'", "''", "k % 2 = 1"),
        ("concat('tests/', CASE WHEN k % 4 = 1 THEN 'unit' ELSE 'e2e' END, '/test_a.py')", "''", "k % 4 in (1, 2)"),
    ]
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k")
    out = None
    for path, text, where in files:
        one = s.where(where).selectExpr("concat('s', k) AS project", f"{path} AS path", f"{text} AS text")
        out = one if out is None else out.unionByName(one)
    return out


_HAS = "k % 2 = 0 AND k % 11 <> 0"
_PASSES = [
    ("pyproject.exists", 4, "k % 2 = 0"), ("pyproject.urls", 3, f"{_HAS} AND k % 5 = 0"), ("pyproject.mypy", 3, f"{_HAS} AND k % 3 = 1"), ("pyproject.ruff", 3, f"{_HAS} AND k % 7 = 0"), ("pyproject.ruff_rules", 2, f"{_HAS} AND k % 7 = 0"),
    ("docs.readme", 3, "k % 4 < 3 AND k % 5 = 0"), ("structure.license", 3, "k % 3 = 0"), ("changelog.manual", 2, "k % 6 <> 0"), ("ci.workflow", 4, "k % 4 = 0"), ("ci.lint", 3, "k % 4 = 0"), ("ci.security", 2, "k % 8 = 0"),
    ("structure.src", 4, "k % 2 = 1"), ("structure.tests", 3, "k % 4 IN (1, 2)"),
]
_S = "s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 4 < 3 OR s_suppkey % 3 = 0 OR s_suppkey % 2 = 1)"
PASSES = f"{_S}, g AS (" + " UNION ALL ".join(f"SELECT k, '{n}' AS name, {w} AS weight FROM s WHERE {c}" for n, w, c in _PASSES) + ")"


@query(f"WITH {PASSES} SELECT concat('s', k) AS project, name FROM g")
def governance_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = spark.createDataFrame([("tooling.installed",)], "name string")
    return V.govern(project(spark, sf_dir), V.checks(spark), "project", excluded).where("passed").select("project", "name")


_TOTAL = sum(w for _, _, w, x, *_ in V.CHECKS if x in ("any", "project"))


@query(f"WITH {PASSES}, e AS (SELECT k, sum(weight) AS earned FROM g GROUP BY 1) SELECT concat('s', k) AS project, coalesce(earned, 0) AS earned, {_TOTAL} AS total, CAST(round_even(coalesce(earned, 0) * 100 / {_TOTAL}, 0) AS INTEGER) AS score FROM s LEFT JOIN e USING (k)", longs=("earned", "total"))
def governance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.earned_weight(V.govern(project(spark, sf_dir), V.checks(spark)), ["project"])


@query(f"WITH s AS (SELECT s_suppkey AS k FROM supplier), n AS (SELECT k, CASE WHEN k % 11 = 0 THEN 0 ELSE 2 + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END END AS present FROM s WHERE k % 2 = 0) SELECT concat('s', k) AS project, present, present * 100 // 9 AS score FROM n")
def project_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.completeness(project(spark, sf_dir))


@query(f"WITH {_S} SELECT concat('s', k) AS project, level, CASE level WHEN 'unit' THEN k % 4 = 1 WHEN 'e2e' THEN k % 4 = 2 ELSE false END AS present FROM s, (SELECT unnest(['unit', 'integration', 'e2e']) AS level)")
def pyramid_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pyramid_folders(project(spark, sf_dir))


@query("""WITH i AS (SELECT DISTINCT concat('DEP00', 1 + p_partkey % 4) AS code, concat(upper(p_name[1]), replace(p_name[2:], ' ', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '.' END)) AS module FROM part), k AS (SELECT DISTINCT replace(p_name, ' ', '-') AS name FROM part WHERE p_size % 3 = 0)
SELECT code, module FROM i WHERE NOT (code = 'DEP002' AND regexp_replace(lower(module), '[-_.]+', '-', 'g') IN (SELECT name FROM k))""")
def dependency_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unused dependency that is an entry point or optional is none."""
    p = table(spark, sf_dir, "part")
    mark = F.when(F.col("p_partkey") % 2 == 0, "_").otherwise(".")
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.replace(F.substring("p_name", 2, 1000), F.lit(" "), mark))
    issues = p.select(F.concat(F.lit("DEP00"), (F.col("p_partkey") % 4 + 1).cast("string")).alias("code"), name.alias("module")).distinct()
    known = p.where("p_size % 3 = 0").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")).distinct()
    return R.unused_dependencies(issues, known)


@query()
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: snapshots appended as JSON lines, read back with the latest of each repository."""
    from corpusmill.session import ensure_checkpoint_dir
    from corpusmill.sources.logs import append_history, read_history

    import uuid

    path = f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("repo"), F.lit("abc").alias("sha"), F.lit("main").alias("branch"), F.lit("audit").alias("kind"), F.col("value").alias("score"), S.grade(F.col("value")).alias("grade"))
    append_history(rows.where("score < 50"), path)
    append_history(rows.where("score >= 50"), path)
    latest = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("ts"), "score"))
    return read_history(spark, path).withColumn("k", latest).where("k = 1").drop("k", "fails")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, no counterpart asked for: tumbling windows over events."""
    w = F.window("ts", "1 day")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")
