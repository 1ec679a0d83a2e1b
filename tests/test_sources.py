from corpusmill.operators import code as C
from fixture import FILES
from corpusmill.sources import logs as L
from corpusmill.sources import python_rules as R
from corpusmill.sources import python_source as P


def write(tmp_path, files):
    for path, text in files:
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)


def test_files_are_read_parsed_and_pruned(spark, tmp_path):
    root = tmp_path / "proj"
    write(root, [*FILES, (".venv/x.py", "a = 1"), ("src/shop/__pycache__/y.py", "b = 2"), ("notes.txt", "no")])
    files = P.read_files(spark, str(root))
    assert {r["path"] for r in files.collect()} == {p for p, _ in FILES}
    v = P.views(P.parse_modules(files))
    assert v["modules"].where("error = 'SyntaxError'").count() == 1
    assert {r["symbol"] for r in C.callers(v, spark.createDataFrame([("Cart",)], "name string")).selectExpr("name symbol").collect()} == {"Cart"}
    assert P.fingerprint(spark, str(root)).count() == len(FILES)


def test_ambiguous_definition_is_an_error(spark):
    import pytest

    files = spark.createDataFrame([("a.py", "def f(): pass"), ("b.py", "def f(): pass")], "path string, text string")
    with pytest.raises(Exception, match="more than once"):
        C.definition(P.views(P.parse_modules(files)), "f").collect()


def test_null_and_empty_export_lists_differ(spark):
    files = spark.createDataFrame([("a.py", "__all__ = []\ndef f(): pass"), ("b.py", "def g(): pass\ndef _h(): pass")], "path string, text string")
    assert [r["signature"] for r in C.describe(P.views(P.parse_modules(files))).collect()] == ["def g()"]


def test_log_is_read_by_records(spark, tmp_path):
    (tmp_path / "log.txt").write_text("\x1fa1\nx.py\nlogo.png\n\x1fb2\nx.py\ny.py\n")
    got = sorted((r["commit_id"], r["file"]) for r in L.read_log(spark, str(tmp_path / "log.txt")).collect())
    assert got == [("a1", "x.py"), ("b2", "x.py"), ("b2", "y.py")]


def test_history_appends(spark, tmp_path):
    rows = spark.createDataFrame([("t", "r", 1.5)], "ts string, repo string, score double")
    for _ in range(2):
        L.append_history(rows, str(tmp_path / "h"))
    assert L.read_history(spark, str(tmp_path / "h")).count() == 2


def test_docs_are_filtered_by_page(spark, tmp_path):
    write(tmp_path, [("a/Guide.md", "# G"), ("b.md", "# B"), ("c.txt", "x")])
    assert L.read_docs(spark, str(tmp_path)).count() == 2
    assert L.read_docs(spark, str(tmp_path), ["guide"]).count() == 1


def test_complexity_of_plain_cases():
    import ast

    body = lambda s: ast.parse(s).body[0]
    assert (R.cyclomatic(body("def f():\n    return 1")), R.cognitive(body("def f():\n    return 1"))) == (1, 0)
    f = body("def f(a):\n    if a:\n        return 1\n    elif a > 2:\n        return 2\n    else:\n        return 3")
    assert (R.cyclomatic(f), R.cognitive(f)) == (3, 3)


def test_tools(spark):
    from corpusmill.plans import tools

    assert "pagerank" in tools.discover() and "pagerank" not in tools.discover("page*, x")
    step = tools.node(lambda d: d.limit(1), {"d": "in"}, {"out": "result"})
    assert step({"in": spark.range(5)})["out"].count() == 1

    @tools.rule("demo")
    def small(facts):
        return facts.where("id < 2").selectExpr("'SMALL' rule_id", "id")

    assert tools.run_rules(spark.range(5), ["demo"]).count() == 2


def test_stream_equals_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusmill.streaming import events as E

    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = E.read_stream(spark, str(tmp_path / "in"), rows.schema)
    E.run_once(E.windowed(stream, "ts", ["k"], "v", "1 hour", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = E.windowed(rows, "ts", ["k"], "v", "1 hour")
    assert got.count() > 50 and got.exceptAll(whole).count() == 0
    assert E.sessions(rows, "ts", ["k"], "1 hour").count() == 3
