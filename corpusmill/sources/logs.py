"""Version-control logs, reports of tests, coverage and linters, docs, and the history of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "\x1f"
# fixed values: suffixes that mean a binary file
BINARY = ["png", "jpg", "jpeg", "gif", "ico", "svg", "woff", "woff2", "ttf", "eot", "pdf", "zip", "gz", "tar", "whl", "pyc", "so", "dylib", "dll", "exe"]


def commit_files(log: DataFrame) -> DataFrame:
    """(commit_id, file) from exported logs (text): a marked line begins a commit, the lines after it are its files."""
    part = F.explode(F.filter(F.split("text", MARK), lambda x: F.trim(x) != "")).alias("part")
    commits = log.select(part).select(F.trim(F.element_at(F.split("part", "\n"), 1)).alias("commit_id"), F.explode(F.slice(F.split("part", "\n"), 2, 1 << 30)).alias("file"))
    file = F.trim("file")
    return commits.select("commit_id", file.alias("file")).where((file != "") & ~F.lower(F.substring_index(file, ".", -1)).isin(BINARY)).distinct()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit_id, file) of a log file, read by commits and not whole: the marker separates records."""
    return commit_files(spark.read.option("lineSep", MARK).text(path).select(F.concat(F.lit(MARK), "value").alias("text")))


TESTS = "struct<tests:array<struct<nodeid:string,outcome:string,duration:double,call:struct<crash:struct<message:string,lineno:int>,longrepr:string>>>>"


def test_failures(reports: DataFrame) -> DataFrame:
    """(nodeid, error_type, message, traceback) of failed and broken tests in JSON reports (text)."""
    t = reports.select(F.explode(F.from_json("text", TESTS)["tests"]).alias("t")).where(F.col("t.outcome").isin("failed", "error"))
    message = F.coalesce(F.col("t.call.crash.message"), F.lit(""))
    lines = F.split(F.coalesce(F.col("t.call.longrepr"), F.lit("")), "\n")
    last = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), F.lit(5)), "\n")
    return t.select(F.col("t.nodeid").alias("nodeid"), F.when(F.contains(message, F.lit(":")), F.trim(F.substring_index(message, ":", 1))).otherwise("").alias("error_type"), message.alias("message"), last.alias("traceback"))


COVERAGE = "struct<totals:struct<percent_covered:double>,files:map<string,struct<summary:struct<percent_covered:double>>>>"


def coverage(reports: DataFrame) -> DataFrame:
    """(file, percent) of coverage reports (text), with the total as a null file; __main__ modules count in the total alone."""
    r = reports.select(F.from_json("text", COVERAGE).alias("r"))
    files = r.select(F.explode("r.files").alias("file", "x")).where(~F.endswith("file", F.lit("__main__.py"))).select("file", F.col("x.summary.percent_covered").alias("percent"))
    return files.unionByName(r.select(F.lit(None).cast("string").alias("file"), F.col("r.totals.percent_covered").alias("percent")))


ISSUES = "array<struct<filename:string,code:string,message:string,location:struct<row:int,column:int>>>"


def lint_issues(reports: DataFrame, shown: int = 20) -> DataFrame:
    """(file, line, code, message, total): the first issues of each report (id, text) by file and line, with their number."""
    from pyspark.sql import Window

    i = reports.select("id", F.posexplode(F.from_json("text", ISSUES)).alias("k", "x"))
    w = Window.partitionBy("id")
    ranked = i.select("id", F.col("x.filename").alias("file"), F.col("x.location.row").alias("line"), F.col("x.code").alias("code"), F.col("x.message").alias("message"), F.count("*").over(w).alias("total"), F.row_number().over(w.orderBy("k")).alias("place"))
    return ranked.where(F.col("place") <= shown).drop("place")


# fixed values: packages of the environment itself, whose vulnerabilities are not the project's
ENVIRONMENT = ["pip", "setuptools", "wheel", "uv"]
FORMAT, TYPES = "struct<files:array<string>>", "struct<diagnostics:array<struct<severity:string>>,complete:boolean>"
AUDIT, HYGIENE = "struct<dependencies:array<struct<name:string,vulns:array<struct<id:string>>>>>", "array<struct<code:string,module:string>>"
INCOMPLETE = 50


def tool_scores(reports: DataFrame, known: DataFrame) -> DataFrame:
    """(id, format_score, type_score, audit_score, hygiene_score) from the JSON reports of four tools.

    reports: id, format, types, audit, hygiene. Unformatted files, errors of types, vulnerable packages but those of
    the environment, and dependency issues count; an unused dependency that `known` (name) has is none, and the score
    of a type check that could not see its whole environment is capped. A missing report counts no findings.
    """
    from corpusmill.functions.score import PENALTIES, penalty_score
    from corpusmill.sources.python_rules import unused_dependencies

    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    parsed = reports.select("id", F.from_json("format", FORMAT)["files"].alias("files"), F.from_json("types", TYPES).alias("types"), F.from_json("audit", AUDIT)["dependencies"].alias("packages"), F.from_json("hygiene", HYGIENE).alias("issues"))
    errors = size(F.filter("types.diagnostics", lambda d: d["severity"] == "error"))
    own = size(F.filter("packages", lambda d: (F.size(d["vulns"]) > 0) & ~F.lower(d["name"]).isin(ENVIRONMENT)))
    left = unused_dependencies(parsed.select("id", F.inline("issues")), known, keep=["id"]).groupBy("id").agg(F.count("*").alias("n"))
    typed = penalty_score(errors, PENALTIES["QUALITY_TYPE"])
    typed = F.when(F.coalesce("types.complete", F.lit(True)), typed).otherwise(F.least(typed, F.lit(INCOMPLETE)))
    scored = parsed.select("id", penalty_score(size(F.col("files")), PENALTIES["QUALITY_FORMAT"]).alias("format_score"), typed.alias("type_score"), penalty_score(own, PENALTIES["DEPS_AUDIT"]).alias("audit_score"))
    return scored.join(left, "id", "left").select("id", "format_score", "type_score", "audit_score", penalty_score(F.coalesce("n", F.lit(0)), PENALTIES["DEPS_HYGIENE"]).alias("hygiene_score"))


def status_fields(line: Column) -> dict[str, Column]:
    """The two-letter status and the path of a version-control status line."""
    return {"status": F.substring(line, 1, 2), "path": F.substring(line, 4, 1 << 20)}


def normalise_failures(payloads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two payload shapes of failed rules in one: (rule_id, message, fix_hint), after the columns kept."""
    return payloads.select(*(keep or []), F.coalesce("rule_id", "name").alias("rule_id"), F.coalesce("message", "detail", F.lit("")).alias("message"), F.coalesce("fix_hint", "hint").alias("fix_hint"))


HISTORY = "ts string, repo string, sha string, branch string, kind string, score double, grade string, fails array<struct<rule_id:string,message:string,fix_hint:string>>"


def append_history(snapshots: DataFrame, path: str) -> None:
    """One JSON line a snapshot, added to what is there."""
    snapshots.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).json(path)


def read_docs(spark: SparkSession, root: str, pages: list[str] | None = None) -> DataFrame:
    """(path, text) of markdown files below root; pages keeps those whose path has one of the parts, ignoring case."""
    d = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return d if not pages else d.where(F.lower("path").rlike("|".join("\\Q" + p.lower() + "\\E" for p in pages)))


def listing(files: DataFrame, depth: int = 1) -> DataFrame:
    """Files and folders at most `depth` below the root, in the order of their paths."""
    parts = F.split("path", "/")
    every = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), (i < F.size(parts)).alias("is_dir"), i.alias("level")))).alias("x")).select("x.*").distinct()
    return every.where(F.col("level") <= depth).orderBy("path")


def line_slice(files: DataFrame, first: int, last: int) -> DataFrame:
    """(path, text): lines first to last, counted from 1."""
    return files.select("path", F.array_join(F.slice(F.split("text", "\n"), F.lit(first), F.lit(last - first + 1)), "\n").alias("text"))
