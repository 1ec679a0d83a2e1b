"""Text functions, logs and reports, ranking by neighbours, and layered lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import compact as K
from corpusmill.functions import detect as D
from corpusmill.functions import text as X
from corpusmill.operators import aggregate as A
from corpusmill.plans.corpus import docs, facts, named, sources
from corpusmill.plans.registry import query, values
from corpusmill.session import table
from corpusmill.sources import logs as L


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(^|\\n)<!--(.|\\n)*?-->\\n?', '\\1', 'g'), '<!--(.|\\n)*?-->', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM pages")
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_comments(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_replace(regexp_replace(replace(html, '><', '>  ' || chr(10) || chr(10) || chr(10) || chr(10) || '<'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM pages")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.collapse_whitespace(F.replace("html", F.lit("><"), F.lit(">  \n\n\n\n<"))).alias("text"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query("SELECT event_id, CASE WHEN props LIKE '{%' THEN 'json' ELSE 'text' END AS format FROM events")
def detect_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", D.detect_format(F.col("props")).alias("format"))


def _texts(spark: SparkSession, sf_dir: str, forms: list[tuple[str, str, str]]) -> DataFrame:
    """(k, form, text): one of the forms a part, in turn."""
    case = " ".join(f"WHEN {i} THEN {text}" for i, (_, text, _) in enumerate(forms))
    names = " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _, _) in enumerate(forms))
    n = len(forms)
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS k", f"CASE p_partkey % {n} {names} END AS form", f"CASE p_partkey % {n} {case} END AS text")


def _wanted(forms: list[tuple[str, str, str]]) -> str:
    return f"CASE p_partkey % {len(forms)} " + " ".join(f"WHEN {i} THEN {want}" for i, (_, _, want) in enumerate(forms)) + " END"


# a form, a text of it as Spark SQL over a part, and its format
FORMATS = [
    ("object", """concat('{"a": [1, ', p_size, ']}')""", "'json'"), ("broken", "concat('{oops ', p_name)", "'text'"), ("declared", """concat("<?xml version='1.0'?><r>", p_name, '</r>')""", "'xml'"), ("rooted", """concat("<note x='", p_size, "'>hi</note>")""", "'xml'"),
    ("page", "concat('<div>', p_name, '</div>')", "'text'"), ("mapping", r"concat('name: ', p_name, '\nitems:\n  - a\n  - b\n')", "'yaml'"), ("headed", r"concat('# ', p_name, '\n\nText\n\n## Two\n\nMore')", "'markdown'"), ("table", r"concat('|a|b|\n|-|-|\n|1|', p_size, '|')", "'markdown'"),
    ("settings", r"concat('[tool]\nx = ', p_size, '\n')", "'toml'"), ("grid", r"concat('a,b\n1,2\n3,', p_size)", "'csv'"), ("prose", "concat('Just a line, with ', p_name)", "'text'"), ("empty", "'  '", "'text'"),
]


GRID = " OR ".join(f"(contains(l[1], {d}) AND len(list_distinct(list_transform(l, lambda x: len(x) - len(replace(x, {d}, ''))))) = 1)" for d in ("','", "';'", "chr(9)", "'|'"))


@query(f"""SELECT p_partkey AS k, {_wanted(FORMATS)} AS format FROM part
UNION ALL SELECT -1 - page_id, CASE WHEN len(l) > 1 AND ({GRID}) THEN 'csv' ELSE 'text' END FROM (SELECT page_id, list_filter(string_split(html, chr(10)), lambda x: trim(x) <> '') AS l FROM pages)""")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every format, and pages, which are none, but that lines with as many commas each read as a grid."""
    pages = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("k"), F.col("html").alias("text"))
    return _texts(spark, sf_dir, FORMATS).select("k", "text").unionByName(pages).select("k", D.detect_format(F.col("text")).alias("format"))


# a rewrite, a text as Spark SQL over a part, and what becomes of it as SQL of the other dialect
REWRITES = [
    ("minify", """concat('{"b": ', p_size, ', "a": ["', p_name, '", 2.0]}')""", """concat('{"a":["', p_name, '",2.0],"b":', p_size, '}')"""),
    ("drop_nulls", """concat('{"a": null, "b": {"c": []}, "d": false, "e": ', p_size, ', "f": ["", {"g": ""}, 0]}')""", """concat('{"d":false,"e":', p_size, ',"f":[0]}')"""),
    ("flatten", """concat('{"a": {"b": {"c": ', p_size, '}}, "x": {"y": 1, "z": {"w": "', p_name, '"}}, "l": [{"m": {"n": 1}}]}')""", """concat('{"a.b.c":', p_size, ',"l":[{"m.n":1}],"x":{"y":1,"z.w":"', p_name, '"}}')"""),
    ("tabular", """concat('[{"a": ', p_size, ', "b": null}, {"a": true, "c": "x|', p_name, '"}]')""", """concat('a|b|c', chr(10), p_size, '|null|', chr(10), 'true||"x|', p_name, '"')"""),
    ("tabular", """concat('{"rows": [{"a": ', p_size, '}], "n": 2}')""", """concat('{"rows":"a\\n', p_size, '","n":2}')"""),
    ("round_numbers", """concat('{"a": ', p_size, '.125, "b": 2.675, "c": 3, "d": "1.239"}')""", """concat('{"a":', p_size, '.12,"b":2.67,"c":3,"d":"1.239"}')"""),
    ("strip_quotes", """concat('{"a_b":', p_size, ',"c d":{"e.f":"', p_name, '"}}')""", """concat('{a_b:', p_size, ',"c d":{e.f:"', p_name, '"}}')"""),
    ("dedup_values_with_refs", """concat('{"x": "a text of more than ', p_name, '", "y": "a text of more than ', p_name, '", "z": "', p_size, '"}')""", """concat('{"_data":{"x":"$R0","y":"$R0","z":"', p_size, '"},"_refs":{"$R0":"a text of more than ', p_name, '"}}')"""),
    ("collapse_whitespace", r"concat(p_name, '  \n\n\n\ntwo\t\n')", "concat(p_name, chr(10), chr(10), 'two', chr(10))"),
    ("collapse_whitespace", r"concat(p_name, '\n\n\n```\n\n\n  x  \n```\n\n\nend ', p_size)", "concat(p_name, chr(10), '```', chr(10), chr(10), chr(10), '  x  ', chr(10), '```', chr(10), 'end ', p_size)"),
    ("compact_tables", r"concat('# H\n\n## K\n\n| ', p_name, '  | b |\n|----|---|\n|  |  | ', p_size, ' |')", "concat('# H', chr(10), chr(10), '## K', chr(10), chr(10), '|', p_name, '|b|', chr(10), '|----|---|', chr(10), '||', p_size, '|')"),
    ("strip_html_comments", r"concat('a\n<!-- ', p_name, ' -->\nb <!-- too --> c\n```\n<!-- ', p_size, ' -->\n```\n')", "concat('a', chr(10), 'b  c', chr(10), '```', chr(10), '<!-- ', p_size, ' -->', chr(10), '```', chr(10))"),
    ("minify", r"concat('<r>\n  <a> ', p_name, ' </a>\n</r>')", "concat('<r><a>', p_name, '</a></r>')"),
]


@query(f"SELECT p_partkey AS k, {_wanted([(str(i), a, b) for i, (_, a, b) in enumerate(REWRITES)])} AS text FROM part")
def compaction_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rewrite on texts of its own."""
    forms = [(str(i), a, b) for i, (_, a, b) in enumerate(REWRITES)]
    rows = _texts(spark, sf_dir, forms)
    text = F.col("text")
    for i, (name, _, _) in enumerate(REWRITES):
        text = F.when(F.col("form") == str(i), K.rewrite(F.when(F.col("form") == str(i), F.col("text")), name)).otherwise(text)
    return rows.select("k", text.alias("text"))


DIRTY = T.StructType([T.StructField("inner", T.StructType([T.StructField("x", T.StringType())])), T.StructField("k", T.LongType()), T.StructField("list", T.ArrayType(T.StringType())), T.StructField("none", T.StringType()), T.StructField("off", T.BooleanType()), T.StructField("type", T.StringType())])


@query("""SELECT event_id, '{"k":' || k || ',"list":["x"],"off":false,"type":"' || event_type || '"}' AS text FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def json_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and empty values built in, then removed by built-ins, as the fields are known."""
    dirty = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "none": null, "off": false, "list": ["", null, "x"], "inner": {"x": ""}, "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", K.drop_nulls(dirty, DIRTY).alias("text"))


def _everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, text): event properties, pages and documents."""
    out = None
    for name, key, text in (("events", "event_id", "props"), ("pages", "page_id", "html"), ("documents", "doc_id", "text")):
        one = table(spark, sf_dir, name).select(F.col(key).alias("id"), F.lit(name).alias("kind"), F.col(text).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def _compacted(spark: SparkSession, sf_dir: str, preset: str) -> DataFrame:
    report = _everything(spark, sf_dir).withColumn("report", K.compact(F.col("text"), preset))
    return report.select("id", "kind", "report.format", "report.applied", "report.original_tokens", "report.compacted_tokens")


@query()
def compaction_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guarded pipeline over event properties, pages and documents."""
    return _compacted(spark, sf_dir, "moderate")


@query()
def compaction_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(spark, sf_dir, "safe")


@query()
def compaction_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(spark, sf_dir, "aggressive")


@query()
def compaction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir, FORMATS).withColumn("report", K.compact_check(F.col("text")))
    return rows.select("k", "report.format", "report.tokens", F.to_json("report.estimates").alias("estimates"), "report.savings")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]{1,6}|[^\p{L}\p{N}_ \t\n\r\f]|[ \t\n\r\f]+')) AS tokens FROM documents""", longs=("tokens",))
def approximate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", K.tokens(F.col("text")).cast("long").alias("tokens"))


@query("""WITH l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE len(line) >= 20 GROUP BY 1, 2 HAVING count(*) > 1)
SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id ORDER BY len(line) * n DESC, line) - 1 AS alias FROM l""")
def dedup_lines_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines worth an alias, by length times count."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.char_length("line") >= 20)
    n = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n > 1")
    return n.withColumn("alias", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.char_length("line") * F.col("n")), "line")) - 1)


@query("""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(password|secret|api_key|token)\\s*=\\s*["'']([^"'']*)["'']', 2)) AS value FROM documents)
SELECT doc_id, value FROM m WHERE len(trim(value)) > 7 AND lower(trim(value)) NOT IN ('changeme', 'placeholder', 'example.com', 'redacted') AND NOT contains(value, '...') AND NOT regexp_full_match(trim(value), '<.*>|\\*+')""")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = rf"(?:{'|'.join(X.SECRET_KEYWORDS)})\s*=\s*[\"']([^\"']*)[\"']"
    m = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("value"))
    return m.where(~X.is_placeholder(F.col("value")))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'aws_access_key' WHEN 1 THEN 'github_token' WHEN 2 THEN 'private_key' WHEN 3 THEN 'github_token' END AS format FROM customer""")
def secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every format among texts that only look like one."""
    k = F.col("c_custkey")
    tail = F.lpad(k.cast("string"), 16, "A")
    text = F.when(k % 5 == 0, F.concat(F.lit("key = 'AKIA"), tail, F.lit("'"))).when(k % 5 == 1, F.concat(F.lit("ghp_"), F.lpad(k.cast("string"), 36, "b"))).when(k % 5 == 2, F.lit("x\n-----BEGIN RSA PRIVATE KEY-----")).when(k % 5 == 3, F.concat(F.lit("github_pat_"), F.lpad(k.cast("string"), 22, "c"))).otherwise(F.concat(F.lit("AKIA short ghp_"), k))
    found = F.lit(None).cast("string")
    for name, pattern in X.SECRET_FORMATS.items():
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("format"))


@query("SELECT c_custkey, c_custkey % 9 NOT IN (5, 6) AS placeholder FROM customer")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("key of "), k.cast("string"))
    forms = [F.lit("changeme"), F.concat(F.lit("<"), name, F.lit(">")), F.lit(" short "), F.lit("********"), F.concat(name, F.lit("...xyz")), name, F.concat(F.lit("correct horse "), k.cast("string")), F.lit("Redacted"), F.lit("your-token")]
    value = forms[0]
    for i, f in enumerate(forms):
        value = F.when(k % len(forms) == i, f).otherwise(value)
    return table(spark, sf_dir, "customer").select("c_custkey", X.is_placeholder(value).alias("placeholder"))


@query(facts("docs") + f"""SELECT path, 1 AS level, concat('Module m', m) AS text FROM docs_ UNION ALL SELECT path, unnest([2, 2]), concat({named('8 * m + 5')}, ' and more') FROM docs_ UNION ALL SELECT CAST(page_id AS VARCHAR), 1, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) FROM pages WHERE regexp_matches(html, '<h1>\\s*\\S')""", longs=("level",))
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the documentation, and those of pages, written as such."""
    h1 = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    pages = table(spark, sf_dir, "pages").where(F.col("html").rlike(r"<h1>\s*\S")).select(F.col("page_id").cast("string").alias("path"), F.concat(F.lit("intro\n# "), h1, F.lit("\n#### deep\n")).alias("text"))
    found = docs(spark, sf_dir).unionByName(pages).select("path", F.inline(X.headings(F.col("text"))))
    return found.withColumn("level", F.col("level").cast("long"))


@query(facts("docs") + f"""SELECT path, concat('Module m', m) AS heading, concat('Use `', {named('8 * m + 3')}, '` first.') AS sentence FROM docs_ UNION ALL SELECT path, concat({named('8 * m + 5')}, ' and more'), 'Later words.' FROM docs_""")
def heading_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line below each heading that is neither a fence, a quote nor a heading; a later heading of that name wins."""
    sections = F.filter(F.split("text", r"(?m)^(?=#{1,3}\s)"), lambda s: s.rlike(r"^#{1,3}\s"))
    body = F.filter(F.slice(F.split("section", "\n"), 2, 1 << 30), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(```|>|#)"))
    d = docs(spark, sf_dir).select("path", F.posexplode(sections).alias("k", "section"))
    d = d.select("path", "k", F.trim(F.regexp_replace(F.element_at(F.split("section", "\n"), 1), r"^#+\s+", "")).alias("heading"), F.try_element_at(body, F.lit(1)).alias("sentence"))
    return d.groupBy("path", "heading").agg(F.max_by("sentence", "k").alias("sentence"))


# the lead of a subject, its type, whether it breaks, and whether it is a feature
LEADS = [("feat(api): ", "feat", False, True), ("fix!: ", "fix", True, False), ("docs: ", "docs", False, False), ("abc1234 feat: ", "feat", False, True), ("Merge branch ", "other", False, False), ("chore(deps): BREAKING CHANGE: ", "chore", True, False), ("refactor(core)!: ", "refactor", True, False), ("deadbeef fix: ", "fix", False, False), ("feat(x)!: ", "feat", True, False)]
LEAD_SQL = values("l", ["i", "lead", "type", "breaking", "feature"], [(i, *x) for i, x in enumerate(LEADS)])
CLASSIFIED = f"""{LEAD_SQL}, c AS (SELECT event_id, regexp_replace(lead, '^(abc1234|deadbeef) ', '') || event_type || ' ' || event_id AS message, type, breaking, feature, user_id FROM events JOIN l ON i = event_id % {len(LEADS)})"""


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.lit("")
    for i, (x, *_) in enumerate(LEADS):
        lead = F.when(F.col("event_id") % len(LEADS) == i, x).otherwise(lead)
    s = F.col("subject")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(lead, "event_type", F.lit(" "), F.col("event_id").cast("string")).alias("subject"))
    return e.select("event_id", "user_id", X.commit_message(s).alias("message"), X.commit_type(s).alias("type"), X.is_breaking(s).alias("breaking"), X.is_feature(s).alias("feature"))


@query(f"WITH {CLASSIFIED} SELECT event_id, message, type, breaking FROM c")
def commit_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("event_id", "message", "type", "breaking")


@query(f"WITH {CLASSIFIED} SELECT type AS key, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'breaking', count(*) FROM c WHERE breaking HAVING count(*) > 0")
def commit_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _subjects(spark, sf_dir)
    breaking = c.where("breaking").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("breaking").alias("key"), "n")
    return c.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n")).unionByName(breaking)


@query(f"""WITH {CLASSIFIED}, t AS (SELECT user_id, user_id % 3 AS major, user_id % 7 AS minor, user_id % 5 AS patch, bool_or(breaking) AS b, bool_or(feature) AS f FROM c WHERE event_id % 4 <> 1 GROUP BY ALL)
SELECT user_id, CASE WHEN b AND major > 0 THEN 'major' WHEN b OR f THEN 'minor' ELSE 'patch' END AS bump,
 CASE WHEN b AND major > 0 THEN concat('v', major + 1, '.0.0') WHEN b OR f THEN concat('v', major, '.', minor + 1, '.0') ELSE concat('v', major, '.', minor, '.', patch + 1) END AS next FROM t""")
def version_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next version of each user's package, from the commits since its tag."""
    u = F.col("user_id")
    tag = F.concat(F.lit("v"), F.concat_ws(".", (u % 3).cast("string"), (u % 7).cast("string"), (u % 5).cast("string")))
    flags = _subjects(spark, sf_dir).where("event_id % 4 <> 1").groupBy("user_id").agg(F.bool_or("breaking").alias("breaking"), F.bool_or("feature").alias("feature"))
    k = X.version_key(tag)
    args = [F.element_at(k, i) for i in (1, 2, 3)]
    return flags.select("user_id", X.version_bump(args[0], F.col("breaking"), F.col("feature")).alias("bump"), X.next_version(*args, F.col("breaking"), F.col("feature")).alias("next"))


@query("""WITH t AS (SELECT o_custkey % 4 AS package, o_orderkey % 3 AS a, o_custkey % 30 AS b, o_orderkey % 40 AS c FROM orders WHERE o_orderkey % 6 <> 0)
SELECT package, concat('p', package, '/v', a, '.', b, '.', c) AS tag FROM (SELECT DISTINCT *, row_number() OVER (PARTITION BY package ORDER BY a DESC, b DESC, c DESC) AS k FROM t) WHERE k = 1""")
def latest_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest version of each package by numbers, not by letters; tags of other shapes do not count."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lead = F.concat(F.lit("p"), (c % 4).cast("string"), F.lit("/"))
    version = F.when(k % 6 == 0, F.concat(F.lit("beta9."), k.cast("string"))).otherwise(F.concat(F.lit("v"), F.concat_ws(".", (k % 3).cast("string"), (c % 30).cast("string"), (k % 40).cast("string"))))
    t = table(spark, sf_dir, "orders").select((c % 4).alias("package"), F.concat(lead, version).alias("tag"))
    key = X.version_key(F.concat(F.substring_index("tag", "/", -1)))
    return t.withColumn("key", key).where("key is not null").groupBy("package").agg(F.max_by("tag", "key").alias("tag"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exported log an order: what its lines name are the files of the commit, with a picture and a blank line among them."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("src/f"), F.col("l_suppkey").cast("string"), F.lit(".py")))).alias("files"))
    return li.select(F.concat(F.lit("\x1f"), F.col("l_orderkey").cast("string"), F.lit("\nlogo.PNG\n\n"), F.array_join("files", "\n"), F.lit("\n")).alias("text"))


@query("SELECT concat('src/f', l_suppkey, '.py') AS file, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def git_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.commit_files(_log(spark, sf_dir)).groupBy("file").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), n AS (SELECT s, count(*) AS n FROM c GROUP BY 1), p AS (SELECT b.s, count(*) AS co FROM c a JOIN c b USING (o) WHERE a.s = 1 AND b.s <> 1 GROUP BY 1)
SELECT concat('src/f', s, '.py') AS file, co AS co_changes, co / greatest(n, (SELECT n FROM n WHERE s = 1)) AS strength FROM p JOIN n USING (s) WHERE co >= 3 AND co / greatest(n, (SELECT n FROM n WHERE s = 1)) >= 0.03""", doubles=("strength",))
def git_log_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.coupled_with(L.commit_files(_log(spark, sf_dir)), "src/f1.py", 0.03, 3)


@query("""WITH s AS (SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages), c AS (SELECT page_id, slug, substr(slug, 1, 40) AS cut FROM s)
SELECT page_id, CASE WHEN len(slug) <= 40 THEN slug ELSE rtrim(regexp_replace(cut, '-[^-]*$', ''), '-') END AS slug FROM c""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


# labels as Spark SQL, a title, and the type of the branch
TICKETS = [("array()", "x", "feat"), ("array('urgent', 'bug', 'feature')", "x", "fix"), ("array('urgent')", "docs(api): ", "docs"), ("array('urgent', event_type)", "chore: ", "chore"), ("array('documentation', event_type)", "fix: ", "docs"), ("array(event_type)", "Fix it ", "chore"), ("array('enhancement')", "test: ", "feat"), ("array(event_type)", "refactor(a)!: ", "refactor")]


@query(f"WITH {values('t', ['i', 'type'], [(i, t) for i, (_, _, t) in enumerate(TICKETS)])} SELECT event_id, type FROM events JOIN t ON i = event_id % {len(TICKETS)}")
def branch_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = lambda xs: f"CASE event_id % {len(TICKETS)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"cast({case([a for a, _, _ in TICKETS])} as array<string>) AS labels", case([f"concat('{t}', event_id)" for _, t, _ in TICKETS]) + " AS title")
    return rows.select("event_id", X.branch_type(F.col("labels"), F.col("title")).alias("type"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' M' WHEN 1 THEN '??' ELSE 'R ' END AS status, concat('src/', p_name, '.py') AS path FROM part")
def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.concat(F.when(k % 3 == 0, " M").when(k % 3 == 1, "??").otherwise("R "), F.lit(" src/"), "p_name", F.lit(".py"))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in L.status_fields(line).items()])


@query("""SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', (n + 50000) // 100000 / 10) WHEN n >= 1000 THEN printf('%.1fK', (n + 50) // 100 / 10) ELSE CAST(n AS VARCHAR) END AS count,
CASE WHEN n >= 1048576 THEN printf('%.1f MB', floor(n * 10 / 1048576 + 0.5) / 10) WHEN n >= 1024 THEN printf('%.1f KB', floor(n * 10 / 1024 + 0.5) / 10) ELSE CAST(n AS VARCHAR) || ' B' END AS size
FROM (SELECT o_orderkey, CAST(floor(o_totalprice * (o_orderkey % 9) * (o_orderkey % 5)) AS BIGINT) AS n FROM orders)""")
def count_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 9) * (F.col("o_orderkey") % 5)).alias("n"))
    return o.select("o_orderkey", X.format_count(F.col("n")).alias("count"), X.format_size(F.col("n")).alias("size"))


@query("""SELECT c_custkey AS key, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'env' END, ''), CASE WHEN c_custkey % 2 = 0 THEN 'file' END, CASE WHEN c_custkey % 5 <> 0 THEN 'default' END) AS value,
CASE WHEN c_custkey % 3 = 1 THEN 'env' WHEN c_custkey % 2 = 0 THEN 'file' WHEN c_custkey % 5 <> 0 THEN 'default' ELSE 'missing' END AS source FROM customer""")
def layered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    value, source = X.layered(("env", F.when(k % 3 == 0, "").when(k % 3 == 1, "env")), ("file", F.when(k % 2 == 0, "file")), ("default", F.when(k % 5 != 0, "default")), empty_is_absent=True)
    return table(spark, sf_dir, "customer").select(k.alias("key"), value.alias("value"), source.alias("source"))


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'core' ELSE concat('core.', replace(p_name, ' ', '.')) END AS namespace, concat(replace(p_name, ' ', '_'), '_key') AS key FROM part)
SELECT p_partkey, 'APP_' || upper(replace(namespace, '.', '__')) || '_' || upper(key) AS name FROM n""")
def env_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    namespace = F.when(F.col("p_partkey") % 2 == 0, "core").otherwise(F.concat(F.lit("core."), F.replace("p_name", F.lit(" "), F.lit("."))))
    key = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_key"))
    return table(spark, sf_dir, "part").select("p_partkey", X.env_name(namespace, key).alias("name"))


SPANS = "s AS (SELECT event_id, user_id, ts AS first, ts + INTERVAL 1 MINUTE * CAST(floor(value * 10) AS INTEGER) AS last FROM events)"


@query(f"""WITH {SPANS} SELECT event_id, coalesce(first <= lag(last) OVER (PARTITION BY user_id ORDER BY first, event_id), false) AS overlaps_previous,
 coalesce(first <= max(last) OVER (PARTITION BY user_id ORDER BY first, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps_any FROM s""")
def overlap_next_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that begin at or before the end of the span before them, and of any span before them: the two differ by design."""
    last = F.col("ts") + F.make_dt_interval(mins=F.floor(F.col("value") * 10).cast("int"))
    s = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("first"), last.alias("last"))
    w = Window.partitionBy("user_id").orderBy("first", "event_id")
    no = F.lit(False)
    return s.select("event_id", F.coalesce(F.col("first") <= F.lag("last").over(w), no).alias("overlaps_previous"), F.coalesce(F.col("first") <= F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), no).alias("overlaps_any"))


@query("""WITH h AS (SELECT o_orderkey AS hint FROM orders), c AS (SELECT event_id AS line FROM events WHERE event_type = 'purchase'),
r AS (SELECT hint, line, row_number() OVER (PARTITION BY hint ORDER BY abs(line - hint), line) AS k FROM h JOIN c ON line BETWEEN hint - 5 AND hint + 5) SELECT hint, line FROM r WHERE k = 1""")
def nearest_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest candidate within five of each hint, the earlier of two: the window is unrolled to keys of an equi join."""
    hints = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hint"), F.explode(F.sequence(F.col("o_orderkey") - 5, F.col("o_orderkey") + 5)).alias("line"))
    near = hints.join(table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("line")), "line")
    return near.groupBy("hint").agg(F.min_by("line", F.struct(F.abs(F.col("line") - F.col("hint")), "line")).alias("line"))


@query("""WITH t AS (SELECT source AS file, doc_id AS test, unnest(string_split(lower(text), ' ')) AS sym FROM documents), c AS (SELECT file, test, sym, count(*) AS n FROM t WHERE regexp_full_match(sym, '[a-z]+') GROUP BY 1, 2, 3),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, test ORDER BY n DESC, sym) AS k FROM c) WHERE k <= 2),
f AS (SELECT file, sym, count(*) AS n FROM p GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, sym) AS k FROM f)
SELECT file, 'test_' || string_agg(sym, '_' ORDER BY k) AS canonical FROM g WHERE k <= 2 GROUP BY 1""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's name from its tests: two leading symbols of each, then the two that lead most often."""
    t = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("test"), F.explode(F.split(F.lower("text"), " ")).alias("sym"))
    c = t.where(F.col("sym").rlike("^[a-z]+$")).groupBy("file", "test", "sym").agg(F.count("*").alias("n"))
    top = lambda d, *by: d.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "sym"))).where("k <= 2")
    g = top(top(c, "file", "test").groupBy("file", "sym").agg(F.count("*").alias("n")), "file")
    return g.groupBy("file").agg(F.concat(F.lit("test_"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "sym"))), lambda x: x["sym"]), "_")).alias("canonical"))


@query("""SELECT concat('t::o', o_orderkey) AS nodeid, CASE WHEN o_orderstatus = 'F' THEN 'ValueError' ELSE '' END AS error_type, CASE WHEN o_orderstatus = 'F' THEN concat('ValueError: bad ', o_custkey) ELSE '' END AS message,
CASE WHEN o_orderstatus = 'F' THEN concat('2', chr(10), '3', chr(10), '4', chr(10), '5', chr(10), 'at ', o_orderkey) ELSE '' END AS traceback FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def test_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of tests a customer, as JSON: orders passed, failed or broke."""
    o = table(spark, sf_dir, "orders")
    crash = F.struct(F.concat(F.lit("ValueError: bad "), F.col("o_custkey").cast("string")).alias("message"), F.lit(3).alias("lineno"))
    call = F.struct(crash.alias("crash"), F.concat(F.lit("1\n2\n3\n4\n5\nat "), F.col("o_orderkey").cast("string")).alias("longrepr"))
    outcome = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "error").otherwise("passed")
    test = F.struct(F.concat(F.lit("t::o"), F.col("o_orderkey").cast("string")).alias("nodeid"), outcome.alias("outcome"), F.when(outcome == "failed", call).alias("call"))
    return L.test_failures(o.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(test).alias("tests"))).alias("text")))


@query("""SELECT concat('c', c_custkey, '.py') AS file, c_acctbal AS percent FROM customer WHERE c_custkey % 50 <> 0 UNION ALL SELECT NULL, count(*) + 0.5 FROM customer GROUP BY c_nationkey""", doubles=("percent",))
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coverage report a nation, as JSON."""
    k = F.col("c_custkey")
    file = F.when(k % 50 == 0, F.concat(F.lit("c"), k.cast("string"), F.lit("/__main__.py"))).otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit(".py")))
    one = F.struct(file.alias("key"), F.struct(F.struct(F.col("c_acctbal").alias("percent_covered")).alias("summary")).alias("value"))
    body = F.struct(F.struct((F.count("*") + 0.5).alias("percent_covered")).alias("totals"), F.map_from_entries(F.collect_list(one)).alias("files"))
    return L.coverage(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(body).alias("text")))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS total FROM part)
SELECT p_brand AS id, concat(replace(p_name, ' ', '_'), '.py') AS file, p_size AS line, concat('E', p_partkey % 9) AS code, concat('m', p_partkey) AS message, total FROM p WHERE k <= 20""")
def lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linter's report a brand, as JSON: the first twenty issues of each are shown."""
    k = F.col("p_partkey")
    issue = F.struct(k.alias("k"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".py")).alias("filename"), F.concat(F.lit("E"), (k % 9).cast("string")).alias("code"), F.concat(F.lit("m"), k.cast("string")).alias("message"), F.struct(F.col("p_size").alias("row"), F.lit(1).alias("column")).alias("location"))
    return L.lint_issues(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(issue))).alias("text")))


@query("""WITH p AS (SELECT p_brand AS b, p_partkey AS k, p_size AS s FROM part)
SELECT b AS id, greatest(0, 100 - 5 * count_if(s > 47)) AS format_score, least(greatest(0, 100 - 5 * count_if(s = 7)), CASE WHEN bool_or(s = 50) THEN 50 ELSE 100 END) AS type_score, greatest(0, 100 - 15 * count_if(s = 11 AND k % 3 > 0)) AS audit_score, greatest(0, 100 - 10 * count_if(s = 13 AND NOT (k % 4 = 1 AND k % 5 = 0))) AS hygiene_score FROM p GROUP BY 1""", longs=("format_score", "type_score", "audit_score", "hygiene_score"))
def tool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a formatter, a type checker, a vulnerability scanner and a dependency checker, as JSON a brand, and their scores."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.lit("Dep_"), k.cast("string"))
    some = lambda when, what: F.collect_list(F.when(when, what))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(
        F.to_json(F.struct(some(size > 47, name).alias("files"))).alias("format"),
        F.to_json(F.struct(some(size == 7, F.struct(F.lit("error").alias("severity"))).alias("diagnostics"), (~F.bool_or(size == 50)).alias("complete"))).alias("types"),
        F.to_json(F.struct(some(size == 11, F.struct(F.when(k % 3 == 0, "pip").otherwise(name).alias("name"), F.array(F.struct(F.lit("V1").alias("id"))).alias("vulns"))).alias("dependencies"))).alias("audit"),
        F.to_json(some(size == 13, F.struct(F.concat(F.lit("DEP00"), (k % 4 + 1).cast("string")).alias("code"), name.alias("module")))).alias("hygiene"),
    )
    known = table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("dep-"), k.cast("string")).alias("name"))
    return L.tool_scores(rows, known).select("id", *[F.col(c).cast("long").alias(c) for c in ("format_score", "type_score", "audit_score", "hygiene_score")])


@query("""SELECT o_orderkey, concat('R', o_custkey) AS rule_id, CASE o_orderkey % 3 WHEN 2 THEN '' ELSE o_orderpriority END AS message, CASE o_orderkey % 3 WHEN 1 THEN NULL ELSE o_orderstatus END AS fix_hint FROM orders""")
def failure_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in two shapes and a mixture."""
    k, rule = F.col("o_orderkey") % 3, F.concat(F.lit("R"), F.col("o_custkey").cast("string"))
    when = lambda hit, x: F.when(hit, x)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", when(k != 1, rule).alias("rule_id"), when(k == 1, rule).alias("name"), when(k == 0, F.col("o_orderpriority")).alias("message"), when(k == 1, F.col("o_orderpriority")).alias("detail"), when(k == 0, F.col("o_orderstatus")).alias("fix_hint"), when(k == 2, F.col("o_orderstatus")).alias("hint"))
    return L.normalise_failures(rows, ["o_orderkey"])


@query(facts("modules", "docs") + """, f AS (SELECT path FROM modules_ UNION ALL SELECT path FROM docs_), p AS (SELECT string_split(path, '/') AS p FROM f)
SELECT DISTINCT array_to_string(p[1:i], '/') AS path, i < len(p) AS is_dir, i AS level FROM p, (SELECT unnest([1, 2]) AS i) WHERE i <= len(p)""", longs=("level",))
def directory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sources(spark, sf_dir).select("path").unionByName(docs(spark, sf_dir).select("path"))
    return L.listing(files, 2).withColumn("level", F.col("level").cast("long"))


@query("SELECT doc_id AS path, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS text FROM documents")
def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.line_slice(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"), 2, 3)


@query("SELECT doc_id, CASE WHEN len(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS text FROM documents")
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), 60).alias("text"))


@query(facts("modules") + r"SELECT path, module, regexp_matches(module, '(^|\.)(tests($|\.)|test_)') AS test FROM modules_ UNION ALL SELECT replace(path, '.py', '/__init__.py'), module, regexp_matches(module, '(^|\.)(tests($|\.)|test_)') FROM modules_")
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names of modules, and of packages in their place."""
    files = sources(spark, sf_dir).select("path")
    every = files.unionByName(files.select(F.replace("path", F.lit(".py"), F.lit("/__init__.py")).alias("path")))
    return every.withColumn("module", X.module_name(F.col("path"))).withColumn("test", X.is_test_module(F.col("module")))


@query("""SELECT p_name AS name, lower(p_name || ' ' || p_brand || ' ' || p_type) AS entry FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#2') ORDER BY name, entry LIMIT 20""")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), entry.alias("entry")).where(F.contains("entry", F.lit("brand#2"))).orderBy("name", "entry").limit(20)


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS part, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY p_partkey, i) AS k FROM w) SELECT part, p_partkey AS first_row, CAST(i AS INTEGER) AS first_place FROM r WHERE k = 1""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names with where they are first seen."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "part"))
    first = words.groupBy("part").agg(F.min(F.struct("p_partkey", (F.col("i") + 1).alias("i"))).alias("x"))
    return first.select("part", F.col("x.p_partkey").alias("first_row"), F.col("x.i").alias("first_place"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)
SELECT a.doc_id AS a, a.doc_id + 1 AS b, count_if(b.w IS NULL) <= 20 AS nearly_inside FROM w a JOIN (SELECT DISTINCT doc_id FROM documents) n ON n.doc_id = a.doc_id + 1 LEFT JOIN w b ON b.doc_id = a.doc_id + 1 AND b.w = a.w GROUP BY 1""")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all but a few words of a document stand in the next one too."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("w"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(b, "doc_id").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), (F.size(F.array_except("w", "v")) <= 20).alias("nearly_inside"))
