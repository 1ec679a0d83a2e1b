"""Metrics, penalty scores, roll-ups and grades over the order tables and small fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import score as S
from corpusmill.operators import aggregate as A
from corpusmill.plans.registry import query, values
from corpusmill.session import table

# supplier returns stand in for findings: one a returned line


@query("""
WITH n AS (SELECT l_suppkey AS supplier, count_if(l_returnflag = 'R' AND l_quantity > 45) AS n FROM lineitem GROUP BY 1),
s AS (SELECT *, greatest(0, 100 - n * 2) AS score FROM n)
SELECT supplier, n, CAST(score AS INTEGER) AS score,
  CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS audit_grade,
  CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS governance_grade
FROM s""", longs=("n",))
def penalty_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    n = lines.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("n"))
    s = n.withColumn("score", S.penalty_score(F.col("n"), 2))
    return s.withColumns({"audit_grade": S.grade(F.col("score")), "governance_grade": S.grade(F.col("score"), "governance")})


@query("""
SELECT o_orderkey AS id, CAST(floor(o_totalprice / 200) AS BIGINT) AS lines,
  CAST(CASE WHEN floor(o_totalprice / 200) <= 400 THEN 100 WHEN floor(o_totalprice / 200) >= 1200 THEN 0
    ELSE floor(100 - (floor(o_totalprice / 200) - 400) * 100 / 800) END AS INTEGER) AS score FROM orders""")
def diff_size_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 200).alias("lines"))
    return o.withColumn("score", S.linear_score(F.col("lines")))


FINDINGS = """SELECT l_orderkey AS package, CASE l_linenumber % 3 WHEN 0 THEN 'QUALITY_SECURITY' WHEN 1 THEN 'ARCH_COUPLING' ELSE 'TEST_QUALITY_FILE_NAMING' END AS rule_id,
 CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity FROM lineitem"""


@query(f"""
WITH f AS ({FINDINGS}), r(rule_id) AS (VALUES ('QUALITY_SECURITY'), ('ARCH_COUPLING'), ('TEST_QUALITY_FILE_NAMING'), ('QUALITY_LINT')),
p AS (SELECT package, rule_id, count(*) AS n, sum(CASE WHEN rule_id = 'QUALITY_SECURITY' THEN CASE severity WHEN 'high' THEN 15 WHEN 'medium' THEN 5 ELSE 0 END
  WHEN rule_id = 'ARCH_COUPLING' THEN CASE severity WHEN 'error' THEN 5 WHEN 'warning' THEN 3 ELSE 0 END
  ELSE CASE severity WHEN 'warning' THEN 3 WHEN 'info' THEN 1 ELSE 0 END END) AS lost FROM f GROUP BY 1, 2),
s AS (SELECT package, r.rule_id, coalesce(n, 0) AS n, CAST(greatest(0, 100 - coalesce(lost, 0)) AS INTEGER) AS score FROM (SELECT DISTINCT package FROM f) CROSS JOIN r LEFT JOIN p USING (package, rule_id))
SELECT package, rule_id, n, score, score >= CASE rule_id WHEN 'QUALITY_LINT' THEN 100 ELSE 90 END AS passed FROM s""")
def rule_scores_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_linenumber") % 3
    found = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("package"),
        F.when(kind == 0, "QUALITY_SECURITY").when(kind == 1, "ARCH_COUPLING").otherwise("TEST_QUALITY_FILE_NAMING").alias("rule_id"),
        F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "warning").otherwise("info").alias("severity"),
    )
    rules = spark.createDataFrame([("QUALITY_SECURITY",), ("ARCH_COUPLING",), ("TEST_QUALITY_FILE_NAMING",), ("QUALITY_LINT",)], "rule_id string")
    return S.rule_scores(found, rules, ["package"])


@query(f"""
WITH {values("p", ["rule_id", "penalty"], sorted(S.PENALTIES.items()))},
f AS (SELECT p_size % 7 AS k, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT rule_id, penalty, row_number() OVER (ORDER BY rule_id) % 7 AS k FROM p)
SELECT rule_id, coalesce(n, 0) % 12 AS n, CAST(greatest(0, 100 - (coalesce(n, 0) % 12) * penalty) AS INTEGER) AS score FROM r LEFT JOIN f USING (k)""")
def every_rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each counting rule's penalty, over counts taken from parts."""
    rules = spark.createDataFrame([(r, p, (i + 1) % 7) for i, (r, p) in enumerate(sorted(S.PENALTIES.items()))], "rule_id string, penalty int, k int")
    f = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 7).alias("k")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)) % 12
    return rules.join(f, "k", "left").select("rule_id", n.alias("n"), S.penalty_score(n, F.col("penalty")).alias("score"))


@query("""
WITH c AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'lint' WHEN 'view' THEN 'type' WHEN 'purchase' THEN 'complexity' WHEN 'signup' THEN 'testing' ELSE 'structure' END AS category,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value) AS INTEGER) % 101 END AS score FROM events),
w(category, weight) AS (VALUES ('lint', 15), ('type', 15), ('complexity', 15), ('testing', 10)),
m AS (SELECT user_id, category, avg(score) AS mean FROM c WHERE score IS NOT NULL GROUP BY 1, 2)
SELECT user_id, sum(mean * weight) / sum(weight) AS score, count(*) AS n_categories FROM m JOIN w USING (category) GROUP BY 1""")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    category = F.when(kind == "click", "lint").when(kind == "view", "type").when(kind == "purchase", "complexity").when(kind == "signup", "testing").otherwise("structure")
    checks = table(spark, sf_dir, "events").select("user_id", category.alias("category"), F.when(F.col("event_id") % 11 == 0, None).otherwise(F.floor("value").cast("int") % 101).alias("score"))
    weights = spark.createDataFrame([(c, w) for c, w in S.CATEGORY_WEIGHTS.items()], "category string, weight int")
    return S.weighted_score(checks, weights, ["user_id"])


@query("""
WITH c AS (SELECT user_id, bool_or(event_type = 'click') AS present, avg(CASE WHEN event_type = 'click' AND value > 90 THEN value END) AS score FROM events GROUP BY 1)
SELECT user_id, CASE WHEN score IS NOT NULL THEN score WHEN present THEN 0.0 END AS score FROM c""")
def score_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = F.col("event_type") == "click"
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(click).alias("present"), F.avg(F.when(click & (F.col("value") > 90), F.col("value"))).alias("score"))
    return c.select("user_id", S.resolve_score(F.col("score"), F.col("present")).alias("score"))


@query("""
WITH c AS (SELECT o_orderpriority AS category, o_orderstatus <> 'P' AND o_totalprice > 50000 AS passed, CAST(o_orderkey % 4 + 1 AS INTEGER) AS weight FROM orders)
SELECT category, sum(CASE WHEN passed THEN weight ELSE 0 END) AS earned, sum(weight) AS total,
  CAST(round_even(sum(CASE WHEN passed THEN weight ELSE 0 END) * 100 / sum(weight), 0) AS INTEGER) AS score FROM c GROUP BY 1""", longs=("earned", "total"))
def earned_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    checks = o.select(F.col("o_orderpriority").alias("category"), ((F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 50000)).alias("passed"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("weight"))
    return S.earned_weight(checks, ["category"])


@query("""
WITH c AS (SELECT l_partkey AS rule_id, l_returnflag <> 'R' AS passed, CASE l_linestatus WHEN 'O' THEN 0 ELSE 2 END AS sev,
  CASE WHEN l_quantity < 5 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS score, l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem)
SELECT rule_id, bool_and(passed) AS passed, CASE max(sev) WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'error' END AS severity, min(score) AS score,
  first('m' || CAST(score AS VARCHAR) ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS message,
  coalesce(string_agg(CASE WHEN score > 40 THEN 't' || CAST(score AS VARCHAR) END, chr(10) ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice), '') AS text
FROM c WHERE score IS NOT NULL GROUP BY 1""")
def worst_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    score = F.when(F.col("l_quantity") < 5, None).otherwise(F.col("l_quantity").cast("int"))
    c = lines.select(
        F.col("l_partkey").alias("rule_id"),
        (F.col("l_returnflag") != "R").alias("passed"),
        F.when(F.col("l_linestatus") == "O", "info").otherwise("error").alias("severity"),
        score.alias("score"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("ordinal"),
        F.concat(F.lit("m"), score.cast("string")).alias("message"),
        F.when(score > 40, F.concat(F.lit("t"), score.cast("string"))).alias("text"),
    )
    return S.worst_of(c.where("score is not null"), ["rule_id"])


COMMITS = "SELECT DISTINCT l_orderkey AS commit_id, l_suppkey AS file FROM lineitem"
PAIRS = """WITH c AS ({src}), n AS (SELECT file, count(*) AS n FROM c GROUP BY 1),
p AS (SELECT a.file AS a, b.file AS b, count(*) AS co_changes FROM c a JOIN c b ON a.commit_id = b.commit_id AND a.file < b.file GROUP BY 1, 2)
SELECT a, b, co_changes, co_changes / greatest(x.n, y.n) AS strength FROM p JOIN n x ON x.file = a JOIN n y ON y.file = b
WHERE co_changes >= {co} AND co_changes / greatest(x.n, y.n) >= {least}"""


@query(PAIRS.format(src=COMMITS, co=3, least=0.05))
def coupling_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, suppliers as files."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("file"))
    return A.coupled_pairs(lines, min_strength=0.05, min_co_changes=3)


@query(PAIRS.format(src="SELECT DISTINCT CAST(ts AS DATE) AS commit_id, user_id AS file FROM events", co=3, least=0.9))
def coupling_users_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("commit_id"), F.col("user_id").alias("file"))
    return A.coupled_pairs(days, min_strength=0.9, min_co_changes=3)


@query(f"""WITH c AS ({COMMITS}), n AS (SELECT file, count(*) AS n FROM c GROUP BY 1),
t AS (SELECT commit_id FROM c WHERE file = 7),
p AS (SELECT c.file, count(*) AS co_changes FROM c JOIN t USING (commit_id) WHERE c.file <> 7 GROUP BY 1)
SELECT p.file, co_changes, co_changes / greatest(n.n, (SELECT count(*) FROM t)) AS strength FROM p JOIN n USING (file) WHERE co_changes >= 3""")
def coupled_files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("file"))
    return A.coupled_with(lines, 7, min_strength=0.0, min_co_changes=3)


@query("""
WITH e AS (SELECT o_custkey AS src, CAST(o_orderdate AS DATE) AS dst FROM orders)
SELECT 'out' AS side, CAST(src AS VARCHAR) AS node, count(DISTINCT dst) AS n FROM e GROUP BY src
UNION ALL SELECT 'in', CAST(dst AS VARCHAR), count(*) FROM e GROUP BY dst""")
def fan_out_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct targets of a source, all uses of a target."""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.to_date("o_orderdate").alias("dst"))
    return A.fan_out(e).select(F.lit("out").alias("side"), F.col("src").cast("string").alias("node"), "n").unionByName(A.fan_in(e).select(F.lit("in").alias("side"), F.col("dst").cast("string").alias("node"), "n"))


@query("""
WITH f AS (SELECT o_custkey AS module, count(DISTINCT CAST(o_orderdate AS DATE)) AS fan_out FROM orders GROUP BY 1),
t AS (SELECT *, CASE WHEN module % 10 = 0 THEN 18 ELSE 10 END + CASE WHEN module % 3 = 0 THEN 5 ELSE 0 END AS threshold, CASE WHEN module % 3 = 0 THEN 'orchestrator' ELSE 'leaf' END AS role FROM f)
SELECT module, role, fan_out, threshold, CASE WHEN fan_out > 2 * threshold THEN 'error' ELSE 'warning' END AS severity FROM t WHERE fan_out > threshold""")
def coupling_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.to_date("o_orderdate").alias("dst"))
    out = A.fan_out(e).select(F.col("src").alias("module"), F.col("n").alias("fan_out"))
    roles = out.select("module", F.when(F.col("module") % 3 == 0, "orchestrator").otherwise("leaf").alias("role"))
    overrides = out.where("module % 10 = 0").select("module", F.lit(18).alias("own"))
    return A.over_coupled(out, roles, overrides)


@query("""
WITH f AS (SELECT o_custkey AS src, count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders GROUP BY 1), i AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)
SELECT (SELECT max(n) FROM f) AS max_fan_out, (SELECT avg(n) FROM f) AS avg_fan_out, (SELECT max(n) FROM i) AS max_fan_in""")
def coupling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.to_date("o_orderdate").alias("dst"))
    return A.fan_out(e).agg(F.max("n").alias("max_fan_out"), F.avg("n").alias("avg_fan_out")).join(A.fan_in(e).agg(F.max("n").alias("max_fan_in")))


@query("""
WITH c AS (SELECT l_orderkey AS symbol, count(*) AS callers, count(DISTINCT l_suppkey) AS modules FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey AS symbol, coalesce(callers, 0) AS callers, coalesce(modules, 0) AS modules FROM orders LEFT JOIN c ON c.symbol = o_orderkey)
SELECT symbol, callers + modules AS points, CASE WHEN callers + modules >= 5 THEN 'HIGH' WHEN callers + modules >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS impact FROM s""")
def impact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("symbol"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("symbol"))
    return A.impact(symbols, {"callers": (lines.agg(F.count("*").alias("callers")), 1), "modules": (lines.agg(F.countDistinct("l_suppkey").alias("modules")), 1)})


@query("""
WITH w AS (SELECT n_nationkey AS project, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 5 END AS callers FROM nation WHERE n_nationkey % 3 <> 0),
c AS (SELECT c_nationkey AS project, c_custkey AS symbol, count(o_orderkey) % 4 AS callers, count(DISTINCT o_orderpriority) % 3 AS modules FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
p AS (SELECT project, symbol, c.callers * coalesce(w.callers, 1) + c.modules AS points FROM c LEFT JOIN w USING (project))
SELECT project, symbol, points, CASE WHEN points >= 5 THEN 'HIGH' WHEN points >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS impact FROM p""", longs=("points",))
def impact_weights_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact under each project's own weights; half the projects set none, or leave it null."""
    key = F.col("n_nationkey")
    w = table(spark, sf_dir, "nation").where(key % 3 != 0).select(key.alias("project"), F.when(key % 2 == 0, key % 5).alias("callers"))
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    n = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("symbol")).agg((F.count("o_orderkey") % 4).alias("callers"), (F.countDistinct("o_orderpriority") % 3).alias("modules"))
    return A.weighted_impact(n, w, {"callers": 1, "modules": 1})


@query("""
WITH r AS (SELECT o_custkey AS failure, o_orderkey AS symbol, CASE WHEN o_totalprice > 300000 THEN 2 WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS score FROM orders),
c AS (SELECT failure, symbol, l_partkey AS caller, l_suppkey AS test FROM r JOIN lineitem ON l_orderkey = symbol),
k AS (SELECT *, row_number() OVER (PARTITION BY failure ORDER BY symbol, caller) AS place FROM c),
s AS (SELECT failure, list(caller ORDER BY place) FILTER (place <= 10) AS shown, greatest(count(*) - 10, 0) AS more, count(DISTINCT test) AS tests FROM k GROUP BY 1)
SELECT failure, count(DISTINCT symbol) AS symbols, coalesce(any_value(shown), []) AS shown, coalesce(any_value(more), 0) AS more, coalesce(any_value(tests), 0) AS tests, CASE max(score) WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS score FROM r LEFT JOIN s USING (failure) GROUP BY 1""", lists=("shown",), longs=("more",))
def failure_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the symbols of a failure: callers (capped, with how many more), tests and the worst score."""
    price = F.col("o_totalprice")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("failure"), F.col("o_orderkey").alias("symbol"), F.when(price > 300000, "HIGH").when(price > 150000, "MEDIUM").otherwise("LOW").alias("score"))
    met = r.join(table(spark, sf_dir, "lineitem"), F.col("symbol") == F.col("l_orderkey")).select("failure", "symbol", F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("test"))
    return A.failure_impacts(r, met.select("failure", "symbol", "caller"), met.select("failure", "symbol", "test"))


@query("""SELECT 'dated' AS claim, count_if(l_shipdate IS NULL) AS failures, count_if(l_shipdate IS NULL) = 0 AS holds FROM lineitem UNION ALL SELECT 'discount_small', count_if(NOT l_discount < 0.1), count_if(NOT l_discount < 0.1) = 0 FROM lineitem
UNION ALL SELECT 'priced', count_if(NOT l_extendedprice > l_quantity), count_if(NOT l_extendedprice > l_quantity) = 0 FROM lineitem""", longs=("failures",))
def witnessed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about a table, with how many rows break each."""
    return A.witness(table(spark, sf_dir, "lineitem"), {"dated": F.col("l_shipdate").isNotNull(), "discount_small": F.col("l_discount") < 0.1, "priced": F.col("l_extendedprice") > F.col("l_quantity")})


@query("""SELECT 'LARGE' AS rule_id, p_partkey AS id FROM part WHERE p_size > 45 UNION ALL SELECT 'CHEAP', p_partkey FROM part WHERE p_retailprice < 950 UNION ALL SELECT 'OLD', p_partkey FROM part WHERE p_name LIKE 'old %'""")
def registered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of two categories, registered and run over parts as steps of a pipeline."""
    from corpusmill.plans import tools

    saved = {k: list(v) for k, v in tools.RULES.items()}
    tools.RULES.clear()
    try:
        found = lambda name, hit: tools.rule(name[1])(lambda facts: facts.where(hit).select(F.lit(name[0]).alias("rule_id"), F.col("p_partkey").alias("id")))
        found(("LARGE", "size"), F.col("p_size") > 45)
        found(("CHEAP", "price"), F.col("p_retailprice") < 950)
        found(("OLD", "size"), F.startswith("p_name", F.lit("old ")))
        step = tools.node(lambda facts: tools.run_rules(facts), {"facts": "parts"}, {"findings": "result"})
        return step({"parts": table(spark, sf_dir, "part")})["findings"]
    finally:
        tools.RULES.clear()
        tools.RULES.update(saved)


@query("""
SELECT substr(p_type, 1, strpos(p_type || ' ', ' ') - 1) AS prefix, count(*) AS modules, sum(p_size) AS symbols,
  list_slice(list(p_name ORDER BY p_partkey), 1, 20) AS first_names, greatest(count(*) - 20, 0) AS more FROM part GROUP BY 1""", lists=("first_names",), longs=("symbols",))
def prefix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.replace("p_type", F.lit(" "), F.lit(".")).alias("name"), F.col("p_size").alias("symbols"), F.col("p_name").alias("leaf"), F.col("p_partkey").alias("ordinal"))
    return A.rollup_prefix(p, depth=1)


@query("""
WITH g AS (SELECT md5(text) AS h, min(doc_id) AS source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT g.source, d.doc_id AS copy FROM g JOIN documents d ON md5(d.text) = g.h AND d.doc_id <> g.source""")
def clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.clone_pairs(table(spark, sf_dir, "documents"), F.md5("text"), "doc_id").select("source", "copy")


@query("""
SELECT count(*) AS n_pairs_groups, sum(n * (n - 1) // 2) AS n_pairs FROM (SELECT count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1)""", longs=("n_pairs",))
def clustered_pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("n_pairs_groups"), A.pair_count(F.col("n")).alias("n_pairs"))


@query("""
WITH k AS (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS n, lower(trim(string_split(text, chr(10))[1])) AS line FROM documents),
f AS (SELECT line, count(*) AS m FROM k WHERE line <> '' GROUP BY 1 HAVING count(*) >= 4),
b AS (SELECT CASE WHEN n > 1 THEN 'CLUSTERED' WHEN m IS NOT NULL THEN 'AMBIGUOUS' ELSE 'UNIQUE' END AS bucket FROM k LEFT JOIN f USING (line))
SELECT bucket, count(*) AS n FROM b GROUP BY 1""")
def bucket_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"), F.lower(F.trim(F.element_at(F.split("text", "\n"), 1))).alias("line"))
    clustered = d.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(True).alias("c"))
    ambiguous = A.frequent_values(d, "line", 4).select("line", F.lit(True).alias("a"))
    return A.bucket_counts(d.join(clustered, "h", "left").join(ambiguous, "line", "left"), [("CLUSTERED", F.col("c")), ("AMBIGUOUS", F.col("a"))], "UNIQUE")


@query("""
WITH k AS (SELECT lower(trim(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[1])) AS line FROM documents)
SELECT line, count(*) AS n FROM k WHERE line <> '' GROUP BY 1 HAVING count(*) >= 4""")
def first_line_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.functions.text import first_line

    return A.frequent_values(table(spark, sf_dir, "documents").select(F.lower(first_line(F.col("text"))).alias("line")), "line", 4)


@query("""
SELECT lang, CAST(floor(avg(CASE WHEN quality IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100 + 1e-9) AS INTEGER) AS score, count(*) AS n
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1""")
def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents that are labelled, as docstring coverage is scored."""
    labelled = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").join(labelled, "doc_id", "left")
    return d.groupBy("lang").agg(S.coverage_percent(F.col("quality").isNotNull()).alias("score"), F.count("*").alias("n"))


@query("""
SELECT coalesce(nullif(lang, 'es'), '(ungrouped)') AS domain, list_sort(list(DISTINCT source)) AS names FROM documents GROUP BY 1""", lists=("names",))
def names_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.nullif(F.col("lang"), F.lit("es")).alias("domain"), F.col("source").alias("name")).distinct()
    return A.names_by(d, "domain", "name")


@query("""
WITH u AS (SELECT unnest(string_split(text, chr(10))) AS line, lang FROM documents)
SELECT lang, count_if(trim(line) <> '') AS loc FROM u GROUP BY 1""", longs=("loc",))
def lines_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    loc = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long")
    return d.groupBy("lang").agg(F.sum(loc).alias("loc"))


@query("""
WITH r AS (SELECT o_custkey % 50 AS symbol, o_orderpriority AS module, CASE WHEN o_totalprice > 300000 THEN 2 WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS score FROM orders)
SELECT symbol, list_sort(list(DISTINCT module)) AS modules, CASE max(score) WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS score FROM r GROUP BY 1""", lists=("modules",))
def impact_batch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    r = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("symbol"), F.array("o_orderpriority").alias("modules"), F.when(price > 300000, "HIGH").when(price > 150000, "MEDIUM").otherwise("LOW").alias("score"))
    return A.merge_impacts(r, ["symbol"])
