"""Penalty scores, weighted roll-ups and grades as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: lowest score of each grade, by grade table
GRADES = {
    "audit": [(90, "A"), (80, "B"), (70, "C"), (60, "D")],
    "governance": [(90, "A"), (75, "B"), (60, "C"), (40, "D")],
}
# fixed values: weight of each scored category, in hundredths
CATEGORY_WEIGHTS = {"lint": 15, "type": 15, "complexity": 15, "testing": 10, "test_quality": 10, "security": 10, "deps": 10, "architecture": 10, "practices": 5}
# fixed values: points lost for each finding, by rule
PENALTIES = {
    "QUALITY_LINT": 2,
    "QUALITY_FORMAT": 5,
    "QUALITY_TYPE": 5,
    "QUALITY_DEAD_CODE": 5,
    "QUALITY_COMPLEXITY": 10,
    "PRACTICE_SECURITY": 25,
    "DEPS_AUDIT": 15,
    "DEPS_HYGIENE": 10,
    "ARCH_CIRCULAR": 20,
    "ARCH_GOD_CLASS": 15,
    "ARCH_DUPLICATION": 10,
    "PRACTICE_BARE_EXCEPT": 20,
    "PRACTICE_BLOCKING_IO": 15,
    "PRACTICE_TEST_MIRROR": 15,
    "PRACTICE_TEST_SCENARIO_NAMING": 15,
    "TEST_QUALITY_DUPLICATE_TESTS": 5,
    "TEST_QUALITY_TAUTOLOGY": 2,
    "TEST_QUALITY_PYRAMID_LEVEL": 2,
    "TEST_QUALITY_PRIVATE_IMPORTS": 5,
    "TEST_QUALITY_NO_PACKAGE_SYMBOL": 2,
}
# rules whose findings weigh by severity: points for a finding of each severity
SEVERITY_PENALTIES = {
    "QUALITY_SECURITY": {"high": 15, "medium": 5},
    "ARCH_COUPLING": {"error": 5, "warning": 3},
    "TEST_QUALITY_FILE_NAMING": {"warning": 3, "info": 1},
}
PASS_AT, LINT_PASS_AT, DOCSTRING_PASS_AT = 90, 100, 0.80
SEVERITY_ORDER = ["info", "warning", "error"]


def penalty_score(count: Column, penalty: Column | int) -> Column:
    """100 less a fixed penalty a finding, not below 0."""
    return F.greatest(F.lit(0), F.lit(100) - count * penalty).cast("int")


def linear_score(value: Column, ideal: int = 400, most: int = 1200) -> Column:
    """100 up to `ideal`, 0 from `most`, linear and truncated between."""
    return F.when(value <= ideal, 100).when(value >= most, 0).otherwise(F.floor(F.lit(100) - (value - ideal) * 100 / (most - ideal))).cast("int")


def grade(score: Column, table: str = "audit") -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES[table]):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return F.when(score.isNotNull(), out)


def rule_scores(findings: DataFrame, rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(rule_id, n, score, passed) for every rule of `rules`, from findings (rule_id, severity); with `by`, for each project that has a finding.

    A rule without findings scores 100. Rules that weigh by severity add their points; all others count.
    """
    keys = by or []
    points = F.lit(None).cast("int")
    for rule, penalty in PENALTIES.items():
        points = F.when(F.col("rule_id") == rule, penalty).otherwise(points)
    for rule, worth in SEVERITY_PENALTIES.items():
        own = F.lit(0)
        for severity, penalty in worth.items():
            own = F.when(F.col("severity") == severity, penalty).otherwise(own)
        points = F.when(F.col("rule_id") == rule, own).otherwise(points)
    lost = findings.groupBy(*keys, "rule_id").agg(F.count("*").alias("n"), F.sum(points).alias("lost"))
    every = rules.select("rule_id").distinct()
    if keys:
        every = findings.select(*keys).distinct().crossJoin(F.broadcast(every))  # a rule set is a short table
    out = every.join(lost, [*keys, "rule_id"], "left")
    score = F.greatest(F.lit(0), F.lit(100) - F.coalesce("lost", F.lit(0))).cast("int")
    need = F.when(F.col("rule_id") == "QUALITY_LINT", LINT_PASS_AT).otherwise(PASS_AT)
    return out.select(*keys, "rule_id", F.coalesce("n", F.lit(0)).alias("n"), score.alias("score"), (score >= need).alias("passed"))


def weighted_score(checks: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean score of each category, weighted, over the weights of the categories present.

    checks: category, score (null scores are dropped), and the columns `by`. weights: category, weight.
    Categories without a weight are ignored. The sum and its divisor are kept beside the unrounded score.
    """
    by = by or []
    means = checks.where(F.col("score").isNotNull()).groupBy(*by, "category").agg(F.avg("score").alias("mean"))
    joined = means.join(weights, "category")
    return joined.groupBy(*by).agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("score"), F.count("*").alias("n_categories"))


def resolve_score(score: Column, scored_present: Column) -> Column:
    """A scored category that was present but never measured counts 0; without one there is no score."""
    return F.when(score.isNotNull(), score).when(scored_present, F.lit(0.0))


def earned_weight(checks: DataFrame, by: list[str]) -> DataFrame:
    """Earned and total weight of weighted pass/fail checks, with the percentage unrounded and rounded half to even."""
    earned = F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0))
    out = checks.groupBy(*by).agg(earned.alias("earned"), F.sum("weight").alias("total"))
    ratio = F.when(F.col("total") > 0, F.col("earned") * 100 / F.col("total")).otherwise(F.lit(0.0))
    return out.withColumn("score", F.bround(ratio, 0).cast("int"))


def worst_of(checks: DataFrame, by: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Several results of one rule merged: all must pass, worst severity, least score, texts in order, first message."""
    rank = F.lit(-1)
    for i, s in enumerate(SEVERITY_ORDER):
        rank = F.when(F.col("severity") == s, i).otherwise(rank)
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(ordinal, "text")))), lambda x: x["text"])
    worst = F.element_at(F.array(*map(F.lit, SEVERITY_ORDER)), F.max(rank) + 1)
    return checks.groupBy(*by).agg(F.bool_and("passed").alias("passed"), worst.alias("severity"), F.min("score").alias("score"), F.min_by("message", ordinal).alias("message"), F.array_join(texts, "\n").alias("text"))


def coverage_percent(flag: Column) -> Column:
    """int(100 * share of rows with the flag); 100 for none."""
    return F.when(F.count(flag) == 0, 100).otherwise(F.floor(F.avg(flag.cast("double")) * 100 + F.lit(1e-9))).cast("int")
