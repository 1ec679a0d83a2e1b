"""Grouped metrics: coupling, fan-in and fan-out, impact, roll-ups, clones, buckets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import cut_lineage

IMPACT_ORDER = ["LOW", "MEDIUM", "HIGH"]
HIGH_AT, MEDIUM_AT = 5, 2
ORCHESTRATOR_BONUS, THRESHOLD, ERROR_FACTOR = 5, 10, 2
#: Files of a block and of a strip of it that are multiplied at once, and up to how many commits.
BLOCK, STRIP, DENSE_COMMITS = 2048, 256, 8192


def _commit_files(rows: DataFrame) -> DataFrame:
    return rows.select("commit_id", "file").where("commit_id is not null and file is not null").distinct()


def _met_pairs(c: DataFrame, own: DataFrame, min_co_changes: int) -> DataFrame:
    """(a, b, co_changes, na, nb) by one equi self-join on the commit; pairs are counted before sizes are joined."""
    a, b = c.withColumnRenamed("file", "a"), c.withColumnRenamed("file", "b")
    pairs = a.join(b, "commit_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("co_changes")).where(F.col("co_changes") >= min_co_changes)
    return pairs.join(own.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(own.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")


def _multiplied_pairs(c: DataFrame, files: int, commits: int, min_strength: float, min_co_changes: int) -> DataFrame:
    """The pairs by blocked products of the matrix of files and commits: counts are exact, every pair is compared.

    Each pair of blocks is one unit of work; units arrive one after another, so a task holds two blocks and a strip of pairs.
    """
    n = -(-files // BLOCK)
    parts = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = c.select("commit_id").distinct().withColumn("k", F.row_number().over(Window.orderBy("commit_id")) - 1)  # DENSE_COMMITS at most
    own = F.pmod(F.xxhash64("file"), F.lit(n)).cast("int")
    unit = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.least(x, own).cast("long") * n + F.greatest(x, own))
    rows = c.join(F.broadcast(numbers), "commit_id").groupBy("file").agg(F.collect_list("k").alias("held"))
    dealt = rows.select("file", "held", own.alias("block"), F.explode(unit).alias("unit"))
    kind = c.schema["file"].dataType.simpleString()

    def compare(u: int, held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks()
        file, lists, block = t.column(0).combine_chunks(), t.column(1).combine_chunks(), t.column(2).to_numpy()
        size = np.diff(lists.offsets.to_numpy())
        x = np.zeros((len(file), commits), np.float32)
        x[np.repeat(np.arange(len(file)), size), lists.flatten().to_numpy()] = 1
        rank = np.empty(len(file), np.int64)
        rank[pc.sort_indices(file).to_numpy()] = np.arange(len(file))
        left, right = np.flatnonzero(block == u // n), np.flatnonzero(block == u % n)
        for first in range(0, len(left), STRIP):
            strip = left[first : first + STRIP]
            together = x[strip] @ x[right].T
            strength = together.astype(np.float64) / np.maximum.outer(size[strip], size[right])
            ok = (together >= max(min_co_changes, 1)) & (strength >= min_strength)
            if u // n == u % n:
                ok &= rank[strip][:, None] < rank[right][None, :]
            r, s = np.nonzero(ok)
            co, strength = together[r, s].astype(np.int64), strength[r, s]
            r, s = strip[r], right[s]
            turn = rank[r] > rank[s]
            yield pa.RecordBatch.from_arrays([file.take(pa.array(np.where(turn, s, r))), file.take(pa.array(np.where(turn, r, s))), pa.array(co), pa.array(strength)], ["a", "b", "co_changes", "strength"])

    def run(batches):
        unit, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for first, stop in zip(edges, edges[1:], strict=False):
                if key[first] != unit and held:
                    yield from compare(unit, held)
                    held = []
                unit = int(key[first])
                held.append(b.slice(first, stop - first))
        if held:
            yield from compare(unit, held)

    return dealt.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(run, f"a {kind}, b {kind}, co_changes long, strength double")


def coupled_pairs(rows: DataFrame, min_strength: float = 0.3, min_co_changes: int = 3) -> DataFrame:
    """(a, b, co_changes, strength) for files that change together: shared commits over the larger number of own commits.

    Where few commits hold so many files that most pairs meet again and again, the pairs are compared as blocks of a
    matrix, else met on the commit; both compare all.
    """
    c = cut_lineage(_commit_files(rows))
    own = c.groupBy("file").agg(F.count("*").alias("n"))
    files = own.count()
    met = c.groupBy("commit_id").agg(F.count("*").cast("double").alias("n")).agg(F.count("*").alias("commits"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
    if 0 < met["commits"] <= DENSE_COMMITS and met["pairs"] >= files * files and isinstance(c.schema["file"].dataType, (T.IntegralType, T.StringType, T.DateType)):
        return _multiplied_pairs(c, files, met["commits"], min_strength, min_co_changes)
    sized = _met_pairs(c, own, min_co_changes)
    return sized.withColumn("strength", F.col("co_changes") / F.greatest("na", "nb")).where(F.col("strength") >= min_strength).select("a", "b", "co_changes", "strength")


def coupled_with(rows: DataFrame, target: object, min_strength: float = 0.3, min_co_changes: int = 3) -> DataFrame:
    """(file, co_changes, strength) of files that change with one target; empty if the target never changes."""
    c = _commit_files(rows)
    mine = c.where(F.col("file") == target).select("commit_id", F.lit(True).alias("hit"))
    counted = c.join(mine, "commit_id", "left").groupBy("file").agg(F.count("*").alias("n"), F.count_if("hit").alias("co_changes"))
    size = counted.where(F.col("file") == target).select(F.col("n").alias("target_n"))
    found = counted.where((F.col("file") != target) & (F.col("co_changes") >= min_co_changes) & (F.col("co_changes") > 0)).crossJoin(F.broadcast(size))  # one row at most
    return found.withColumn("strength", F.col("co_changes") / F.greatest("n", "target_n")).where(F.col("strength") >= min_strength).select("file", "co_changes", "strength")


def fan_out(edges: DataFrame) -> DataFrame:
    """Distinct targets of each source."""
    return edges.groupBy("src").agg(F.countDistinct("dst").alias("n"))


def fan_in(edges: DataFrame) -> DataFrame:
    """All uses of each target, repeated and outside ones included."""
    return edges.groupBy("dst").agg(F.count("*").alias("n"))


def over_coupled(fan: DataFrame, roles: DataFrame, overrides: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Modules (module, fan_out) beyond their threshold: the default or their override, plus a bonus for orchestrators."""
    limit = F.coalesce("own", F.lit(threshold)) + F.when(F.col("role") == "orchestrator", ORCHESTRATOR_BONUS).otherwise(0)
    joined = fan.join(roles, "module", "left").join(overrides, "module", "left").withColumn("threshold", limit)
    severity = F.when(F.col("fan_out") > ERROR_FACTOR * F.col("threshold"), "error").otherwise("warning")
    return joined.where("fan_out > threshold").select("module", F.coalesce("role", F.lit("leaf")).alias("role"), "fan_out", "threshold", severity.alias("severity"))


def impact(symbols: DataFrame, parts: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(symbol, points, impact): each part is pre-aggregated (symbol, count) with its weight."""
    joined = reduce(lambda d, p: d.join(p[0], "symbol", "left"), parts.values(), symbols)
    points = sum((F.coalesce(F.col(n), F.lit(0)) * w for n, (_, w) in parts.items()), F.lit(0))
    level = F.when(F.col("points") >= HIGH_AT, "HIGH").when(F.col("points") >= MEDIUM_AT, "MEDIUM").otherwise("LOW")
    return joined.select("symbol", points.alias("points")).withColumn("impact", level)


def weighted_impact(counts: DataFrame, overrides: DataFrame, defaults: dict[str, int], project: str = "project") -> DataFrame:
    """counts (project, symbol, and a count named as each default weight) with points and impact, under a project's own weights where it sets them.

    overrides: project, and any of the weights; a null and a project without a row keep the defaults.
    """
    own = overrides.select(project, *[F.col(n).alias(f"own_{n}") if n in overrides.columns else F.lit(None).cast("int").alias(f"own_{n}") for n in defaults])
    points = sum((F.coalesce(F.col(n), F.lit(0)) * F.coalesce(F.col(f"own_{n}"), F.lit(w)) for n, w in defaults.items()), F.lit(0))
    scored = counts.join(own, project, "left").select(project, "symbol", points.alias("points"))
    return scored.withColumn("impact", F.when(F.col("points") >= HIGH_AT, "HIGH").when(F.col("points") >= MEDIUM_AT, "MEDIUM").otherwise("LOW"))


def failure_impacts(reports: DataFrame, callers: DataFrame, tests: DataFrame, most: int = 10) -> DataFrame:
    """(failure, symbols, shown, more, tests, score): what the symbols of a failure touch.

    reports: failure, symbol, score; callers: failure, symbol, caller; tests: failure, symbol, test. The first `most`
    callers are shown, by symbol and name, with how many more there are; tests are counted once; the score is the
    highest. Callers are ranked before they are gathered, so no more than `most` are.
    """
    from pyspark.sql import Window

    order = F.array(*map(F.lit, IMPACT_ORDER))
    head = reports.groupBy("failure").agg(F.countDistinct("symbol").alias("symbols"), F.element_at(order, F.max(F.array_position(order, F.col("score"))).cast("int")).alias("score"))
    w = Window.partitionBy("failure")
    ranked = callers.select("failure", "caller", F.row_number().over(w.orderBy("symbol", "caller")).alias("place"), F.count("*").over(w).alias("total")).where(F.col("place") <= most)
    first = F.transform(F.array_sort(F.collect_list(F.struct("place", "caller"))), lambda x: x["caller"])
    shown = ranked.groupBy("failure").agg(first.alias("shown"), F.greatest(F.max("total") - most, F.lit(0)).alias("more"))
    seen = tests.groupBy("failure").agg(F.countDistinct("test").alias("tests"))
    zero = F.lit(0)
    out = head.join(shown, "failure", "left").join(seen, "failure", "left")
    return out.select("failure", "symbols", F.coalesce("shown", F.array().cast(shown.schema["shown"].dataType)).alias("shown"), F.coalesce("more", zero).alias("more"), F.coalesce("tests", zero).alias("tests"), "score")


def witness(rows: DataFrame, claims: dict[str, Column]) -> DataFrame:
    """(claim, failures, holds): how many rows break each claim; a claim that is null for a row is broken by it. One pass over the rows."""
    counted = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in claims.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("claim"), F.col(n).alias("failures")) for n in claims])
    return counted.select(F.inline(pairs)).withColumn("holds", F.col("failures") == 0)


def merge_impacts(reports: DataFrame, by: list[str]) -> DataFrame:
    """Reports (modules array, score) merged: sorted distinct modules, highest score."""
    rank = F.array_position(F.array(*map(F.lit, IMPACT_ORDER)), F.col("score"))
    exploded = reports.select(*by, F.explode_outer("modules").alias("module"), rank.alias("rank"))
    return exploded.groupBy(*by).agg(F.array_sort(F.collect_set("module")).alias("modules"), F.element_at(F.array(*map(F.lit, IMPACT_ORDER)), F.max("rank").cast("int")).alias("score"))


def rollup_prefix(modules: DataFrame, depth: int, most: int = 20) -> DataFrame:
    """modules (name, symbols, leaf, ordinal) by the first `depth` dotted segments, with the first names and how many more there are.

    Names are ranked within their group first, so a group keeps no more than it shows.
    """
    from pyspark.sql import Window

    m = modules.withColumn("prefix", F.substring_index("name", ".", depth))
    ranked = m.withColumn("k", F.row_number().over(Window.partitionBy("prefix").orderBy("ordinal")))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "leaf")))), lambda x: x["leaf"])
    return ranked.groupBy("prefix").agg(F.count("*").alias("modules"), F.sum("symbols").alias("symbols"), first.alias("first_names"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))


def clone_pairs(rows: DataFrame, fingerprint: Column, id_col: str) -> DataFrame:
    """(source, copy, fingerprint): every row but the first of each group of equal fingerprints, with the first."""
    r = rows.select(F.col(id_col).alias("copy"), fingerprint.alias("fingerprint"))
    first = r.groupBy("fingerprint").agg(F.min("copy").alias("source"), F.count("*").alias("n")).where("n > 1")
    return r.join(first, "fingerprint").where("copy <> source").select("source", "copy", "fingerprint")


def pair_count(n: Column) -> Column:
    return F.sum((n * (n - 1) / 2).cast("long"))


def frequent_values(rows: DataFrame, column: str, least: int) -> DataFrame:
    return rows.where(F.col(column) != "").groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def bucket_counts(rows: DataFrame, flags: list[tuple[str, Column]], rest: str) -> DataFrame:
    """Rows by the first flag that holds."""
    bucket = F.lit(rest)
    for name, flag in reversed(flags):
        bucket = F.when(F.coalesce(flag, F.lit(False)), name).otherwise(bucket)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def names_by(rows: DataFrame, domain: str, name: str, missing: str = "(ungrouped)") -> DataFrame:
    return rows.groupBy(F.coalesce(domain, F.lit(missing)).alias("domain")).agg(F.array_sort(F.collect_set(name)).alias("names"))
