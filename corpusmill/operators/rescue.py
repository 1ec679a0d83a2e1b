"""What makes two alike tests only ambiguously so: ordered conditions over features of both."""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.similarity import jaccard
from corpusmill.session import cut_lineage, release

FEATURES = "path string, name string, class_name string, line int, body int, call_sig string, literals array<string>, patches array<string>, calls array<string>, attributes array<string>, statements array<string>, setup array<string>, raises boolean"
#: Features, and whether a call's name holds "raises", which test_pairs goes by.
SCAN = FEATURES + ", called boolean"
# fixed values: thresholds of the conditions, and calls that are never what a test is about
LITERALS, TOKEN, TEMPLATE_BODY, SMALL_BODY, FAR, STRONG, SHARED, SETUP = 2, 4, 4, 8, 200, 0.85, 3, 0.5
GENERIC = ["len", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "sorted", "sum", "min", "max", "any", "all", "range", "print", "isinstance", "open", "mkdir", "write_text", "read_text", "raises", "approx", "fixture"]
# fixed values: which conditions each signal tries, in order
ORDER = {
    "same_calls": ["distinct_literals", "patch_context", "setup_divergence", "call_multiplicity", "distinct_sut", "distinct_class", "raises_divergence", "locality"],
    "same_name": ["distinct_literals", "template_pair", "patch_context", "distinct_sut", "distinct_class", "raises_divergence"],
    "same_file": ["distinct_literals", "patch_context", "body_size", "setup_divergence", "call_multiplicity", "distinct_sut", "distinct_class", "raises_divergence", "locality"],
}


def features(path: str, source: str) -> list[tuple]:
    return [row[:-1] for row in scan(path, source)]


def scan(path: str, source: str) -> list[tuple]:
    """Rows of SCAN: what the features and the pairs of tests need, from one parse."""
    from corpusmill.sources.python_rules import FUNCTIONS, _blank, _name, statements

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    leaf = lambda n: n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
    out = []
    for owner, body in [(None, tree.body), *((c.name, c.body) for c in tree.body if isinstance(c, ast.ClassDef))]:
        for f in body:
            if not (isinstance(f, FUNCTIONS) and f.name.startswith("test_")):
                continue
            calls = [n for n in ast.walk(f) if isinstance(n, ast.Call)]
            asserts = [n for n in ast.walk(f) if isinstance(n, ast.Assert)]
            used = {x.id for a in asserts for x in ast.walk(a) if isinstance(x, ast.Name)}
            setup = {_blank(s) for s in f.body if not isinstance(s, ast.Assert) and not ({x.id for x in ast.walk(s) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)} & used)}
            out.append((
                path, f.name, owner, f.lineno, len(list(ast.iter_child_nodes(f))), "; ".join(ast.unparse(c) for c in calls),
                sorted({str(n.value) for n in ast.walk(f) if isinstance(n, ast.Constant) and isinstance(n.value, (str, bytes))}),
                sorted({ast.unparse(c.args[0]) for c in calls if leaf(c) == "patch" and c.args}),
                sorted(n for c in calls if (n := leaf(c)) and n not in GENERIC),
                sorted({x.attr for a in asserts for x in ast.walk(a) if isinstance(x, ast.Attribute)}),
                sorted(statements(f.body)), sorted(setup), any(leaf(c) == "raises" for c in calls), any("raises" in _name(c.func) for c in calls),
            ))
    return out


#: The condition that must hold for every pair of a cluster; any other is enough in one.
EVERY = "locality"


def _less(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b))


#: Conditions that take two sets, from the sets of both tests.
SETS = {
    "distinct_literals": ("literals", lambda a, b: (_less(a, b) >= LITERALS) & (_less(b, a) >= LITERALS)),
    "setup_divergence": ("setup", lambda a, b: jaccard(a, b) < SETUP),
    "distinct_sut": ("calls", lambda a, b: (_less(a, b) > 0) & (_less(b, a) > 0)),
}


def _apart(a: str, b: str) -> Column:
    """Locality, over the columns of two tests, whose names end in a and b."""
    x, y = (lambda c: F.col(f"{c}_{a}")), (lambda c: F.col(f"{c}_{b}"))
    common = lambda c: F.size(F.array_intersect(x(c), y(c)))
    strong = (jaccard(x("statements"), y("statements")) >= STRONG) | (common("attributes") >= SHARED) | ((x("call_sig") == y("call_sig")) & (x("call_sig") != "") & (common("literals") >= SHARED))
    return F.coalesce((F.abs(x("line") - y("line")) > FAR) & ~strong, F.lit(False))


def _tried(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("signal").isin([s for s, names in ORDER.items() if name in names]))


def _differ(value: Column, of: Column | None = None) -> Column:
    """Whether two tests of different keys differ in a value that neither lacks, over the rows of a cluster (of: that meet a condition)."""
    value = value if of is None else F.when(of, value)
    key = F.when(value.isNotNull(), F.col("key"))
    return F.coalesce((F.min(value) != F.max(value)) & (F.min(key) != F.max(key)), F.lit(False))


def _sets_differ(rows: DataFrame, name: str) -> DataFrame:
    """Clusters in which the sets of two tests meet a condition of SETS.

    A cluster's different sets are held against its smallest, and for calls each against the next larger one, which tells
    most clusters; pairs of different sets are left only for those that this tells nothing of.
    """
    column, holds = SETS[name]
    g = ["signal", "cluster"]
    sets = _tried(rows, name).withColumn("s", F.array_sort(F.array_distinct(column))).where("s is not null")
    if name == "distinct_literals":
        sets = sets.where(F.size("s") >= LITERALS)
    sets = sets.groupBy(*g, "s").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    if name == "distinct_sut":  # no two are so if they are one chain of subsets
        w = Window.partitionBy(*g).orderBy(F.size("s"), "s")
        near = sets.select(*g, "s", "lo", "hi", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("s", "lo", "hi")]).where("p_s is not null")
        doubt = holds(F.col("p_s"), F.col("s"))
    else:
        least = sets.groupBy(*g).agg(F.min(F.struct(F.size("s"), "s", "lo", "hi")).alias("p"), F.count("*").alias("n")).where("n > 1").select(*g, *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("s", "lo", "hi")])
        near = sets.join(least.hint("merge"), g).where("s <> p_s")
        # sets within half the distance of a third are within it of each other
        doubt = F.lit(True) if name == "distinct_literals" else jaccard(F.col("p_s"), F.col("s")) < (1 + SETUP) / 2
    keys = lambda x, y: F.least(f"{x}lo", f"{y}lo") != F.greatest(f"{x}hi", f"{y}hi")
    seen = near.groupBy(*g).agg(F.bool_or(holds(F.col("p_s"), F.col("s")) & keys("p_", "")).alias("found"), F.bool_or(doubt).alias("doubt"))
    left = sets.join(seen.where("doubt and not found").select(*g).hint("merge"), g)
    x, y = (left.select(*g, *[F.col(c).alias(f"{s}_{c}") for c in ("s", "lo", "hi")]) for s in ("x", "y"))
    pairs = x.join(y.hint("merge"), g).where((F.col("x_s") < F.col("y_s")) & holds(F.col("x_s"), F.col("y_s")) & keys("x_", "y_"))
    return seen.where("found").select(*g).unionByName(pairs.select(*g).distinct())


def judge(members: DataFrame, tests: DataFrame) -> DataFrame:
    """(signal, cluster, told) from members (signal, test, cluster) and the features of tests; told: cluster (its first
    test), size and verdict, the first condition of the signal that holds for the cluster, as ambiguous_*, else the signal.

    All pairs of a cluster count, those that no signal named too, but clusters can be large, so what pairs hold is told from
    least and greatest values, counts and different sets. Locality needs tests far apart in line, so of such a cluster
    no more than its lines hold, and only there pairs are met. No side is ever broadcast: all grow with the sources,
    and sizes of parsed tables are guesses.
    """
    g = ["signal", "cluster"]
    key = F.concat_ws("::", "path", F.concat_ws(".", "class_name", "name"))
    features = cut_lineage(tests.select("*", key.alias("key")))
    once = features.withColumn("once", F.row_number().over(Window.partitionBy("key").orderBy("line")) == 1)
    rows = members.join(once.hint("merge"), members.test == once.key)
    tokens = F.split(F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.py$", 1), "^test_", ""), "_")
    own = {
        "patch_context": _differ(F.col("patches")),
        "template_pair": _differ(F.array_sort(F.array_distinct(F.filter(tokens, lambda t: F.char_length(t) >= TOKEN))), F.col("body") <= TEMPLATE_BODY),
        "body_size": _differ(F.col("body"), F.col("body") <= SMALL_BODY),
        "distinct_class": _differ(F.col("class_name")),
        "raises_divergence": _differ(F.col("raises")),
    }
    # n tests that are all more than FAR apart fill more than FAR * (n - 1) lines
    spread = F.coalesce((F.max("line") - F.min("line") > FAR * (F.count_if("once") - 1)) & (F.count("line") == F.count("*")), F.lit(False))
    judged = rows.groupBy(*g).agg(*[c.alias(n) for n, c in own.items()], spread.alias("spread"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").drop("lo", "hi")
    public = F.filter("calls", lambda n: ~F.startswith(n, F.lit("_")))
    calls = _tried(rows, "call_multiplicity").select(*g, "key", "calls", F.explode(F.array_distinct(public)).alias("call")).withColumn("times", F.size(F.filter("calls", lambda z: z == F.col("call"))))
    found = {n: _sets_differ(rows, n) for n in SETS}
    found["call_multiplicity"] = calls.groupBy(*g, "call").agg(_differ(F.col("times")).alias("held")).where("held").select(*g).distinct()
    far = _tried(rows, EVERY).join(judged.where("spread").select(*g).hint("merge"), g)
    x, y = (far.select(*g, *[F.col(c).alias(f"{c}_{s}") for c in ("key", "line", "statements", "attributes", "call_sig", "literals")]) for s in ("a", "b"))
    found[EVERY] = x.join(y.hint("merge"), g).where("key_a < key_b").groupBy(*g).agg(F.bool_and(_apart("a", "b")).alias("held")).where("held").select(*g)
    held = reduce(DataFrame.unionByName, [d.withColumn("name", F.lit(n)) for n, d in found.items()]).groupBy(*g).agg(F.collect_set("name").alias("held"))
    holds = lambda n: F.col(n) if n in own else F.coalesce(F.array_contains("held", n), F.lit(False))
    verdict = F.col("signal")
    for signal, names in ORDER.items():
        one = F.lit(signal)
        for n in reversed(names):
            one = F.when(holds(n), f"ambiguous_{n}").otherwise(one)
        verdict = F.when(F.col("signal") == signal, one).otherwise(verdict)
    size = members.groupBy(*g).agg(F.min("test").alias("first"), F.count("*").alias("size"))
    told = judged.join(held.hint("merge"), g, "left").join(size.hint("merge"), g)
    told = cut_lineage(told.select(*g, F.struct(F.col("first").alias("cluster"), "size", verdict.alias("verdict")).alias("told")))
    release(features)
    return told


def rescue(pairs: DataFrame, tests: DataFrame) -> DataFrame:
    """pairs (a, b, signal) with cluster (its first test), size and verdict, as `judge` tells them.

    A cluster is what pairs of one signal connect. Given pairs are shuffled; test_pairs with `judge` needs no shuffle of pairs.
    """
    from corpusmill.operators.graph import connected_components

    # a test that stands in clusters of two signals is a node in each
    node = lambda c: F.struct("signal", F.col(c).alias("test"))
    found = cut_lineage(connected_components(pairs.select(node("a").alias("src"), node("b").alias("dst"))))
    members = found.select("node.signal", "node.test", F.col("component.test").alias("cluster"))
    told = judge(members, tests)
    return pairs.join(members.withColumnRenamed("test", "a").hint("merge"), ["signal", "a"]).join(told.hint("merge"), ["signal", "cluster"]).select("a", "b", "signal", "told.*")
