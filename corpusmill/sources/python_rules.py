"""Findings and test features of Python sources, one scan of the syntax tree a file."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.similarity import jaccard
from corpusmill.session import cut_lineage, release

FINDING = "path string, rule_id string, name string, line int, severity string, detail string"
METRIC = "path string, class_name string, name string, line int, n_lines int, cyclomatic int, cognitive int, fingerprint string"
TEST = "path string, name string, class_name string, line int, call_sig string, assert_pattern string, raises boolean, statements array<string>"
HTTP, VERBS = {"requests", "httpx"}, {"get", "post", "put", "patch", "delete", "head", "options", "request"}
BRANCHES = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert, ast.comprehension)
NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: What makes two tests alike, in the order in which a pair is claimed.
SIGNALS = ["same_name", "same_file", "same_calls", "raises"]


def cyclomatic(f: ast.AST) -> int:
    """One, plus one a branch and each further operand of a boolean."""
    return 1 + sum(isinstance(n, BRANCHES) for n in ast.walk(f)) + sum(len(n.values) - 1 for n in ast.walk(f) if isinstance(n, ast.BoolOp)) + sum(len(n.cases) for n in ast.walk(f) if isinstance(n, ast.Match))


def cognitive(f: ast.AST) -> int:
    """One a break in the flow and as much more as it is nested deep; one a run of boolean operators."""

    def walk(node: ast.AST, depth: int, chained: bool = False) -> int:
        total = 0
        if isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Match)):
            total += 1 if chained else 1 + depth
        if isinstance(node, ast.BoolOp):
            total += 1
        inner = depth + isinstance(node, (*NESTING, *FUNCTIONS, ast.Lambda))
        if isinstance(node, ast.If):
            total += walk(node.test, depth) + sum(walk(x, depth + 1) for x in node.body)
            if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If):
                return total + walk(node.orelse[0], depth, True)
            return total + bool(node.orelse) + sum(walk(x, depth + 1) for x in node.orelse)
        return total + sum(walk(c, inner) for c in ast.iter_child_nodes(node))

    return sum(walk(x, 0) for x in getattr(f, "body", []))


def _name(node: ast.AST) -> str:
    return ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""


def _always(test: ast.AST) -> str | None:
    """Why an assertion cannot fail."""
    if isinstance(test, ast.Constant):
        return "constant" if test.value else None
    if isinstance(test, ast.Compare) and len(test.ops) == 1:
        same = ast.dump(test.left) == ast.dump(test.comparators[0])
        if same and isinstance(test.ops[0], (ast.Eq, ast.Is, ast.LtE, ast.GtE)):
            return "compares itself"
    if isinstance(test, ast.BoolOp) and isinstance(test.op, ast.Or) and any(_always(v) for v in test.values):
        return "constant"
    if isinstance(test, ast.Call) and _name(test.func) == "isinstance" and len(test.args) == 2 and _name(test.args[1]) == "object":
        return "any object"
    return None


def findings(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple] = []
    add = lambda rule, name, node, severity, detail: out.append((path, rule, name, node.lineno, severity, detail))
    is_test = path.rsplit("/", 1)[-1].startswith("test_")

    def walk(node: ast.AST, owner: str | None, is_async: bool) -> None:
        if isinstance(node, FUNCTIONS):
            owner, is_async = node.name, isinstance(node, ast.AsyncFunctionDef)
        if isinstance(node, ast.ExceptHandler) and node.type is None:
            add("PRACTICE_BARE_EXCEPT", owner, node, "error", "except without a type")
        if isinstance(node, ast.Call):
            called = _name(node.func)
            if is_async and called == "time.sleep":
                add("PRACTICE_BLOCKING_IO", owner, node, "warning", "sleep in async")
            lead, _, verb = called.rpartition(".")
            if lead in HTTP and verb in VERBS and not any(k.arg == "timeout" for k in node.keywords):
                add("PRACTICE_BLOCKING_IO", owner, node, "warning", "no timeout")
        if is_test and isinstance(node, ast.ImportFrom):
            for a in node.names:
                if a.name.startswith("_") and not a.name.startswith("__") and not a.name.isupper():
                    add("TEST_QUALITY_PRIVATE_IMPORTS", a.name, node, "warning", node.module or ".")
        if is_test and isinstance(node, ast.Assert) and (why := _always(node.test)):
            add("TEST_QUALITY_TAUTOLOGY", owner, node, "warning", why)
        for c in ast.iter_child_nodes(node):
            walk(c, owner, is_async)

    walk(tree, None, False)
    return out


def metrics(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def walk(node: ast.AST, owner: str | None) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, FUNCTIONS):
                body = c.body[1:] if ast.get_docstring(c) is not None else c.body
                plain = type(c)(**{k: getattr(c, k) for k in c._fields} | {"body": body or [ast.Pass()]})
                out.append((path, owner, c.name, c.lineno, c.end_lineno - c.lineno + 1, cyclomatic(c), cognitive(c), ast.dump(plain)))
            walk(c, c.name if isinstance(c, ast.ClassDef) else owner)

    walk(tree, None)
    return out


class Blank(ast.NodeTransformer):
    def visit_Name(self, n):
        return ast.copy_location(ast.Name("_", n.ctx), n)

    def visit_Constant(self, n):
        return ast.copy_location(ast.Constant(0), n)


def _shown(node: object) -> str:
    """A tree as text, names and constants blanked; no copy is made."""
    if isinstance(node, ast.Name):
        return type(node.ctx).__name__
    if isinstance(node, ast.Constant):
        return "0"
    if isinstance(node, ast.AST):
        return f"{type(node).__name__}({','.join([_shown(getattr(node, f, None)) for f in node._fields])})"
    if isinstance(node, list):
        return f"[{','.join(map(_shown, node))}]"
    return repr(node)


def _blank(node: ast.AST) -> str:
    """A statement with names and constants blanked. Formatted strings are written out and read again, as one text can be cut in several ways."""
    if any(isinstance(n, ast.JoinedStr) for n in ast.walk(node)):
        return ast.dump(Blank().visit(ast.parse(ast.unparse(node))))
    return _shown(node)


def statements(body: list[ast.stmt]) -> set[str]:
    """Blanked statements of a body, those in blocks taken out of them."""
    out: set[str] = set()
    for s in body:
        inner = [x for f in ("body", "orelse", "finalbody") for x in getattr(s, f, [])] + [x for h in getattr(s, "handlers", []) for x in h.body]
        out |= statements(inner) if inner and not isinstance(s, (*FUNCTIONS, ast.ClassDef)) else {_blank(s)}
    return out


def tests(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for owner, body in [(None, tree.body), *((c.name, c.body) for c in tree.body if isinstance(c, ast.ClassDef))]:
        for f in body:
            if isinstance(f, FUNCTIONS) and f.name.startswith("test_"):
                calls = [ast.unparse(n) for n in ast.walk(f) if isinstance(n, ast.Call)]
                asserts = [_blank(n) for n in ast.walk(f) if isinstance(n, ast.Assert)]
                raises = any("raises" in _name(n.func) for n in ast.walk(f) if isinstance(n, ast.Call))
                out.append((path, f.name, owner, f.lineno, "; ".join(calls), "; ".join(asserts), raises, sorted(statements(f.body))))
    return out


def _scan(files: DataFrame, read, schema: str, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for p, t in zip(b["path"], b["text"], strict=True) for x in read(p, t or "")], columns=columns)

    return files.select("path", "text").mapInPandas(run, schema)


def scan_findings(files: DataFrame) -> DataFrame:
    return _scan(files, findings, FINDING, ["path", "rule_id", "name", "line", "severity", "detail"])


def scan_metrics(files: DataFrame) -> DataFrame:
    return _scan(files, metrics, METRIC, ["path", "class_name", "name", "line", "n_lines", "cyclomatic", "cognitive", "fingerprint"])


def scan_tests(files: DataFrame) -> DataFrame:
    return _scan(files, tests, TEST, ["path", "name", "class_name", "line", "call_sig", "assert_pattern", "raises", "statements"])


def complexity_reason(cyclomatic: Column, cognitive: Column) -> Column:
    """cc for a rank of C or worse (above 10), cog for a cognitive score above 15, both, or null."""
    return F.nullif(F.concat_ws("+", F.when(cyclomatic > 10, "cc"), F.when(cognitive > 15, "cog")), F.lit(""))


def pyramid_level(real_io: Column, in_package_process: Column, public: Column, internal: Column) -> Column:
    """Ordered decision; the public-only unit case comes before real I/O."""
    return F.when(in_package_process, "e2e").when(~real_io & public & ~internal, "unit").when(real_io, "integration").otherwise("unit")


def _keyed(t: DataFrame) -> DataFrame:
    """Tests with their key, its `id`, digests of their statements, the set of these as `shape`, and whether the key is `repeated`; read once.

    Rows without calls that do not raise have no `calls`, and meet no other by them. Of the rows of a key one `leads`.
    """
    called = F.when((F.col("call_sig") != "") | F.col("raises"), F.col("call_sig"))
    t = t.select(F.concat_ws("::", "path", F.concat_ws(".", "class_name", "name")).alias("key"), "path", "name", called.alias("calls"), F.array_sort(F.array_distinct(F.transform("statements", F.md5))).alias("statements"))
    t = t.withColumn("shape", F.sha2(F.to_json(F.struct("statements")), 256))
    own = Window.partitionBy("key")
    t = t.withColumn("repeated", F.count("*").over(own) > 1).withColumn("row", F.monotonically_increasing_id()).withColumn("id", F.min("row").over(own))
    return cut_lineage(t.withColumn("leads", F.col("row") == F.col("id")).drop("row"))


def _told(x: DataFrame) -> list[str]:
    return [c for c in x.columns if c.startswith("told")]


def _pair(d: DataFrame, order: Column) -> DataFrame:
    """key_a, key_b and order of a pair, and what is told of its cluster, if anything is."""
    signal = F.element_at(F.array(*map(F.lit, SIGNALS)), order + 1)
    return d.select("key_a", "key_b", order.alias("order"), *[F.col(c)[signal].alias("told") for c in _told(d) if c == "told_a"])


def _sides(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    columns = ("key", "path", "name", "calls", "statements", "shape", *_told(x))
    return tuple(d.select(*[F.col(c).alias(f"{c}_{s}") for c in columns]) for d, s in ((x, "a"), (y, "b")))


def _meet(x: DataFrame, y: DataFrame, *on: str) -> DataFrame:
    """An equi join of two sides. Few rows make many pairs, so it is cut by its keys into as many parts as a shuffle has, and never broadcast."""
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = (d.repartition(n, *[f"{c}_{s}" for c in on]) for d, s in ((x, "a"), (y, "b")))
    same = [F.col(f"{c}_a") == F.col(f"{c}_b") for c in on]
    return x.hint("merge").join(y, reduce(and_, same))


def _by_file(x: DataFrame, y: DataFrame, within: float) -> DataFrame:
    """Pairs of one file: alike statements, else the same calls."""
    like = F.arrays_overlap("statements_a", "statements_b") & (jaccard(F.col("statements_a"), F.col("statements_b")) >= within)
    order = F.when(like, 1).when(F.col("calls_a") == F.col("calls_b"), F.when(F.col("calls_a") != "", 2).otherwise(3))
    return _pair(_meet(x, y, "path").where("key_a < key_b"), order).where("order is not null")


def _first_signals(one: DataFrame, other: DataFrame, across: float, within: float) -> DataFrame:
    """(key_a, key_b, order) of pairs of rows with key_a < key_b, one row a pair: each signal leaves out what an earlier one claims."""
    x, y = _sides(one, other)
    like = F.coalesce(jaccard(F.col("statements_a"), F.col("statements_b")) >= across, F.lit(False))
    # sets of statements that a name has are compared once, then their tests meet
    u, v = (d.groupBy(f"name_{s}", f"shape_{s}").agg(F.first(f"statements_{s}").alias(f"statements_{s}")) for d, s in ((x, "a"), (y, "b")))
    alike = u.hint("merge").join(v, F.col("name_a") == F.col("name_b")).where(like).select(F.col("name_a").alias("name"), F.col("shape_a").alias("shape"), "shape_b")
    told = [c for c in x.columns if c == "told_a"]
    named = x.select("key_a", "path_a", *told, F.col("name_a").alias("name"), F.col("shape_a").alias("shape")).join(alike.hint("merge"), ["name", "shape"]).select("key_a", "path_a", *told, F.col("name").alias("name_a"), F.col("shape_b").alias("shape_a"))
    same_name = _pair(_meet(named, y.select("key_b", "path_b", "name_b", "shape_b"), "name", "shape").where("path_a <> path_b and key_a < key_b"), F.lit(0))
    claimed = F.when((F.col("name_a") == F.col("name_b")) & (F.col("path_a") != F.col("path_b")), like).otherwise(F.lit(False))
    apart = ~F.coalesce(F.col("path_a") == F.col("path_b"), F.lit(False))
    light = lambda d, s, *more: d.select(*[f"{c}_{s}" for c in ("key", "path", "name", "calls", "statements")], *more)
    same_calls = _pair(_meet(light(x, "a", *told), light(y, "b"), "calls").where((F.col("key_a") < F.col("key_b")) & apart & ~claimed), F.when(F.col("calls_a") != "", 2).otherwise(3))
    return same_name.unionByName(_by_file(x, y, within)).unionByName(same_calls)


def _repeated_pairs(t: DataFrame, across: float, within: float) -> DataFrame | None:
    """(a, b, order) of the pairs that touch a key of several rows, and what is told of them, or None: only these can come more than once."""
    plain, several = t.where("not repeated"), t.where("repeated")
    if several.isEmpty():
        return None
    every = _first_signals(several, t, across, within).unionByName(_first_signals(plain, several, across, within))
    return every.groupBy(F.col("key_a").alias("a"), F.col("key_b").alias("b")).agg(F.min(F.struct("order", *_told(every))).alias("least")).select("a", "b", "least.*")


def _few(rows: DataFrame, met: DataFrame, on: list[str], apart: bool = False) -> DataFrame:
    """(a, b): links between ids that connect what all links between rows of shapes that meet (on, shape, shape_b, both ways) connect.

    Every row is linked to the first of each shape it meets. Where only rows of different paths are linked (apart), to
    three of different paths, if there are so many, but its own: two rows then share one of them if they share any.
    """
    path = ["path"] if apart else []
    first = rows.groupBy(*on, "shape", *path).agg(F.min("id").alias("b"))
    if apart:
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*on, "shape").orderBy("path"))).where("n <= 3")
    first = first.select(*on, F.col("shape").alias("shape_b"), *[F.col(c).alias("path_b") for c in path], "b")
    links = rows.select(*on, "shape", *path, F.col("id").alias("a")).join(met.hint("merge"), [*on, "shape"]).join(first.hint("merge"), [*on, "shape_b"])
    return (links.where("path <> path_b") if apart else links).select("a", "b")


def _shapes_met(rows: DataFrame, on: list[str], like: Column) -> DataFrame:
    """(on, shape, shape_b) both ways and of a shape with itself, where a condition on statements_a and statements_b holds."""
    shapes = rows.groupBy(*on, "shape").agg(F.first("statements").alias("statements"))
    x, y = (shapes.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in ("shape", "statements")]) for s in ("a", "b"))
    return x.join(y.hint("merge"), on).where(like).select(*on, F.col("shape_a").alias("shape"), "shape_b")


def _links_by_calls(called: DataFrame, across: float) -> DataFrame:
    """(a, b): few links between ids of tests of the same calls in different files, which connect what those not claimed by name connect.

    Where there are several names and files, two tests that differ in both are linked, and others to one of these.
    The rest have the name of one and the file of the other; each set of their statements is held against the group.
    """
    alone = F.concat(F.lit("\0"), F.col("key"))  # nothing is claimed by a name or file that is not known
    rows = called.select("id", "calls", "shape", "statements", F.coalesce("path", alone).alias("path"), F.when(F.col("path").isNotNull(), F.col("name")).alias("name"), alone.alias("alone")).withColumn("name", F.coalesce("name", "alone")).drop("alone")
    this = lambda *by: F.struct(*by, "id", "statements")
    ends = rows.groupBy("calls").agg(F.min(this("name", "path")).alias("n0"), F.max(this("name", "path")).alias("n1"), F.min(this("path", "name")).alias("p0"), F.max(this("path", "name")).alias("p1")).where("p0.path <> p1.path")
    far = lambda path, name, statements: (F.col("path") != path) & ((F.col("name") != name) | ~F.coalesce(jaccard(F.col("statements"), statements) >= across, F.lit(False)))

    single = rows.join(ends.where("n0.name = n1.name").select("calls").hint("merge"), "calls")
    unlike = ~F.coalesce(jaccard(F.col("statements_a"), F.col("statements_b")) >= across, F.lit(False))
    links = _few(single, _shapes_met(single, ["calls"], unlike), ["calls"], True)

    order = lambda c: F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("name", "path", "id", "statements")])
    off = F.when(F.col("p0.path") != F.col("n0.path"), order("p0")).otherwise(order("p1"))
    ends = ends.where("n0.name <> n1.name").select("calls", order("n0").alias("n0"), order("n1").alias("n1"), off.alias("off"))
    ends = ends.select("calls", F.when(F.col("n0.path") != F.col("n1.path"), F.col("n1")).otherwise(F.col("off")).alias("v"), "n0", "n1")
    ends = ends.select("calls", "v", F.when(F.col("n0.name") != F.col("v.name"), F.col("n0")).otherwise(F.col("n1")).alias("w"))
    to = lambda c: F.when(far(F.col(f"{c}.path"), F.col(f"{c}.name"), F.col(f"{c}.statements")), F.col(f"{c}.id"))
    held = rows.join(ends.hint("merge"), "calls").withColumn("b", F.coalesce(to("v"), to("w"))).drop("v", "w")
    links = links.unionByName(held.where("b is not null").select(F.col("id").alias("a"), "b"))
    rest = held.where("b is null")
    cells = rest.groupBy("calls", "name", "path", "shape").agg(F.first("statements").alias("statements"))
    others = held.select("calls", *[F.col(c).alias(f"{c}_b") for c in ("id", "path", "name", "statements")], F.col("b").isNotNull().alias("linked"))
    met = cells.join(others.hint("merge"), "calls").where(far(F.col("path_b"), F.col("name_b"), F.col("statements_b")))
    partner = met.groupBy("calls", "name", "path", "shape", "linked").agg(F.min("id_b").alias("b")).hint("merge")
    return links.unionByName(rest.drop("b").join(partner, ["calls", "name", "path", "shape"]).select(F.col("id").alias("a"), "b"))


def _signal_links(t: DataFrame, across: float, within: float) -> DataFrame:
    """(a, b, order): few links between ids that connect, signal by signal, what the pairs of test_pairs connect."""
    plain = t.where("not repeated")
    score = jaccard(F.col("statements_a"), F.col("statements_b"))
    named, filed, called = plain.where("name is not null and path is not null"), plain.where("path is not null"), plain.where("calls is not null")
    like = F.coalesce(F.arrays_overlap("statements_a", "statements_b") & (score >= within), F.lit(False))
    beside = called.where("path is not null")
    calls = _few(beside, _shapes_met(beside, ["path", "calls"], ~like), ["path", "calls"]).unionByName(_links_by_calls(called, across))
    order = called.select(F.col("id").alias("a"), F.when(F.col("calls") != "", 2).otherwise(3).alias("order"))
    links = _few(named, _shapes_met(named, ["name"], F.coalesce(score >= across, F.lit(False))), ["name"], True).withColumn("order", F.lit(0))
    links = links.unionByName(_few(filed, _shapes_met(filed, ["path"], like), ["path"]).withColumn("order", F.lit(1))).unionByName(calls.join(order.hint("merge"), "a"))
    more = _repeated_pairs(t.drop(*_told(t)), across, within)
    if more is None:
        return links
    for c in ("a", "b"):
        more = more.join(t.where("leads").select(F.col("key").alias(c), F.col("id").alias(f"id_{c}")).hint("merge"), c)
    return links.unionByName(more.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "order"))


def _signal_clusters(t: DataFrame, across: float, within: float) -> DataFrame:
    """(signal, test, cluster): the tests that pairs of one signal connect, found from few links; cluster is a number."""
    from corpusmill.operators.graph import connected_components

    n = len(SIGNALS)  # a test that stands in clusters of two signals is a node in each
    links = _signal_links(t, across, within).select((F.col("a") * n + F.col("order")).alias("a"), (F.col("b") * n + F.col("order")).alias("b"))
    found = connected_components(links, "a", "b").select(F.expr(f"node div {n}").alias("id"), F.element_at(F.array(*map(F.lit, SIGNALS)), (F.col("node") % n + 1).cast("int")).alias("signal"), F.col("component").alias("cluster"))
    return found.join(t.where("leads").select("id", F.col("key").alias("test")).hint("merge"), "id").select("signal", "test", "cluster")


def test_pairs(t: DataFrame, across: float = 0.95, within: float = 0.8, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b, signal) of alike tests: same name across files, then same file with alike statements, then same calls, then both raise alike.

    A pair keeps the first signal that claims it. Each signal is an equi join: on the name and alike sets of
    statements, the file, or the calls. A signal tells from the two rows what an earlier one claims, so pairs need
    no shuffle; only those of keys with several rows are grouped.

    judge: from (signal, test, cluster), the tests that pairs of a signal connect, to (signal, cluster, told), a struct. Its
    fields come with each pair; tests carry them into the joins, so that pairs need no shuffle for this either.
    """
    t = _keyed(t)
    if judge is not None:
        members = cut_lineage(_signal_clusters(t, across, within))
        own = members.join(judge(members).hint("merge"), ["signal", "cluster"]).groupBy(F.col("test").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("signal", "told"))).alias("told"))
        t, old = cut_lineage(t.join(own.hint("merge"), "key", "left")), t
        release(members, old)
    plain = t.where("not repeated")
    pairs = _first_signals(plain, plain, across, within).withColumnsRenamed({"key_a": "a", "key_b": "b"})
    more = _repeated_pairs(t, across, within)
    pairs = pairs if more is None else pairs.unionByName(more)
    signal = F.element_at(F.array(*map(F.lit, SIGNALS)), F.col("order") + 1).alias("signal")
    return pairs.select("a", "b", signal) if judge is None else pairs.where("told is not null").select("a", "b", signal, "told.*")


def test_links(t: DataFrame, across: float = 0.95, within: float = 0.8) -> DataFrame:
    """(a, b): as few links as connect what the pairs of test_pairs but those of the same name connect.

    Tests with the same calls are all connected once they have two names, as only tests of one name are claimed
    by it. Where they have one name, only those of one file and of unlike statements are linked.
    """
    t = _keyed(t)
    plain = t.where("not repeated")
    x, y = _sides(plain, plain)
    links = _by_file(x, y, within).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    called = plain.where("calls is not null")
    groups = called.groupBy("calls").agg(F.min("key").alias("first"), (F.min("name") != F.max("name")).alias("several"), F.count("*").alias("n")).where("n > 1").hint("merge")
    held = called.join(groups, "calls")
    links = links.unionByName(held.where("several").select(F.col("key").alias("a"), F.col("first").alias("b")))
    single = held.where("not several")
    shapes = single.groupBy("calls", "shape").agg(F.min("key").alias("own"), F.first("statements").alias("statements"))
    u, v = (shapes.select("calls", *[F.col(c).alias(f"{c}_{s}") for c in ("shape", "own", "statements")]) for s in ("a", "b"))
    unlike = u.join(v.hint("merge"), "calls").where((F.col("shape_a") != F.col("shape_b")) & ~(jaccard(F.col("statements_a"), F.col("statements_b")) >= across))
    links = links.unionByName(unlike.select(F.col("own_a").alias("a"), F.col("own_b").alias("b")))
    partner = unlike.groupBy("calls", F.col("shape_a").alias("shape")).agg(F.min("own_b").alias("b")).hint("merge")
    links = links.unionByName(single.join(partner, ["calls", "shape"]).select(F.col("key").alias("a"), "b"))
    more = _repeated_pairs(t, across, within)
    return links if more is None else links.unionByName(more.where("order > 0").select("a", "b"))


def unused_dependencies(issues: DataFrame, known: DataFrame, code: str = "DEP002", keep: list[str] | None = None) -> DataFrame:
    """issues (code, module, and the columns to keep) without the unused ones that are entry points or optional after all (known: name, normalised)."""
    name = F.regexp_replace(F.lower("module"), "[-_.]+", "-")
    own = known.select("name", F.lit(code).alias("code"))
    return issues.withColumn("name", name).join(own, ["code", "name"], "left_anti").select(*(keep or []), "code", "module")
