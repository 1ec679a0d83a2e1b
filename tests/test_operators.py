"""Operators on small tables, against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import aggregate as A
from corpusmill.operators import code as C
from corpusmill.operators import governance as V
from corpusmill.operators import rescue
from corpusmill.sources import python_rules as R
from corpusmill.sources import python_source as P


def test_references_in_documents_are_found_inside_words(spark):
    rng = random.Random(3)
    symbols = ["f1", "f12", "Cart", "total_price", "x", "f(", "Ü"]
    lines = ["`f12`", "a `b` f1 `c`", "## the CART of f(", "#f1", "# ", "` f1", "``x``", "### tOTAL_price", "plain Cart", "`Ü` # x", "# ü"] + ["`" + "".join(rng.choice("f12 `x(") for _ in range(12)) for _ in range(60)]
    text = "\n".join(lines)
    want = set()
    import re

    for (k, line), s in itertools.product(enumerate(lines, 1), symbols):
        if re.search("`[^`]*" + re.escape(s) + "[^`]*`", line) or re.search(r"(?i)^#+\s+.*" + re.escape(s), line):
            want.add((s, "d.md", k))
    docs = spark.createDataFrame([("d.md", text), ("e.md", ""), ("f.md", None)], "path string, text string")
    got = C.doc_refs(docs, spark.createDataFrame([(s,) for s in symbols], "symbol string")).collect()
    assert {(r["symbol"], r["path"], r["line"]) for r in got} == want and len(got) == len(want)


def test_symbols_are_not_broadcast(spark):
    docs, symbols = spark.range(1).selectExpr("'d.md' AS path", "'`f1` f2' AS text"), spark.range(1, 3).selectExpr("concat('f', id) AS symbol")
    plans = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plans(C.doc_refs(docs, symbols))
    # nor is what was found, when the rest is looked for
    assert "Broadcast" not in plans(C.undocumented(docs, symbols))
    assert [r["symbol"] for r in C.undocumented(docs, symbols).collect()] == ["f2"]


def test_a_move_finds_its_callers(spark):
    files = [("a.py", "from p.m import (\n    x,\n    y,\n)"), ("b.py", "from p.m import z"), ("c.py", "from p.m import x\ndef broken(:"), ("d.py", "# from p.m import x"), ("e.py", "from .m import x")]
    got = C.move_callers(spark.createDataFrame(files, "path string, text string"), "p.m", ["x", "y"]).collect()
    assert {(r["path"], tuple(r["names"])) for r in got} == {("a.py", ("x", "y")), ("c.py", ())}


def test_filters_of_tests(spark):
    rows = spark.createDataFrame([("p.a",), ("tests.unit.b",), ("p.test_c",)], "module string")
    n = lambda *a: tuple(d.count() for d in C.filter_tests(rows, rows, *a))
    assert (n(), n("none"), n("related"), n(None, True), n("all", True)) == ((3, 3), (1, 1), (3, 1), (1, 1), (3, 3))


def test_discovery_and_changes(spark):
    paths = spark.createDataFrame([("src/a.py",), (".venv/lib/b.py",), ("src/build.py",), ("build/c.py",), ("d.txt",)], "path string")
    assert {r["path"] for r in paths.where(P.is_source(F.col("path"))).collect()} == {"src/a.py", "src/build.py"}
    x = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, modified long")
    y = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "path string, modified long")
    assert {tuple(r) for r in P.tree_changes(x, y).collect()} == {("b", "modified"), ("c", "removed"), ("d", "added")}


def test_keys_of_project_files_count_in_their_own_table(spark):
    files = [("a", "pyproject.toml", "[tool.mypy]\nfiles = []\n[tool.other]\nstrict = true"), ("b", "pyproject.toml", "[tool.mypy]\nstrict = true"), ("c", "pyproject.toml", "[tool.mypy\nstrict = true"), ("d", "pyproject.toml", None)]
    got = V.govern(spark.createDataFrame(files, "project string, path string, text string"), V.checks(spark)).where("passed and name like 'pyproject.%'").collect()
    assert {(r["project"], r["name"]) for r in got} == {("a", "pyproject.exists"), ("b", "pyproject.exists"), ("c", "pyproject.exists"), ("d", "pyproject.exists"), ("b", "pyproject.mypy")}


def test_failures_keep_the_first_callers(spark):
    reports = spark.createDataFrame([(1, "s", "LOW"), (1, "t", "HIGH"), (2, "u", "MEDIUM")], "failure long, symbol string, score string")
    callers = spark.createDataFrame([(1, "t", f"c{i:02}") for i in range(12)] + [(1, "s", "z")], "failure long, symbol string, caller string")
    tests = spark.createDataFrame([(1, "s", "x"), (1, "t", "x")], "failure long, symbol string, test string")
    got = {r["failure"]: r for r in A.failure_impacts(reports, callers, tests, 3).collect()}
    assert (got[1]["shown"], got[1]["more"], got[1]["tests"], got[1]["score"], got[1]["symbols"]) == (["z", "c00", "c01"], 10, 1, "HIGH", 2)
    assert (got[2]["shown"], got[2]["more"], got[2]["tests"], got[2]["score"]) == ([], 0, 0, "MEDIUM")


def _features(path, source):
    return [dict(zip([c.split()[0] for c in rescue.FEATURES.split(", ")], row, strict=True)) for row in rescue.features(path, source)]


def plain_verdict(tests, signal):
    """The conditions over a whole cluster, written out."""
    pairs = list(itertools.combinations(tests, 2))
    jac = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    s = lambda t, c: set(t[c])
    stem = lambda t: set(t["path"].rsplit("/", 1)[-1].removesuffix(".py").removeprefix("test_").split("_"))
    public = lambda t: [c for c in t["calls"] if not c.startswith("_")]

    def strong(a, b):
        return jac(s(a, "statements"), s(b, "statements")) >= 0.85 or len(s(a, "attributes") & s(b, "attributes")) >= 3 or a["call_sig"] and a["call_sig"] == b["call_sig"] and len(s(a, "literals") & s(b, "literals")) >= 3

    any_pair = {
        "distinct_literals": lambda a, b: min(len(s(a, "literals") - s(b, "literals")), len(s(b, "literals") - s(a, "literals"))) >= 2,
        "patch_context": lambda a, b: a["patches"] != b["patches"],
        "template_pair": lambda a, b: any(len(t) >= 4 for t in stem(a) ^ stem(b)) and max(a["body"], b["body"]) <= 4,
        "body_size": lambda a, b: a["body"] != b["body"] and max(a["body"], b["body"]) <= 8,
        "setup_divergence": lambda a, b: jac(s(a, "setup"), s(b, "setup")) < 0.5,
        "call_multiplicity": lambda a, b: any(public(a).count(c) != public(b).count(c) for c in set(public(a)) & set(public(b))),
        "distinct_sut": lambda a, b: s(a, "calls") - s(b, "calls") and s(b, "calls") - s(a, "calls"),
        "distinct_class": lambda a, b: a["class_name"] and b["class_name"] and a["class_name"] != b["class_name"],
        "raises_divergence": lambda a, b: a["raises"] != b["raises"],
    }
    for n in rescue.ORDER.get(signal, []):
        if all(abs(a["line"] - b["line"]) > 200 and not strong(a, b) for a, b in pairs) if n == "locality" else any(any_pair[n](a, b) for a, b in pairs):
            return f"ambiguous_{n}"
    return signal


@pytest.mark.parametrize("seed", [1, 2])
def test_rescue_judges_whole_clusters(spark, seed):
    rng = random.Random(seed)
    files, features = [], {}
    for f in range(6):
        body = []
        for i in range(8):
            n = rng.randrange(3)
            lines = [f"def test_{rng.choice('abc')}{f}_{i}():"] + [f"    s{k} = 'text {rng.randrange(4)}'" for k in range(n)] + [f"    {'_' * (rng.random() < 0.2)}make('{rng.randrange(3)}')"] * rng.randrange(0, 3) + [f"    r = apply({rng.randrange(2)})", f"    assert r.{rng.choice(['x', 'y'])} == {rng.randrange(5)}"]
            body += lines + [""] * rng.choice([2, 2, 150])
        path = f"tests/test_{'alpha' if f % 2 else 'beta'}{f}.py"
        files.append((path, "\n".join(body) + "\n"))
        for t in _features(*files[-1]):
            features[f"{path}::{t['name']}"] = t
    df = spark.createDataFrame(files, "path string, text string")
    pairs = R.test_pairs(R.scan_tests(df))
    rows = pairs.collect()
    table = R._scan(df, rescue.features, rescue.FEATURES, [c.split()[0] for c in rescue.FEATURES.split(", ")])
    got = {(r["a"], r["b"]): r for r in rescue.rescue(pairs, table).collect()}
    assert len(got) == len(rows)
    clusters: dict = {}
    for signal in {r["signal"] for r in rows}:
        own = {k: {k} for r in rows if r["signal"] == signal for k in (r["a"], r["b"])}
        for r in rows:
            if r["signal"] == signal:
                both = own[r["a"]] | own[r["b"]]
                for k in both:
                    own[k] = both
        clusters |= {(signal, k): v for k, v in own.items()}
    seen = set()
    for r in rows:
        members = clusters[r["signal"], r["a"]]
        want = plain_verdict([features[k] for k in sorted(members)], r["signal"])
        mine = got[r["a"], r["b"]]
        assert (mine["size"], mine["cluster"], mine["verdict"]) == (len(members), min(members), want), (r, members)
        seen.add(want)
    assert len(seen) > 2


def brute_pairs(rows, across=0.95, within=0.8):
    """The first signal of every pair of keys, over all their rows."""
    out = {}
    key = lambda r: "::".join([r[0], ".".join(x for x in (r[2], r[1]) if x)])
    for r, s in itertools.permutations(rows, 2):
        if key(r) >= key(s):
            continue
        x, y = set(r[7]), set(s[7])
        like = len(x & y) / len(x | y) if x | y else 1.0
        same = r[4] == s[4]
        order = 0 if r[1] == s[1] and r[0] != s[0] and like >= across else 1 if r[0] == s[0] and x & y and like >= within else 2 if same and r[4] else 3 if same and r[6] and s[6] else None
        if order is not None:
            out[key(r), key(s)] = min(order, out.get((key(r), key(s)), 9))
    return {k: R.SIGNALS[v] for k, v in out.items()}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_pairs_and_links_against_every_pair(spark, seed):
    """Few values, so that all signals, repeated keys and groups of one name come up."""
    rng = random.Random(seed)
    rows = [("t%d.py" % rng.randrange(6), "test_%d" % rng.randrange(8), rng.choice([None, None, "A"]), k, rng.choice(["", "f(%d)" % rng.randrange(8), "g()"] if seed else ["", "f(%d)" % rng.randrange(40)]), "", rng.random() < 0.3, rng.choice([["a"], ["b"], ["a", "b"], [*"abcdefghijklmnopqrstu"], [*"abcdefghijklmnopqrst"], []])) for k in range(60)]
    if seed == 2:  # no key twice
        rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    rows += [("u%d.py" % (k // 2), "test_one", None if k % 2 else "B", k, "one()", "", False, [["v"], ["v"], ["v", "w"]][k % 3]) for k in range(6)]
    t = spark.createDataFrame(rows, R.TEST)
    want = brute_pairs(rows)
    got = [tuple(r) for r in R.test_pairs(t).collect()]
    assert {(a, b): s for a, b, s in got} == want and len(got) == len(want)
    assert set(want.values()) == set(R.SIGNALS[: 4 if seed < 2 else 3])
    from corpusmill.operators.graph import connected_components

    sets = lambda edges: {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    plain = spark.createDataFrame([k for k, s in want.items() if s != "same_name"], "a string, b string")
    assert sets(R.test_links(t)) == sets(plain)


def test_pairs_need_no_shuffle_and_links_stay_few(spark):
    rows = [("t%d.py" % k, "test_%d" % k, None, 1, "f()", "", False, ["a"]) for k in range(300)]
    t = spark.createDataFrame(rows, R.TEST)
    assert R.test_pairs(t)._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    assert R.test_links(t).count() == 300 and R.test_pairs(t).count() == 300 * 299 // 2


@pytest.mark.parametrize("kind", ["long", "string"])
def test_dense_and_sparse_coupling_agree(spark, monkeypatch, kind):
    rng = random.Random(5)
    rows = [(d, f) for f in range(90) for d in range(12) if rng.random() < 0.8] * 2 + [(None, 1), (1, None)]
    df = spark.createDataFrame(rows, "commit_id int, file int").withColumn("file", F.col("file").cast(kind))
    monkeypatch.setattr(A, "BLOCK", 16)
    monkeypatch.setattr(A, "STRIP", 5)
    found = lambda: A.coupled_pairs(df, 0.7, 3)
    dense = found()
    assert "MapInArrow" in dense._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, dense.collect()))
    monkeypatch.setattr(A, "DENSE_COMMITS", 0)
    want = sorted(map(tuple, found().collect()))
    assert got == want and 0 < len(got) < 90 * 89 // 2


def test_tests_are_not_broadcast_when_rescued(spark):
    columns = {"path": "concat('t', id, '.py')", "name": "if(id < 2, 'test_x', '')", "class_name": "CAST(NULL AS STRING)", "line": "1", "body": "3", "call_sig": "'f()'", "raises": "id = 0"}
    tests = spark.range(2).selectExpr(*[f"{columns.get(c, "array('x')")} AS {c}" for c in (x.split()[0] for x in rescue.FEATURES.split(", "))])
    pairs = spark.range(1).selectExpr("concat('t', id, '.py::test_x') AS a", "concat('t', id + 1, '.py::test_x') AS b", "if(id = 0, 'same_calls', 'same_file') AS signal")
    got = rescue.rescue(pairs, tests)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["size"], r["verdict"]) for r in got.collect()] == [(2, "ambiguous_raises_divergence")]


def cluster_verdict(tests, signal):
    """plain_verdict of a cluster whose keys can come several times, from its pairs of different keys."""
    order = rescue.ORDER.get(signal, [])
    found = {plain_verdict([a, b], signal) for a, b in itertools.combinations(tests, 2) if a["key"] != b["key"]}
    first = min(found, key=lambda v: order.index(v.removeprefix("ambiguous_")) if v != signal else len(order))
    return signal if first == f"ambiguous_{rescue.EVERY}" and signal in found else first


@pytest.mark.parametrize("repeated", [False, True])
def test_judged_pairs_need_no_shuffle_and_hold_all_pairs_of_a_cluster(spark, repeated):
    """Groups of a few tests with names, files, statements and features of their own: all forms of clusters come up."""
    rng = random.Random(4 + repeated)
    some = lambda items, most: sorted(rng.sample(items, rng.randrange(most + 1)))
    rows, features = [], []
    for g in range(120):
        names, files, shapes = rng.randrange(1, 4), rng.randrange(1, 5), rng.choice([1, 1, 2, 4])
        loose = {c for c in ("line", "body", "literals", "patches", "calls", "setup", "raises", "statements") if rng.random() < 0.2}
        vary = lambda c, new, old: new if c in loose else old  # noqa: B023, E731
        for k in range(rng.randrange(2, 9)):
            r = (f"t/test_{'long' if g % 2 else 'x'}{rng.randrange(files)}_{g}.py", f"test_{g}_{rng.randrange(names)}", rng.choice([None, "A", "B"]) if g % 3 else None, k)
            if not repeated and any(x[:3] == r[:3] for x in rows):
                continue
            like = rng.choice([["a"], ["b"], ["a", "b"], [*"abcdefghijklmnopqrstu"], [*"abcdefghijklmnopqrst"], []][:shapes] if g % 5 else [[*"abcdefghi"], [*"abcdefgh"], []])
            rows.append((*r, "" if g % 10 == 9 else f"f({g})", "", g % 10 == 9, like))
            features.append((
                *r[:3], vary("line", k * 150 + rng.randrange(300), k * 201 if g % 4 else k), vary("body", rng.randrange(2, 10), 5 if g % 7 else 3), f"f({g})", vary("literals", some([*"uvwxyz"], 5), ["u"]), vary("patches", some(["p"], 1), []),
                vary("calls", sorted(rng.choices(["f", "g", "_h"], k=rng.randrange(3))), ["f"]), [], vary("statements", some([*"mn"], 2), ["m"] if g % 2 else [str(k)]), vary("setup", some([*"ijklmno"], 7), ["i"]), vary("raises", rng.random() < 0.5, False),
            ))
    table = spark.createDataFrame(features, rescue.FEATURES)
    pairs = R.test_pairs(spark.createDataFrame(rows, R.TEST), judge=lambda members: rescue.judge(members, table))
    if not repeated:
        assert pairs._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    key = lambda r: "::".join([r[0], ".".join(x for x in (r[2], r[1]) if x)])
    by_key: dict = {}
    for f in features:
        by_key.setdefault(key(f), []).append(dict(zip([c.split()[0] for c in rescue.FEATURES.split(", ")], f, strict=True)) | {"key": key(f)})
    plain, own = brute_pairs(rows), {}
    for (a, b), signal in plain.items():
        both = own.get((signal, a), {a}) | own.get((signal, b), {b})
        own |= {(signal, k): both for k in both}
    told: dict = {}
    want = []
    for (a, b), signal in plain.items():
        c = frozenset(own[signal, a])
        if (signal, c) not in told:
            told[signal, c] = cluster_verdict([f for k in c for f in by_key[k]], signal)
        want.append((a, b, signal, min(c), len(c), told[signal, c]))
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    assert {v for _, _, _, _, _, v in want} >= {f"ambiguous_{n}" for names in rescue.ORDER.values() for n in names} | set(rescue.ORDER)
