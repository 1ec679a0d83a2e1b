import random

import pytest

from corpusmill.operators import graph as G


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def reachable(rows, start):
    out, todo = set(), [start]
    while todo:
        x = todo.pop()
        for a, b in rows:
            if a == x and b not in out:
                out.add(b)
                todo.append(b)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(25), rng.randrange(25)) for _ in range(34)] + [(30, 30)]
    reach = {n: reachable(rows, n) for n in range(31)}
    want = {}
    for n in range(31):
        own = {m for m in reach[n] if n in reach[m]} | {n}
        if len(own) > 1:
            want[n] = min(own)
    assert {r["node"]: r["component"] for r in G.strong_components(edges(spark, rows)).collect()} == want
    loops = {r["node"] for r in G.cycles(edges(spark, rows)).collect()}
    assert loops == set(want) | {n for n in range(31) if n in reach[n]}


@pytest.mark.parametrize("seed", range(3))
def test_connected_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in rows:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {r["node"]: r["component"] for r in G.connected_components(edges(spark, rows)).collect()} == {n: find(n) for n in list(parent)}


def test_empty_graphs(spark):
    e = edges(spark, [(1, 1)])
    assert G.connected_components(e).count() == 0
    assert G.strong_components(e).count() == 0
    assert G.cycles(e).count() == 1


def test_rank_drops_dangling_weight(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", None)], "src string, dst string")
    got = {r["node"]: r["rank"] for r in G.pagerank(rows).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9
    assert max(got, key=got.get) == "a" and abs(got["c"] - got["d"]) < 1e-12


def test_topological_order_with_a_cycle(spark):
    rows = edges(spark, [(3, 2), (2, 1), (5, 6), (6, 5), (7, 5)])
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 7, 9)], "node long")
    got = {r["node"]: r["level"] for r in G.topological_levels(rows, nodes).collect()}
    assert got[1] == got[9] == 0 and got[2] == 1 and got[3] == 2 and got[5] == got[6] == got[7] == 3
