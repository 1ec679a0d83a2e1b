import math

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import ann


def _vectors(n=1500, dim=64, copies=200):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim))
    x *= rng.uniform(0.5, 2, (n, 1))
    x[n // 2 : n // 2 + copies] = x[7]
    x[n // 2 + copies : n // 2 + copies + 100] = x[9] + rng.normal(0, 0.05, (100, dim))
    return x


def brute(ids, x, k=5):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[i] = -9
        order = np.lexsort((ids, -np.round(s, 12)))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_order_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "UNIT", 300)
    x = _vectors()
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), [float(z) for z in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.op8(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(ids, x)
    hit = 0
    for q, rows in want.items():
        assert [r[0] for r in got[q]] == list(range(1, len(got[q]) + 1))
        keys = [(-s, v) for _, v, s in got[q]]
        assert keys == sorted(keys)
        for _, v, s in got[q]:
            assert v != q and abs(s - float(x[v] @ x[q] / math.sqrt((x[v] @ x[v]) * (x[q] @ x[q])))) < 1e-12
        hit += len({v for v, _ in rows} & {v for _, v, _ in got[q]})
    assert hit / sum(map(len, want.values())) >= 0.9


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)]
    got = [r["vec_id"] for r in ann.op8(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [1, 2, 3, 4, 5]


def test_unfit_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 0.0]), (8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.op8(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 8)]  # the vector of another length is no candidate
    assert ann.op8(df.limit(0)).count() == 0


def test_every_bucket_chance_is_numbered_like_the_buckets():
    rng = np.random.default_rng(2)
    u = ann.unit_rows(rng.normal(size=(6, 16)))
    a = ann.directions(16)
    every = [np.arange(ann.CELLS**ann.PROJECTIONS)] * ann.TABLES
    own = ann.buckets(u, a)
    for i, visits in enumerate(ann.probes(u, a, 0.999, every, 0.8)):
        for t in range(ann.TABLES):
            assert own[i, t] in visits[t][:40]


def test_fewer_than_k_found_are_completed(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=16)
    near = [x + rng.normal(0, 0.01, 16) for _ in range(3)]
    # the query, its antipode, a far vector, and one id with a near and a far vector
    rows = [(0, x), (1, -x), (2, near[0]), (3, near[1]), (4, near[2]), (4, -near[2]), (5, -2 * x + rng.normal(0, 0.01, 16))]
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert [r for r, _ in got] == [1, 2, 3, 4, 5] and {v for _, v in got} == {1, 2, 3, 4, 5}
    assert ann.nearest(df.where("vec_id < 2"), F.lit(True), 5).count() == 2


def test_any_finite_component_counts(spark):
    big, small = 1e300, 5e-324
    rows = [(0, [big, 0.0, big]), (1, [big, big, big]), (2, [small, 0.0, small]), (3, [-1e-200, 1e-200, 0.0]), (50, [1e-160, 1e160, 0.0])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.op8(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 8
    want = {(0, 1): 2 / 6**0.5, (0, 2): 1.0, (0, 3): -0.5, (0, 50): 0.0, (50, 0): 0.0, (50, 1): 1 / 3**0.5, (50, 2): 0.0, (50, 3): 0.5**0.5}
    assert all(abs(got[k] - w) < 1e-12 for k, w in want.items())


def test_each_length_is_searched_on_its_own(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(z) for z in rng.normal(size=3 + i % 3)]) for i in range(300)]
    rows.append((1000, [float(z) for z in rng.normal(size=20_000)]))
    got: dict = {}
    for r in ann.op8(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {0, 50, 100, 150, 200, 250}  # the one of its length has no neighbour
    assert all(len(v) == 5 and all(x % 3 == q % 3 for x in v) for q, v in got.items())


def test_the_measured_share_meets_the_neighbours():
    rng = np.random.default_rng(3)
    u = ann.unit_rows(rng.normal(size=(400, 32)))
    a = ann.directions(32)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    near = np.argsort(-s, axis=1)[:20, :5]
    b = ann.buckets(u, a)
    need = np.array(ann.share_needed(u[:20], a, 0.5, [b[x] for x in near])).reshape(20, 5)
    every = [np.arange(ann.CELLS**ann.PROJECTIONS)] * ann.TABLES
    for share in (0.3, 0.6):
        for i, visits in enumerate(ann.probes(u[:20], a, 0.5, every, share)):
            met = [any(b[j, t] in visits[t] for t in range(ann.TABLES)) for j in near[i]]
            assert all(m or n > share - 1e-9 for m, n in zip(met, need[i], strict=True))
            assert all(not m or n < share + 0.02 for m, n in zip(met, need[i], strict=True))
