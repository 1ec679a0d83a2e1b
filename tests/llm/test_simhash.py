import random
import re

import numpy as np
from pyspark.sql import functions as F
import xxhash

from corpusmill.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, prints):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_golay_table_is_perfect():
    table = simhash.golay_table()
    assert np.bincount(table, minlength=4096).tolist() == [2048] * 4096


def test_any_four_errors_share_a_key():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    for n in range(5):
        near = fp.copy()
        for i in range(len(fp)):
            for b in rng.choice(64, n, replace=False):
                near[i] ^= np.uint64(1) << np.uint64(b)
        keys = []
        for x in (fp, near):
            rows, k = simhash.golay_keys(x)
            sets = [set() for _ in x]
            for r, v in zip(rows.tolist(), k.tolist(), strict=True):
                sets[r].add(v)
            keys.append(sets)
        assert all(a & b for a, b in zip(*keys, strict=True))


def test_fingerprints_of_odd_texts():
    for t in ["", "   \n", "One", "A b C d", "a b c d e", "x y z w", "É É é é É", "w " * 5000, "\x0b\x0ca\x1fb"]:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t), t


def _docs(spark, n=260):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 3, 4, 30, 120]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i * 3 + 1, " ".join(t)))
    rows += [(9001, None), (9002, ""), (9003, "  ")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_components_equal_brute_force(spark):
    rows, docs = _docs(spark)
    got = {r["doc_id"]: r for r in simhash.op3(docs).collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], prints)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(int(got[i]["fingerprint"], 16) == p for (i, _), p in zip(rows, prints, strict=True))


def test_crowded_keys_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 2**63))
    prints = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for _ in range(150)})
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)) if p >= 2**63 else p,) for p in prints], "fp long")
    links = [(r["src"], r["dst"]) for r in simhash.fingerprint_links(df).collect()]
    index = {p: i for i, p in enumerate(prints)}
    want = brute_components(list(range(len(prints))), prints)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = index[a % 2**64], index[b % 2**64]
        assert bin(prints[a] ^ prints[b]).count("1") <= 4
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {i: find(i) for i in range(len(prints))} == want


def test_repeated_rows_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "z")], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 4
    same = [r for r in got if r["component_id"] == 1]
    assert len(same) == 3 and len({r["keeper"] for r in same}) == 1
    assert simhash.op3(docs.limit(0)).count() == 0


def test_clashing_names_long_texts_and_numbers_brought_along(spark):
    long = "word of a long text " * 60_000
    docs = spark.createDataFrame([(1, long), (2, long), (3, ""), (4, None), (5, "q")], "doc_id long, text string").withColumns({c: F.lit(0) for c in ("id", "fp", "uid", "keeper", "component_id", "key")})
    got = {r["doc_id"]: r["component_id"] for r in simhash.op3(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    kept = simhash.near_duplicates(docs.withColumn("uid", F.col("doc_id") * 10), uid_col="uid").collect()
    assert {r["uid"]: r["keeper"] for r in kept} == {10: 10, 20: 10, 30: 30, 40: 30, 50: 50}
