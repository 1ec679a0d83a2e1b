import hashlib
import json

from corpusmill.plans import extra, similar


def star(first, size):
    return [(first, first + k, 0.5 + first / 1e6) for k in range(1, size)]


def give(monkeypatch, module, spark, rows):
    monkeypatch.setattr(module, "pairs", lambda *_: spark.createDataFrame(rows, "i long, j long, score double"))


def test_clusters_of_any_size_have_a_hash(spark, monkeypatch):
    give(monkeypatch, similar, spark, star(0, 10_007) + star(20_000, 3) + star(30_000, 60))
    keys = lambda first, size: json.dumps(sorted(["p%d" % (n % 7), "q%d" % n] for n in range(first, first + size)), separators=(",", ":"))
    want = {f: hashlib.sha256(keys(f, n).encode()).hexdigest()[:12] for f, n in ((0, 10_007), (20_000, 3), (30_000, 60))}
    got = [tuple(r) for r in similar.cluster_hashes(spark, "").select("cluster", "cluster_hash").collect()]
    assert len(got) == 3 and dict(got) == want


def test_shortlist_counts_and_waives_clusters_of_any_size(spark, monkeypatch):
    give(monkeypatch, extra, spark, star(0, 51) + star(100, 50) + star(200, 2) + star(300, 70))
    got = [(r["cluster"], r["size"], r["total"]) for r in extra.cluster_shortlist(spark, "").collect()]
    assert got == [(200, 2, 4), (100, 50, 4)]
