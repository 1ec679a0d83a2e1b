import hashlib
import random
import re

from pyspark.sql import functions as F

from corpusmill.llm import decontaminate as D


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 9)) if v else ():
            win = v[i : i + 10]
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def _tables(spark):
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(12)] + ["é", "Ü", "x9"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(str(i), say(rng.choice([2, 5, 10, 11, 25]))) for i in range(30)] + [("30", ""), ("31", None), ("32", "?!"), ("33", "alone")]
    docs = []
    for i in range(80):
        t = say(rng.randrange(0, 60))
        if i % 3 == 0:
            t += "-" + (items[i % 30][1] or "").upper().replace(" ", ", ") + "." + say(5)
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "ALONE"), (103, "alonely")]
    return items, docs, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")


def test_query_equals_brute_force(spark):
    items, rows, docs, bench = _tables(spark)
    got = {r["doc_id"]: r for r in D.op9(docs, bench).collect()}
    for i, t in rows:
        n, hit, found = brute(t, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0), t
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_large_benchmarks_are_dealt_over_parts(spark, monkeypatch):
    _, _, docs, bench = _tables(spark)
    order = lambda d: sorted(map(str, d.select("doc_id", "n_words", "n_hit", "n_items", "items", "spans", "contaminated").collect()))
    assert order(D.find_contamination(docs, bench)) == order(D.find_contamination(docs, bench, most_words=20))
    monkeypatch.setattr(D, "SLICE_OF_PARTS", 100)
    assert order(D.find_contamination(docs, bench)) == order(D.find_contamination(docs, bench, most_words=4))


def test_a_long_item_is_found_wherever_it_is_cut(spark):
    words = [f"x{i}" for i in range(95)]
    docs = spark.createDataFrame([(i, "a " + " ".join(words[i : i + 10]) + " b") for i in range(86)] + [(200, " ".join(words[80:89]))], "doc_id long, text string")
    bench = spark.createDataFrame([("long", " ".join(words))], "item_id string, text string")
    for most in (60_000, 40, 8):
        got = {r["doc_id"]: r["n_hit"] for r in D.find_contamination(docs, bench, most_words=most).collect()}
        assert got == {i: 10 for i in range(86)} | {200: 0}


def test_many_runs_in_a_long_text(spark):
    docs = spark.createDataFrame([(1, "é the end, " * 40000), (2, None), (3, "")], "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame([(None, "the end")], "item_id string, text string")
    got = {r["doc_id"]: r for r in D.find_contamination(docs, bench).collect()}
    assert got[1]["n_hit"] == 80000 and len(got[1]["spans"]) == 40000 and got[1]["items"] == [""]
    assert all(got[1]["text"][s["start"] : s["end"]] == "the end" for s in got[1]["spans"][:50])
    assert got[2]["n_words"] == got[3]["n_words"] == 0


def test_spans_point_into_the_original_text(spark):
    docs = spark.createDataFrame([(1, "Ünd: ONE—two; one TWO")], "doc_id long, text string").withColumn("spans", F.lit(0))
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    (r,) = D.find_contamination(docs, bench).collect()
    assert [r["text"][s["start"] : s["end"]] for s in r["spans"]] == ["one TWO"] and r["items"] == ["1"]


def test_empty_tables(spark):
    _, _, docs, bench = _tables(spark)
    assert D.op9(docs.limit(0), bench).count() == 0
    assert D.op9(docs, bench.limit(0)).where("contaminated").count() == 0
