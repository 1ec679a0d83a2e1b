import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.llm import toxicity


def _tables(spark, n=700):
    rng = random.Random(2)
    plain = ["w%s" % "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    bad = ["vilek" + e for e in ("", "en", "ter", "st", "ung")]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad).capitalize())
        docs.append((i, " ".join(words), rng.choice(["en", "de"])))
        if rng.random() < 0.8:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_words_and_their_forms(spark):
    docs, labels = _tables(spark)
    got = toxicity.op1(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id", suffixes=("", "_label"))
    held = got[got.held_out]
    assert len(held) > 60
    assert (held.predicted == held.toxic_label).mean() > 0.95
    assert ((got.score >= 0.5).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    assert set(got.threshold) <= {0.5} | set(np.round(np.linspace(0.2, 0.8, 6001), 4))


def test_scores_do_not_depend_on_language_or_neighbours(spark):
    docs, labels = _tables(spark, 300)
    model = toxicity.fit(docs, labels)
    texts = [r["text"] for r in docs.limit(40).collect()]
    together = model.net.scores(pa.array(texts))
    alone = np.array([model.net.scores(pa.array([t]))[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-6)
    a = toxicity.score_toxicity(docs, model).select("doc_id", "score").toPandas()
    b = toxicity.score_toxicity(docs.withColumn("lang", F.lit("zz")), model).select("doc_id", "score").toPandas()
    assert a.equals(b)


def test_odd_rows(spark):
    docs, labels = _tables(spark, 300)
    more = labels.unionByName(spark.createDataFrame([(1, None), (None, 1), (5, 1), (5, 0)], labels.schema))
    odd = spark.createDataFrame([(900, None, None), (901, "", "en"), (902, "vilek " + "x " * 50000, "en")], docs.schema)
    got = {r["doc_id"]: r for r in toxicity.op1(docs.unionByName(odd), more).where("doc_id >= 900").collect()}
    assert got[900]["score"] == got[901]["score"] and got[900]["predicted"] == 0
    assert got[902]["predicted"] == 1
    assert toxicity.op1(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.op1(docs, labels.limit(0)).collect()} == {0.0}


def test_thresholds_are_calibrated_by_language():
    rng = np.random.default_rng(1)
    y = np.tile([0, 1], 200)
    s = np.where(y == 1, 0.45, 0.25) + rng.normal(0, 0.02, 400)
    langs = ["en"] * 200 + ["de"] * 190 + [None] * 10
    t = toxicity.calibrate(s, y, np.ones(400), langs)
    assert set(t) == {"en", "de"} and all(0.3 < x < 0.42 for x in t.values())
    assert toxicity.calibrate(s[:10], y[:10], np.ones(10), langs[:10]) == {}


def test_scripts_without_spaces_are_cut_into_characters():
    def words(text):
        rows, at = toxicity.word_rows(pa.array([text]))
        return [tuple(c) for c in rows[:, : at[1] - toxicity.PAD].T.tolist()]

    assert set(words("毒品")[:1]) < set(words("今天我喜欢毒品和茶")) and len(words("今天我喜欢毒品和茶")) == 9
    assert words("สวัสดี")[0] == words("abc สวัสดีครับ")[1] and len(words("ばか。𠀀𠀁")) == 5
    assert words("iphone手机x") == [*words("iphone"), *words("手机"), *words("x")]
    assert len(words("größe привет 한국어 naïve")) == 4
    rows, at = toxicity.word_rows(pa.array(["毒", "品", "", "a毒"]))
    assert at.tolist() == [0, 3, 6, 8, 12] and rows[:, 0].tolist() == rows[:, 9].tolist() == list(words("毒")[0])


def test_toxic_words_inside_unspaced_runs_are_seen(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        text = [rng.choice("日月火水木金土山川田人口車門雨") for _ in range(rng.randrange(20, 60))]
        bad = rng.random() < 0.3
        if bad:
            text.insert(rng.randrange(3, 15), "毒品")
        rows.append((i, "".join(text), "zh", int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    got = toxicity.op1(docs.drop("toxic"), docs.select("doc_id", "toxic")).toPandas().merge(docs.select("doc_id", "toxic").toPandas(), on="doc_id", suffixes=("", "_label"))
    held = got[got.held_out]
    assert (held.predicted == held.toxic_label).mean() > 0.95


def test_rows_that_repeat_an_id_train_once_in_any_order(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("sun rain hill".split()) for _ in range(12)) + (" vile" if i % 4 == 0 else ""), "en") for i in range(200)]
    again = [(i, "quite another text " * 3, "de") for i in range(0, 200, 5)] * 3
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (900, 0), (3, None)], "doc_id long, toxic int")
    score = []
    for order in (rows + again, again[::-1] + rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3).withColumns({c: F.lit(1) for c in ("score", "mark", "y", "ids", "id", "threshold")})
        score.append(sorted((r["doc_id"], r["score"]) for r in toxicity.op1(docs, labels).collect()))
    assert score[0] == score[1] and len(score[0]) == 320
