import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.llm import langid
from corpusmill.llm.common import fold, text_buffer

SYLLABLES = {"aa": "la re mi so do fa ti ne".split(), "bb": "krü ßen öch tze pfa ung ver".split(), "cc": "ción ñar llo que ado mos".split()}


def _docs(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(rng.randrange(3, 30))), lang))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def _brute_grams(text):
    chars = [" "]
    for c in text:
        x = chr(langid._fold(ord(c))[0])
        if x != " " or chars[-1] != " ":
            chars.append(x)
    if chars[-1] != " ":
        chars.append(" ")
    return [tuple(chars[i : i + n]) for n in langid.SIZES for i in range(len(chars) - n + 1) if any(x != " " for x in chars[i : i + n])]


def test_grams_equal_those_of_each_text_alone():
    texts = ["Ab, cd!", "", "é", None, "  x  ", "漢字 ab", "12", "a1b", "\u0301", "x\u0301 \U0001e8d0"]
    data, at = text_buffer(pa.array(texts, pa.string()))
    chars, place, letters = langid.characters(data, at)
    assert letters.tolist() == [4, 0, 1, 0, 1, 4, 0, 2, 0, 1]
    total = [0] * len(texts)
    for n, g in zip(langid.SIZES, langid.grams(chars), strict=False):
        ok = langid._within(n, place, len(chars)) & (g != langid.BUCKETS - 1)
        for k in range(len(texts)):
            total[k] += int(ok[place[k] : place[k + 1]].sum())
    assert total == [len(_brute_grams(t or "")) for t in texts]


def test_scores_equal_a_plain_naive_bayes(spark):
    rows, docs = _docs(spark)
    model = langid.fit(docs, fold("doc_id", 4) != 2)
    import zlib

    counts, number = {}, {}
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            number[lang] = number.get(lang, 0) + 1
            for g in _brute_grams(t):
                data, at = text_buffer(pa.array(["x"]))
                b = _bucket(g)
                counts.setdefault(lang, {})[b] = counts.get(lang, {}).get(b, 0) + 1
    assert set(model.langs) == set(counts)
    names, score = model.predict(pa.array([t for _, t, _ in rows[:40]]))
    for k, (_, t, _) in enumerate(rows[:40]):
        lp = {}
        for lang in model.langs:
            size = sum(counts[lang].values()) + langid.ALPHA * (langid.BUCKETS - 1)
            lp[lang] = math.log(number[lang] / sum(number.values())) + sum(math.log((counts[lang].get(_bucket(g), 0) + langid.ALPHA) / size) for g in _brute_grams(t))
        best = max(lp, key=lp.get)
        assert names[k] == best
        assert abs(score[k] - 1 / sum(math.exp(v - lp[best]) for v in lp.values())) < 1e-3


def _bucket(gram):
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % 2**64
    return (((h + len(gram)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.BUCKET_BITS)) % (langid.BUCKETS - 1)


def test_held_out_accuracy_and_folds(spark):
    rows, docs = _docs(spark)
    got = langid.op7(docs.withColumn("score", F.lit("clash"))).toPandas().merge(docs.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 30 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_texts_without_letters_and_missing_parts(spark):
    _, docs = _docs(spark, 60)
    odd = spark.createDataFrame([(1000, None, "aa"), (1001, "12 34 !?", "aa"), (1002, "", None), (1003, "ver", None), (None, "ver", "bb")], docs.schema)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.op7(docs.unionByName(odd)).where("doc_id is null or doc_id >= 1000").collect()}
    assert {(1000, "und"), (1001, "und"), (1002, "und")} < got and len(got) == 5
    assert langid.op7(docs.limit(0)).count() == 0
    blind = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.op7(blind).collect()} == {"und"}
