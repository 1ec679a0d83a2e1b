import hashlib

import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from corpusmill.llm import toxicity
from test_decontaminate import brute as brute_contamination
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def _documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stage_list():
    assert [n for n, _ in P.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "benchmark decontamination", "BPE encoding"]
    assert P.ORACLE_SQL is None


def test_stages_against_brute_force(spark):
    docs = _documents(spark)
    names = docs.columns
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 !", "en", "s", 4)], docs.schema)
    one = P.language(spark, docs.unionByName(extra), SF)
    assert one.columns == names and one.count() == docs.count()
    two = P.toxic(spark, one, SF)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r["doc_id"] for r in toxicity.score_toxicity(docs, model).where("toxic").collect()}
    assert {r["doc_id"] for r in two.collect()} == {r["doc_id"] for r in docs.collect()} - rejected
    three = P.near_duplicates(spark, two, SF)
    rows = sorted((r["doc_id"], r["text"]) for r in two.collect())
    groups = brute_components([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(set(groups.values()))
    four = P.decontaminated(spark, three, SF)
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in three.collect() if not brute_contamination(r["text"], items)[1]}
    assert {r["doc_id"] for r in four.collect()} == clean
    five = {r["doc_id"]: r for r in P.encoded(spark, four, SF).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in four.limit(30).collect():
        ids = t.encode(r["text"], add_special_tokens=False).ids
        assert five[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    whole = {r["doc_id"] for r in P.run(spark, SF).collect()}
    assert whole == set(five)


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows_and_clashing_columns(spark, stage):
    docs = _documents(spark).limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0), (6, "word " * 30000, None, None, 1)], docs.schema)
    rows = docs.unionByName(odd)
    clash = {c: F.lit(1) for c in ("score", "toxic", "threshold", "lang_pred", "uid", "_uid", "keeper", "items", "spans", "contaminated", "ids", "decoded", "fp")}
    wide = rows.withColumns(clash)
    out = P.STAGES[stage][1](spark, wide, SF)
    got = out.toPandas()
    assert isinstance(got, pd.DataFrame)
    if stage < 4:
        assert out.columns == wide.columns
        plain = P.STAGES[stage][1](spark, rows, SF)
        assert plain.columns == rows.columns and plain.count() == len(got)
    else:
        assert len(got) == rows.count()
    assert P.STAGES[stage][1](spark, rows.limit(0), SF).count() == 0
