import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import sharding


def one_by_one(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_scalar_form():
    keys = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    for n in (1, 2, 40, 1000):
        assert sharding.jump(keys, n).tolist() == [one_by_one(int(k), n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert set(b[a != b]) == {40}
    assert 0.01 < (a != b).mean() < 0.04


def test_slots_nulls_repeats_and_clashing_names(spark):
    rows = [(i, "t") for i in range(300)] + [(7, "t")] * 200 + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(1))
    got = sharding.assign_shards(docs, "doc_id", 5).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert got[got.doc_id == 7]["shard"].nunique() == 1
    assert got[got.doc_id.isna()]["shard"].nunique() == 1


def test_query_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "né"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sharding.op2(docs).collect()}
    assert (got[1]["size"], got[2]["size"], got[3]["size"]) == (3 + 16, 16, 16)
    assert got[1]["text_crc32"] == __import__("zlib").crc32("né".encode())
    assert got[1]["law"] == "key"
    assert sharding.op2(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), 0)


def test_long_texts_and_names_of_the_operator(spark):
    long = "né " * 700_000
    docs = spark.createDataFrame([(1, long), (2, ""), (3, "x")], "doc_id long, text string").withColumns({"_tie": F.lit(1), "_part": F.lit("p"), "grown_shard": F.lit("g"), "size": F.lit(0)})
    got = {r["doc_id"]: r for r in sharding.op2(docs).collect()}
    assert got[1]["size"] == len(long.encode()) + 16 and got[1]["text_crc32"] == __import__("zlib").crc32(long.encode())
    assert sharding.assign_shards(docs, "doc_id", 3).columns == ["doc_id", "text", "size", "shard", "grown_shard", "slot"]
