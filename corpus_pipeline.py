"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir). Columns of docs beyond those of `documents` pass through whatever their
names; nulls in any column, empty and very long texts, repeated rows and empty tables are allowed. What a
stage decides follows its operator's docstring:

- language ID drops rows without a letter (`und`) and rows whose best language is no likelier than all
  others together;
- toxicity drops rows whose score reaches the threshold of their language;
- near-dedup keeps one row of each component (smallest doc_id, then first row);
- decontamination drops rows in which a benchmark window occurs;
- encoding returns doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, decontaminate, langid, simhash, toxicity
from corpusmill.llm.common import bound_batches
from corpusmill.session import cut_lineage, ensure_checkpoint_dir, remove, table


def _kept(docs: DataFrame, judge: Callable[[DataFrame, dict[str, str]], DataFrame], keep: Column) -> DataFrame:
    """The rows of docs that `keep` allows after `judge` added its columns to them under neutral names."""
    bound_batches(docs.sparkSession)
    names = docs.columns
    own = [f"_in{i}" for i in range(len(names))]
    judged = judge(docs.toDF(*own), {n: own[names.index(n)] for n in ("doc_id", "text", "lang")})
    return judged.where(keep).select(*own).toDF(*names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def judge(rows: DataFrame, c: dict[str, str]) -> DataFrame:
        model = langid.fit(rows, text_col=c["text"], lang_col=c["lang"])
        return langid.identify(rows, model, text_col=c["text"])

    return _kept(docs, judge, (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0.5))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def judge(rows: DataFrame, c: dict[str, str]) -> DataFrame:
        labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(c["doc_id"]), "toxic")
        model = toxicity.fit(rows, labels, id_col=c["doc_id"], text_col=c["text"], lang_col=c["lang"])
        return toxicity.score_toxicity(rows, model, text_col=c["text"], lang_col=c["lang"])

    return _kept(docs, judge, ~F.col("toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def judge(rows: DataFrame, c: dict[str, str]) -> DataFrame:
        rows = cut_lineage(rows.withColumn("_uid", F.monotonically_increasing_id()))  # numbered once, for both sides of the join
        dropped = simhash.near_duplicates(rows, id_col=c["doc_id"], text_col=c["text"], uid_col="_uid").where("uid <> keeper").select(F.col("uid").alias("_uid"))
        return rows.join(dropped, "_uid", "left_anti")

    return _kept(docs, judge, F.lit(True))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def judge(rows: DataFrame, c: dict[str, str]) -> DataFrame:
        return decontaminate.find_contamination(rows, table(spark, sf_dir, "benchmark"), text_col=c["text"])

    return _kept(docs, judge, ~F.col("contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.op5(docs)


STAGES = [("language ID", language), ("toxicity", toxic), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminated), ("BPE encoding", encoded)]
#: No SQL expresses trained classifiers and tokenizers; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`; what lies between them is kept in the session's shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{folder}/{i}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
