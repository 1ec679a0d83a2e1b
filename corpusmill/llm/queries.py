"""One query for each operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import ann, bpe, decontaminate, html_wrapper, langid, lattice_lm, sharding, simhash, toxicity, warc_revisit
from corpusmill.session import table


def op1_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op2(table(spark, sf_dir, "documents"))


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op3(table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.op4(table(spark, sf_dir, "pages"))


def op5_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op5(table(spark, sf_dir, "documents"))


def op6_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.op6(table(spark, sf_dir, "pages"))


def op7_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op7(table(spark, sf_dir, "documents"))


def op8_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op8(table(spark, sf_dir, "embeddings"))


def op9_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_subword_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.op10(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_cnn_toxicity, op2_jump_sharding, op3_golay_simhash, op4_warc_revisits, op5_chunk_bpe, op6_wrapper_main_text, op7_naive_bayes_language, op8_multiprobe_neighbours, op9_aho_corasick_decontamination, op10_subword_lattice_score)}
SQL: dict[str, str] = {"op4_warc_revisits": warc_revisit.SQL, "op9_aho_corasick_decontamination": decontaminate.SQL}
