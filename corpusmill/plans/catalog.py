"""Every query of the library by name, with the SQL it can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import code, extra, graphs, more, rules, scoring, similar, texts
from corpusmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "code", "extra", "flagship", "graphs", "more", "rules", "scoring", "similar", "texts"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers are ordered together, and how strongly."""
    return scoring.coupling_strength(spark, sf_dir)
