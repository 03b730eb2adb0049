"""Queries of the incremental record linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm import incremental
from ragloom.runtime import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the new batches that repeat an accepted unit, with the first row of the unit."""
    return incremental.link_batches(table(spark, sf_dir, "chunk_batch"))


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
