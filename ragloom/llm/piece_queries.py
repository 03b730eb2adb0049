"""Queries of the item splitter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import pieces as op
from ragloom.runtime import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "doc_chunk").select("seq", "collection", "text")
    return op.with_limits(items, table(spark, sf_dir, "registry"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all items, within the limits of their collections."""
    return op.pieces(_items(spark, sf_dir), "seq")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that had to be cut: those with a second piece."""
    items = _items(spark, sf_dir)
    parts = op.ranges(items, "seq", "text", "max_chars", "overlap_chars")
    return op.spans(parts, "bigint").where("piece_no > 0").select(F.col("k").alias("seq")).distinct()


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces}
SQL = {
    "p6_found": "SELECT seq FROM doc_chunk JOIN registry ON upper(trim(collection, ' ')) = upper(trim(name, ' ')) WHERE length(text) > max_chars",
}
