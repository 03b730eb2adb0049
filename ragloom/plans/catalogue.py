"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.plans import reference_queries

_MODULES = (reference_queries,)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_queries.flagship(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
