"""Queries of the rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import rank_fusion
from ragloom.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_fusion.leximin(table(spark, sf_dir, "hit"), top=5).select("qid", "id")


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranking, with the weakest percentile of each chunk."""
    return rank_fusion.leximin(table(spark, sf_dir, "hit")).select("qid", "id", F.round(F.col("pcts")[0], 9).alias("weakest"), "position")


_RANKED = """
WITH rows AS (
  SELECT qid, id, lower(trim(collection_name, ' ')) AS c, max(score) AS s FROM hit
  WHERE score IS NOT NULL AND NOT isnan(score) AND qid IS NOT NULL AND id IS NOT NULL AND collection_name IS NOT NULL
  GROUP BY ALL),
pct AS (SELECT qid, id, c, cume_dist() OVER (PARTITION BY qid, c ORDER BY s) AS p FROM rows),
lists AS (SELECT qid, count(DISTINCT c) AS n FROM pct GROUP BY qid),
vec AS (SELECT qid, id, list_sort(list(p)) AS own FROM pct GROUP BY qid, id),
full_vec AS (
  SELECT qid, id, list_concat(list_transform(range(n - len(own)), lambda x: 0.0::DOUBLE), own) AS v FROM vec JOIN lists USING (qid)),
ranked AS (SELECT qid, id, v, row_number() OVER (PARTITION BY qid ORDER BY v DESC, id) AS position FROM full_vec)
"""

QUERIES = {"p3_found": p3_found, "p3_ranking": p3_ranking}
SQL = {
    "p3_found": _RANKED + "SELECT qid, id FROM ranked WHERE position <= 5",
    "p3_ranking": _RANKED + "SELECT qid, id, round(v[1], 9) AS weakest, position::INT AS position FROM ranked",
}
