"""One ranking from several lists whose scores differ in scale and spread: leximin of percentiles.

Each list's scores become percentiles (share of the list's items that score no higher), each item's
percentiles are sorted ascending, and the vectors are compared lexicographically: the item whose
weakest list rates it highest comes first, so no list is masked by another with a larger range.

Defined cases: null and NaN scores say nothing (the list does not hold the item); an item that a
list of the group does not hold has percentile 0 there; lists whose scores are all null or NaN are
no lists. Rows stored twice count once (the highest score stays). List names are compared without
case and outer blanks; rows with a null group, item or list are dropped. Ties share a percentile;
tied vectors are ordered by item id. An empty table gives an empty ranking. Other columns are not
read.

A group's list may hold any share of the rows. Percentiles come from a range partitioning of the
distinct scores: counts in each range, offsets of the ranges, then a running sum within a range, so
a hot list is spread over all ranges. Only items are compared within a group, and the top k are cut
on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.runtime import cut, shuffle_width


def percentiles(hits: DataFrame, group: str = "qid", item: str = "id", source: str = "collection_name", score: str = "score") -> DataFrame:
    """(group, item, list, score, pct): one row for each item that a list holds."""
    rows = (
        hits.select(
            F.col(group).alias("g"),
            F.col(item).alias("i"),
            F.lower(F.trim(F.col(source))).alias("c"),
            F.col(score).cast("double").alias("s"),
        )
        .where(F.col("s").isNotNull() & ~F.isnan("s") & F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("c").isNotNull())
        .groupBy("g", "i", "c")
        .agg((F.max("s") + F.lit(0.0)).alias("s"))  # -0.0 and 0.0 are one score
    )
    rows = cut(rows)
    width = shuffle_width(hits.sparkSession)
    scores = cut(
        rows.groupBy("g", "c", "s")
        .agg(F.count("*").alias("n"))
        .repartitionByRange(width, "g", "c", "s")
        .withColumn("part", F.spark_partition_id())
    )
    parts = scores.groupBy("g", "c", "part").agg(F.sum("n").alias("in_part"))
    of_list = Window.partitionBy("g", "c")
    before = of_list.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range at most
    parts = parts.select("g", "c", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"), F.sum("in_part").over(of_list).alias("size"))
    running = Window.partitionBy("g", "c", "part").orderBy("s")
    pct = (
        scores.withColumn("upto", F.sum("n").over(running))
        .join(parts, ["g", "c", "part"])
        .select("g", "c", "s", ((F.col("upto") + F.col("offset")) / F.col("size")).alias("pct"))
    )
    return rows.join(pct, ["g", "c", "s"]).select("g", "i", "c", "s", "pct")


def leximin(hits: DataFrame, group: str = "qid", item: str = "id", source: str = "collection_name", score: str = "score", top: int | None = None) -> DataFrame:
    """(group, item, pcts, position): items of each group, best first; the top ones if top is given."""
    pct = percentiles(hits, group, item, source, score)
    lists = pct.select("g", "c").distinct().groupBy("g").agg(F.count("*").cast("int").alias("lists"))
    vectors = pct.groupBy("g", "i").agg(F.array_sort(F.collect_list("pct")).alias("own"))  # one value a list
    ranked = vectors.join(lists, "g").select(
        "g",
        "i",
        F.concat(F.array_repeat(F.lit(0.0), F.col("lists") - F.size("own")), F.col("own")).alias("pcts"),
    )
    order = Window.partitionBy("g").orderBy(F.col("pcts").desc(), F.col("i"))
    ranked = ranked.withColumn("position", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("position") <= top)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), "pcts", "position")
