"""Ranks within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.sources import work as W


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with ``rank`` from 1 in their group, by ``order``. Rows are dealt by ranges of (group, order), so a large group
    fills many tasks; a row's rank is its place in its range and what the ranges before hold of its group. Ranges are
    stored first, so that a task run again numbers the same rows."""
    spark, path = rows.sparkSession, W.fresh(rows.sparkSession, "ranges")
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).write.parquet(path)
    held = spark.read.parquet(path)
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = held.groupBy(group, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))  # a row for each range of a group
    sizes = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), "_before")
    placed = held.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_range").orderBy("_at")))
    out = placed.join(sizes, placed[group].eqNullSafe(sizes["_group"]) & (placed["_range"] == sizes["_of"]))
    return out.withColumn("rank", F.col("_before") + F.col("_place")).drop("_range", "_at", "_place", "_before", "_group", "_of")
