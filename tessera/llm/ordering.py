"""Sums over all rows before each row in a global order, without a single task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import materialise

#: Equal rows are dealt by this many salts, so that they needn't share a partition.
SALTS = 1024


def ranged(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """``df`` by ranges of ``key``, with ``_part`` and ``_salt``; written, so that the sampled bounds are drawn once."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_salt")
    return materialise(df.select("*", salt).repartitionByRange(n, key, "_salt").withColumn("_part", F.spark_partition_id()), "ranged")


def with_prefix(df: DataFrame, key: str, value: str, ties: list[str]) -> DataFrame:
    """A frame of :func:`ranged` with ``_before`` (sum of ``value`` over all earlier rows), ``_rank`` and ``_total``."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition: bounded by their number.
    totals = df.groupBy("_part").agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows"))
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_from"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"),
        F.sum("_sum").over(Window.partitionBy()).alias("_total"),
    )
    within = Window.partitionBy("_part").orderBy(key, "_salt", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("_upto", F.sum(value).over(within)).withColumn("_nth", F.count(F.lit(1)).over(within) - 1).join(F.broadcast(starts), "_part")
    return out.withColumn("_before", F.col("_from") + F.col("_upto") - F.col(value)).withColumn("_rank", F.col("_first") + F.col("_nth")).drop("_from", "_first", "_upto", "_nth")
