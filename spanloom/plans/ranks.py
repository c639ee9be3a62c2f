"""Ranks over all rows without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.scratch import cut


def ranked(df: DataFrame, by: list[str], order: list[str], rank: str = "rn", total: str = "n") -> DataFrame:
    """`df` with `rank` (from 1 in the order of `order`, which must tell rows apart) within equal `by`, and `total` (rows of that group).

    Rows are dealt by ranges of both; a range is numbered by itself and shifted by the sizes of the group's earlier ranges. `by` must not be null."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy(*by, "_part").agg(F.count("*").alias("_size"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(group).alias(total))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return placed.withColumn("_own", own).join(sizes, [*by, "_part"]).withColumn(rank, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def at_share(value: str, q: float, rank: str = "rn", total: str = "n") -> Column:
    """An aggregate: the interpolated value at share q of ranked rows (the two rows around (n - 1) * q)."""
    place = (F.col(total) - 1) * F.lit(q)
    low, part = F.floor(place), place - F.floor(place)
    weight = F.when(F.col(rank) == low + 1, 1 - part).when(F.col(rank) == low + 2, part)
    return F.sum(F.col(value) * weight)
