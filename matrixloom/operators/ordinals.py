"""Global ordinals and prefix sums without a global window.

Rows are range-partitioned and sorted by unique keys, numbered within their partition, and written once; partition totals (a row
for each partition) become offsets. Nothing passes through a single task. Ordinals need no second shuffle; prefix sums
shuffle the numbered rows once more, by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import stable

_SHIFT = 33  # monotonically_increasing_id has the partition above this bit


def _placed(df: DataFrame, keys: list[Column | str], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return stable(ranged.withColumn("_m", F.monotonically_increasing_id()), "ordinals").withColumn("_p", F.shiftright("_m", _SHIFT).cast("int"))


def _offsets(placed: DataFrame, total: Column) -> DataFrame:
    """(_p, _before): the total of all partitions before each. One row a partition, so the window is small."""
    sums = placed.groupBy("_p").agg(total.alias("_t"))
    before = F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("_p", F.coalesce(before, F.lit(0)).cast("bigint").alias("_before"))


def with_ordinal(df: DataFrame, keys: list[Column | str], name: str, partitions: int | None = None) -> DataFrame:
    """df with `name`: each row's place from 0 in the order of keys, whose last must make them unique."""
    placed = _placed(df, keys, partitions)
    return placed.join(F.broadcast(_offsets(placed, F.count("*"))), "_p").withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << _SHIFT) - 1))).drop("_m", "_p", "_before")


def with_prefix_sum(df: DataFrame, keys: list[Column | str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """df with `name`: the sum of value over all rows before this one in the order of keys (exclusive)."""
    placed = _placed(df, keys, partitions)
    within = F.sum(value).over(Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("_w", F.coalesce(within, F.lit(0))).join(F.broadcast(_offsets(placed, F.sum(value))), "_p").withColumn(name, (F.col("_before") + F.col("_w")).cast("bigint")).drop("_m", "_p", "_w", "_before")
