"""What runs along an order: sums so far, values last seen, joins as of a time, frames by value.

Rows are dealt by ranges of (keys, order) and sorted within; a range starts from what the ranges before it hold of its
first key, which is a row for each key and range. So a key of any size lies in many tasks, where a window by key has
but one.

Defined results: null keys are one key; null values count for nothing and are not carried; rows equal in order are taken in the
order of the columns given, then as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.folders import folder


def ranged(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """rows, written in order by ranges, with ``_part`` and ``_place``."""
    by = [*keys, *order, "_row"]
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    placed.write.parquet(at := folder(rows.sparkSession, "ranged"))
    return rows.sparkSession.read.schema(placed.schema).parquet(at)


def _along(placed: DataFrame, keys: tuple[str, ...], local: Column, whole: Column, over: str, name: str, join) -> DataFrame:
    """local: a column of each row by what lies before it in its range; whole: an aggregate of a range, carried on by the function ``over``."""
    in_part = Window.partitionBy("_part", *keys).orderBy("_place")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part", *keys).agg(whole.alias("_whole"))
    carried = F.sum("_whole") if over == "sum" else F.last("_whole", ignorenulls=True)
    starts = parts.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in keys], carried.over(earlier).alias("_start"))
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    met = placed.withColumn("_local", local.over(in_part.rowsBetween(Window.unboundedPreceding, 0))).join(starts, same)
    return met.withColumn(name, join(F.col("_local"), F.col("_start"))).drop("_local", "_start", "_of", *[f"_of_{k}" for k in keys])


def running_sum(placed: DataFrame, keys: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """placed (of ``ranged``) with the sum of value up to each row, its own included."""
    zero = F.coalesce(value, F.lit(0))
    return _along(placed, keys, F.sum(zero), F.sum(zero), "sum", name, lambda here, start: here + F.coalesce(start, F.lit(0)))


def last_seen(placed: DataFrame, keys: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """placed (of ``ranged``) with the last value that is not null up to each row, its own included."""
    held = F.when(value.isNotNull(), F.struct(F.col("_place").alias("place"), value.alias("value")))
    found = _along(placed, keys, F.max(held), F.max(held), "last", name, lambda here, start: F.coalesce(here, start))
    return found.withColumn(name, F.col(name)["value"])


def as_of(left: DataFrame, right: DataFrame, keys: tuple[str, ...], time: str, values: tuple[str, ...], strict: bool = False) -> DataFrame:
    """left with ``values`` of the last row of right (keys, time, values) of the same keys at or before its time (strict: before).

    Both sides go through one sort; nothing is paired that does not match. Rows of right at one time: the last by values counts.
    Without such a row the values are null.
    """
    own = [c for c in left.columns if c not in (*keys, time)]
    side = F.lit(0 if strict else 1)
    a = left.select(*keys, time, side.alias("_side"), F.struct(*own).alias("_left") if own else F.lit(True).alias("_left"))
    b = right.where(F.col(time).isNotNull()).select(*keys, time, F.lit(1 if strict else 0).alias("_side"), F.struct(*values).alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True)
    seen = last_seen(ranged(both, keys, (time, "_side", "_right")), keys, F.col("_right"), "_found")
    found = seen.where(F.col("_left").isNotNull())
    return found.select(*keys, time, *([f"_left.{c}" for c in own]), *[F.when(F.col(time).isNotNull(), F.col("_found")[v]).alias(v) for v in values])


def rolling_sum(rows: DataFrame, keys: tuple[str, ...], time: str, value: str, length: str, name: str) -> DataFrame:
    """rows with the sum of value over the interval ``length`` up to each row's time, both ends included, of the same keys.

    The sum so far at the end less the sum so far before the start: two looks as of a time, however many rows lie in between.
    Times that are null give null.
    """
    sums = rows.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_sum"))
    so_far = running_sum(ranged(sums, keys, (time,)), keys, F.col("_sum"), "_so_far").select(*keys, time, "_so_far")
    ended = as_of(rows, so_far, keys, time, ("_so_far",)).withColumnRenamed("_so_far", "_end")
    begun = ended.withColumn("_at", F.col(time)).withColumn(time, F.col(time) - F.expr(f"interval {length}"))
    both = as_of(begun, so_far, keys, time, ("_so_far",), strict=True)
    return both.withColumn(time, F.col("_at")).withColumn(name, F.col("_end") - F.coalesce("_so_far", F.lit(0))).select(*rows.columns, name)
