"""Counts and quantiles that add up: a sketch for each day and group is stored, and any period is answered from sketches, without rows.

Distinct counts are HyperLogLog sketches of 2 ** LG_K registers (relative standard error about 1.04 / sqrt(2 ** LG_K), so 1.6 %);
quantiles are KLL sketches of K (rank error about 1.3 % at K 200). Sketches of parts merge into the sketch of the whole.

Defined results: null values are not counted; a group without values has a count of 0 and null quantiles; null days and groups are
a day and a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 12, 200


def daily(rows: DataFrame, time: str, groups: tuple[str, ...], distinct: str, value: str) -> DataFrame:
    """(day, groups, n, ids, quantiles): a row a day and group, of a fixed size."""
    day = F.to_date(time).alias("day")
    ids = F.hll_sketch_agg(F.col(distinct), F.lit(LG_K)).alias("ids")
    return rows.groupBy(day, *groups).agg(F.count("*").alias("n"), ids, F.expr(f"kll_sketch_agg_double(cast({value} as double), {K})").alias("quantiles"))


def merged(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """(by, n, ids, quantiles) of any grouping of ``daily``: sketches of sketches."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.expr(f"kll_merge_agg_double(quantiles, {K})").alias("quantiles"))


def answers(sketches: DataFrame, *keep: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(keep, n, distinct, q50, ...) out of sketches."""
    quantile = [F.expr(f"CASE WHEN kll_sketch_get_n_double(quantiles) > 0 THEN kll_sketch_get_quantile_double(quantiles, {s}D) END").alias(f"q{round(s * 100)}") for s in shares]
    return sketches.select(*keep, "n", F.hll_sketch_estimate("ids").alias("distinct"), *quantile)
