"""Exact interpolated quantiles that never hold a group in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slices per factor of two. All doubles fall into at most about 262,000 slices, so
# the per-slice counts of a group stay small however many values it has.
_SLICES = 64


def _slice(value: Column) -> Column:
    """Order-preserving slice number of a value; infinities and NaN have slices of their own at the ends."""
    size = F.floor(F.log2(F.abs(value)) * _SLICES) + F.lit(100_000)
    ends = F.when(F.isnan(value), F.lit(1 << 20)).when(F.abs(value) == float("inf"), F.signum(value).cast("long") * (1 << 19))
    return ends.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


#: Parts that the range of values of a located slice is cut into.
_PARTS = 4096


def _part(value: Column, low: Column, high: Column) -> Column:
    """Order-preserving number of the part of (low, high) that a value lies in; one part where all values are equal."""
    width = high - low
    return F.when((width > 0) & (width < float("inf")), F.floor((value - low) / width * _PARTS)).otherwise(F.lit(0)).cast("int")


def exact_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], most_groups: int | None = None
) -> DataFrame:
    """keys + one column per quantile, interpolated between neighbours at (n-1)*p.

    A descent by counts, straight from the rows and with partial counts before each shuffle:

    1. Count the rows per slice of the value axis and locate the slices that hold the wanted ranks.
    2. Count the rows of these slices per part of their range, and locate the parts.
    3. Count equal values of these parts only, and rank them.

    No value outside a located part is ever shuffled. Without keys there are a few located slices; with keys,
    ``most_groups`` states a proven bound of the number of groups. Then the located slices are broadcast; without a
    bound the optimizer joins them. Groups without values yield no row.
    """
    for p in probabilities.values():
        if not (0 <= p <= 1) or math.isnan(p):
            raise ValueError(f"quantile out of range: {p}")
    keys = list(keys)
    bounded = not keys or most_groups is not None
    group = keys or [F.lit(0)]
    values = (
        rows.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("_v"))
        .withColumn("_s", _slice(F.col("_v")))
    )

    def small(located: DataFrame) -> DataFrame:
        return F.broadcast(located) if bounded else located

    def rank(p: float, up: bool) -> Column:
        position = (F.col("_total") - 1) * F.lit(p)
        return (F.ceil(position) if up else F.floor(position)).cast("long")

    ranks = [rank(p, up) for p in probabilities.values() for up in (False, True)]

    def located(counts: DataFrame, within: list, order: str) -> DataFrame:
        """Rows of counts that hold a wanted rank; ``_start`` moves up to the first rank of the row."""
        upto = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        ended = counts.withColumn("_end", F.col("_start") + F.sum("_n").over(upto)).withColumn("_start", F.col("_end") - F.col("_n"))
        inside = F.exists(F.array(*ranks), lambda r: (r >= F.col("_start")) & (r < F.col("_end")))
        return ended.where(inside).drop("_n", "_end")

    slices = (
        values.groupBy(*keys, "_s")
        .agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
        .withColumn("_start", F.lit(0).cast("long"))
    )
    at = [*keys, "_s"]
    in_slices = values.join(small(located(slices, group, "_s")), at).withColumn("_p", _part(F.col("_v"), F.col("_low"), F.col("_high")))
    carried = ["_low", "_high", "_total", "_start"]
    parts = in_slices.groupBy(*at, "_p", *carried).agg(F.count("*").alias("_n"))
    in_parts = (
        values.join(small(located(parts, at, "_p").withColumnRenamed("_p", "_wanted")), at)
        .where(_part(F.col("_v"), F.col("_low"), F.col("_high")) == F.col("_wanted"))
        .groupBy(*at, "_wanted", "_v", "_total", "_start")
        .agg(F.count("*").alias("_n"))
    )
    by_value = Window.partitionBy(*at, "_wanted").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = in_parts.withColumn("_to", F.col("_start") + F.sum("_n").over(by_value)).withColumn("_from", F.col("_to") - F.col("_n"))

    def holding(r: Column) -> Column:
        return F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col("_v")))

    aggregates = [F.max("_total").alias("_total")]
    for name, p in probabilities.items():
        aggregates += [holding(rank(p, False)).alias(f"_lo_{name}"), holding(rank(p, True)).alias(f"_hi_{name}")]
    found = ranked.groupBy(*keys).agg(*aggregates)
    if not keys:
        found = found.where(F.col("_total").isNotNull())

    def interpolated(name: str, p: float) -> Column:
        position = (F.col("_total") - 1) * F.lit(p)
        share = position - F.floor(position)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return F.when((share == 0) | (low == high), low).otherwise(low * (1 - share) + high * share)

    return found.select(*keys, *[interpolated(n, p).alias(n) for n, p in probabilities.items()])
