"""Scopes, top lists and merges shared by the query blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake import fixed_values as fx


def scope(rows: DataFrame, org: str, first_day, last_day) -> DataFrame:
    """Rows of one organization within an inclusive day range. Values are bound, never put into SQL text."""
    days = F.col("event_date").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    return rows.where((F.col("org_id") == F.lit(org)) & days)


def top_n(rows: DataFrame, by: str, key: str | Sequence[str], n: int) -> DataFrame:
    """The n greatest rows; equal values are ordered by the group key."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.orderBy(F.col(by).desc(), *[F.col(k).asc() for k in keys]).limit(n)


def descending(rows: DataFrame, by: str, *keys: str) -> DataFrame:
    return rows.orderBy(F.col(by).desc(), *[F.col(k).asc() for k in keys])


def merge_full_outer(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Aggregates of two tables on a shared key; ``defaults`` fill the missing side."""
    return _filled(left.join(right, key, "full"), defaults)


def merge_left(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    return _filled(left.join(right, key, "left"), defaults)


def _filled(joined: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def union_all(*frames: DataFrame) -> DataFrame:
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    return stacked


def newest_first() -> Column:
    """A number that orders rows by time and then by the first 15 digits of the hexadecimal dedup id.

    Of fixed width, so that its maximum is kept in a hash aggregate; ids that are no hexadecimal text count as 0.
    """
    digits = F.coalesce(F.conv(F.substring("dedup_id", 1, 15), 16, 10).try_cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    return (F.col("ts_ns").cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + digits).cast("decimal(38,0)")


def with_latest(
    rows: DataFrame, keys: Sequence[str], values: dict[str, Column], parts: dict[str, Column], merged: dict[str, Column]
) -> DataFrame:
    """Groups with ``values`` taken from the newest row (the fixed choice for 'any value') and other aggregates.

    The rows are first grouped by keys and values, by hash: ``parts`` are aggregates of these small groups. Only their
    few rows are compared by time; ``merged`` are aggregates over the columns of ``parts``. Equal times fall to the
    greatest dedup id.
    """
    small = rows.select("*", *[v.alias(f"_v{i}") for i, v in enumerate(values.values())]).groupBy(*keys, *[f"_v{i}" for i in range(len(values))])
    reduced = small.agg(F.max(newest_first()).alias("_newest"), *[c.alias(n) for n, c in parts.items()])
    row = F.struct(*[F.col(f"_v{i}") for i in range(len(values))])
    grouped = reduced.groupBy(*keys).agg(
        F.max_by(row, F.struct("_newest", row)).alias("_row"), *[c.alias(n) for n, c in merged.items()]
    )
    taken = [F.col(f"_row._v{i}").alias(n) for i, n in enumerate(values)]
    return grouped.select(*keys, *taken, *merged)


def team_join(per_user: DataFrame, membership: DataFrame) -> DataFrame:
    """Add ``team`` to rows already reduced per user; users without one are '(unassigned)'.

    ``membership`` has one row per account of one organization. Its size is left
    to the optimizer: below the broadcast threshold it is broadcast, above it the
    join shuffles both sides and splits skewed users.
    """
    teams = membership.select(F.col("account_hash").alias("user_hash"), F.col("team").alias("_team"))
    joined = per_user.join(teams, "user_hash", "left")
    known = F.length("_team") > 0
    return joined.withColumn("team", F.when(known, F.col("_team")).otherwise(fx.UNASSIGNED_LABEL)).drop("_team")


def beside(*one_row_frames: DataFrame) -> DataFrame:
    """One-row aggregates side by side, without a join. Columns must differ between the frames."""
    stacked = one_row_frames[0]
    for frame in one_row_frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
