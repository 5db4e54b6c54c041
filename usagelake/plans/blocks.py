"""Aggregates that several query families share.

``m`` is a scoped metrics frame and ``e`` a scoped events frame throughout the
plans: latest versions only, one organization, one day range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake import fixed_values as fx
from usagelake.functions.maps import attribute, count_if, day_text, dim, label, number, rate, sum_if, total_of, zero
from usagelake.operators.relational import descending, top_n


def metric(m: DataFrame, name: str) -> DataFrame:
    return m.where(F.col("name") == name)


def event(e: DataFrame, kind: str) -> DataFrame:
    return e.where(F.col("event_type") == kind)


def distinct_counts(rows: DataFrame, keys: list[Column], columns: dict[str, str]) -> DataFrame:
    """Exact distinct counts of several columns (result name -> column) per key.

    The rows are reduced to distinct combinations first: counting several columns
    multiplies its input, which should be the few combinations and not every row.
    """
    named = rows.select(*keys, *columns.values()).distinct()
    counts = [F.count_distinct(c).alias(name) for name, c in columns.items()]
    return named.groupBy(*named.columns[: len(keys)]).agg(*counts)


def per_session(m: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Conditional sums of metric values (result name -> condition) per user and session."""
    value = F.col("value")
    return m.groupBy("user_hash", "session_id").agg(*[sum_if(value, c).alias(n) for n, c in sums.items()])


def sum_by(rows: DataFrame, key: Column, key_name: str, value_name: str, missing: str | None = None) -> DataFrame:
    """Sum of metric values per key, greatest first; '' is shown as ``missing``."""
    grouped = rows.groupBy(key.alias(key_name)).agg(total_of(F.col("value")).alias(value_name))
    if missing is not None:
        grouped = grouped.withColumn(key_name, label(F.col(key_name), missing))
    return descending(grouped, value_name, key_name)


def sum_by_day(rows: DataFrame, value_name: str) -> DataFrame:
    return (
        rows.groupBy("event_date")
        .agg(total_of(F.col("value")).alias(value_name))
        .orderBy("event_date")
        .select(day_text(F.col("event_date")).alias("day"), value_name)
    )


def total(rows: DataFrame, value_name: str) -> DataFrame:
    return rows.agg(total_of(F.col("value")).alias(value_name))


def count_by(
    rows: DataFrame, key: Column, key_name: str, value_name: str, missing: str | None = None, n: int | None = None
) -> DataFrame:
    """Number of events per key, greatest first; either labels '' or, as a top list, leaves it out."""
    keyed = rows.select(key.alias(key_name))
    if missing is None:
        keyed = keyed.where(F.col(key_name) != "")
    grouped = keyed.groupBy(key_name).agg(F.count("*").alias(value_name))
    if missing is not None:
        grouped = grouped.withColumn(key_name, label(F.col(key_name), missing))
    return descending(grouped, value_name, key_name) if n is None else top_n(grouped, value_name, key_name, n)


def users_by(rows: DataFrame, value_name: str, n: int) -> DataFrame:
    grouped = rows.groupBy("user_hash").agg(F.count("*").alias(value_name))
    return top_n(grouped, value_name, "user_hash", n)


def successes(e: DataFrame) -> Column:
    return count_if(dim(e, "success") == "true")


def average(e: DataFrame, key: str) -> Column:
    """Mean of a number over the events that carry it, 0 when none does."""
    return zero(F.avg(number(e, key)))


def tool_usage(e: DataFrame, key: str = "tool_name", key_name: str = "tool", uses: str = "uses", n: int = 20):
    """Uses, success rate and mean duration per tool (or per any other dimension)."""
    rows = event(e, "tool_result").withColumn(key_name, dim(e, key)).where(F.col(key_name) != "")
    grouped = rows.groupBy(key_name).agg(
        F.count("*").alias(uses),
        rate(successes(rows), F.count("*")).alias("success_rate"),
        average(rows, "duration_ms").alias("avg_ms"),
    )
    return top_n(grouped, uses, key_name, n)


def decisions(e: DataFrame) -> list[Column]:
    return [count_if(F.col("decision") == d).alias(d) for d in ("accept", "reject", "block")]


def hourly_activity(e: DataFrame) -> DataFrame:
    rows = event(e, "api_request")
    return (
        rows.groupBy(F.hour("timestamp").alias("hour"))
        .agg(F.count("*").alias("requests"), total_of(number(rows, "cost_usd")).alias("cost"))
        .orderBy("hour")
    )


def start_type(m: DataFrame) -> Column:
    """The promoted column; rows stored before it existed carry the attribute."""
    return F.when(F.col("start_type") != "", F.col("start_type")).otherwise(attribute(m, "start_type"))


def session_starts(m: DataFrame) -> DataFrame:
    return sum_by(metric(m, "session.count"), start_type(m), "start_type", "count", fx.NONE_LABEL)


