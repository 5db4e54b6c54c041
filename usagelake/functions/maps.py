"""Column helpers for the open maps, missing values, rates and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.schemas import hot_column


def text(value: Column) -> Column:
    """Stored strings use '' for missing, never NULL."""
    return F.coalesce(value, F.lit(""))


def entry(map_column: Column, key: str) -> Column:
    """Map lookup that is NULL for an absent key."""
    return F.try_element_at(map_column, F.lit(key))


def _hot(df: DataFrame, prefix: str, key: str) -> Column | None:
    """The flat copy of a map entry, where the table has one."""
    name = hot_column(prefix, key)
    return F.col(name) if name in df.columns else None


def dim(df: DataFrame, key: str) -> Column:
    """String dimension of an event, '' when absent.

    Flat copies hold '' already; used bare, comparisons with them reach the scan.
    """
    flat = _hot(df, "dim", key)
    return text(entry(F.col("dims"), key)) if flat is None else flat


def number(df: DataFrame, key: str) -> Column:
    """Numeric field of an event, NULL when absent."""
    flat = _hot(df, "num", key)
    return entry(F.col("numbers"), key) if flat is None else flat


def attribute(df: DataFrame, key: str) -> Column:
    """Long-tail attribute of a metric, '' when absent."""
    flat = _hot(df, "attr", key)
    return text(entry(F.col("attributes"), key)) if flat is None else flat


def label(value: Column, missing: str) -> Column:
    return F.when(value == "", F.lit(missing)).otherwise(value)


def zero(value: Column) -> Column:
    """Empty aggregates count as 0."""
    return F.coalesce(value, F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def total_of(value: Column) -> Column:
    """Sum of doubles, 0 when empty.

    Whole and fractional parts are summed apart: whole parts add exactly, so the
    result hardly depends on the order in which partial sums meet.
    """
    whole = F.floor(value).cast("double")
    return zero(F.sum(whole) + F.sum(value - whole))


def sum_if(value: Column, condition: Column) -> Column:
    return total_of(F.when(condition, value))


def rate(part: Column, whole: Column) -> Column:
    """part / whole; NULL instead of an error when whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def sorted_entries(map_column: Column) -> Column:
    """'k=v' pairs of a string map in key order, joined by commas."""
    pairs = F.sort_array(F.map_entries(map_column))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
