"""Number and time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ns(value: Column) -> Column:
    """Nanoseconds as BIGINT; unparsable or missing text counts as 0."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def ns_timestamp(ns: Column) -> Column:
    """Microsecond timestamp of a nanosecond value (floors, also before 1970)."""
    return F.timestamp_micros(_floor_divide(ns, 1000))


def _floor_divide(value: Column, unit: int) -> Column:
    size = F.lit(unit).cast("bigint")
    return F.call_function("div", value - F.pmod(value, size), size)


def ns_text(ns: Column) -> Column:
    """'YYYY-MM-DD HH:MM:SS.nnnnnnnnn' in UTC."""
    fraction = F.pmod(ns, F.lit(1_000_000_000).cast("bigint"))
    whole = F.date_format(F.timestamp_seconds(_floor_divide(ns, 1_000_000_000)), "yyyy-MM-dd HH:mm:ss")
    return F.concat(whole, F.lit("."), F.lpad(fraction.cast("string"), 9, "0"))


def number_text(value: Column) -> Column:
    """Decimal text of a double without a trailing '.0' or a Java-style exponent.

    1200.0 -> '1200', 0.0123 -> '0.0123', 1.0E-4 -> '0.0001', 1.5E7 -> '15000000',
    1.0E21 -> '1e+21', 1.0E-7 -> '1e-7'. The digits are those the JVM prints, which
    before version 19 are not always the shortest ones.
    """
    raw = value.cast("string")
    size = F.abs(value)
    integral = (value == F.floor(value)) & (size < F.lit(9.0e15))
    fixed = F.regexp_replace(
        F.when(size < 1, raw.try_cast("decimal(38,30)").cast("string")).otherwise(
            raw.try_cast("decimal(38,12)").cast("string")
        ),
        r"\.?0+$",
        "",
    )
    scientific = F.regexp_replace(
        F.regexp_replace(F.lower(raw), r"\.0e", "e"), r"e(\d)", "e+$1"
    )
    return (
        F.when(F.isnan(value), F.lit("NaN"))
        .when(size == float("inf"), F.when(value > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity")))
        .when(integral, value.cast("bigint").cast("string"))
        .when((size >= 1e21) | (size < 1e-6), scientific)
        .when(raw.contains("E"), fixed)
        .otherwise(F.regexp_replace(raw, "0+$", ""))
    )
