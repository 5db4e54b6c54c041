"""Latest-version reads, retention and layout changes of the stored tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake import fixed_values as fx
from usagelake.functions.maps import sorted_entries

# Columns outside the key that may still differ between two copies with the same
# version; ordering by them makes the surviving copy the same on every run.
METRIC_TIES = ("user_hash", "region", "app_version", "entrypoint", "attributes")
EVENT_TIES = ("user_hash", "region", "app_version")
PART = "_part"  # where ``dealt_by_day`` has put a row


def dealt_by_day(rows: DataFrame, counted: DataFrame, day: str, key: Sequence[Column], size: int) -> DataFrame:
    """Deal rows into parts of about ``size`` rows of few days, by the hash of ``key`` within a day; adds PART.

    ``counted`` has the days of all rows: a busy day gets more parts, small neighbouring days share one. Dealt while they
    are narrow, rows whose identity key determines day and ``key`` are replaced and written by day without a shuffle.
    """
    spark = rows.sparkSession
    days = sorted(((r[0], r[1]) for r in counted.groupBy(day).count().collect()), key=lambda d: (d[0] is not None, d[0]))
    size = max(1, min(size, math.ceil(sum(n for _, n in days) / (2 * spark.sparkContext.defaultParallelism))))
    shares, last, room = [], -1, 0  # one row per day
    for value, n in days:
        if n > room:
            share = math.ceil(n / size)
            shares.append((value, last + 1, share))
            last, room = last + share, size - n if share == 1 else 0
        else:
            shares.append((value, last, 1))
            room -= n
    type_ = rows.schema[day].dataType.simpleString()
    frame = F.broadcast(spark.createDataFrame(shares, f"_of {type_}, _first INT, _share INT"))
    part = F.coalesce(F.col("_first") + F.pmod(F.xxhash64(*key), F.col("_share")), F.lit(0)).cast("int")
    placed = rows.join(frame, F.col(day).eqNullSafe(F.col("_of")), "left").withColumn(PART, part)
    return placed.drop("_of", "_first", "_share").repartitionById(last + 1 or 1, PART)


def replace_by_key(
    rows: DataFrame, key: Sequence[str], version: str, ties: Sequence[str] = (), day: str | None = None
) -> DataFrame:
    """Keep, per key, the row with the greatest version.

    Planned as a partial and a final window-group limit: each map task keeps one
    row per key before the shuffle, so a key with very many copies never meets in
    one task. ``day`` adds the partition column to the key (a function of the
    event time, so the result is the same) and lets day filters reach the scan.
    Filters on other columns stay above this operator, as they must. Rows that
    ``dealt_by_day`` has dealt are not shuffled again.
    """
    columns = [*key, *([day] if day else []), *([PART] if PART in rows.columns else [])]

    def sortable(name: str) -> Column:
        is_map = rows.schema[name].dataType.typeName() == "map"
        return sorted_entries(F.col(name)) if is_map else F.col(name)

    order = [F.col(version).desc(), *[sortable(t).desc() for t in ties if t in rows.columns]]
    latest = Window.partitionBy(*columns).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")


def replace_metrics(bronze: DataFrame) -> DataFrame:
    return replace_by_key(bronze, fx.METRIC_KEY, "ingest_time", METRIC_TIES, "event_date")


def replace_events(bronze: DataFrame) -> DataFrame:
    return replace_by_key(bronze, fx.EVENT_KEY, "ingest_time", EVENT_TIES, "event_date")


def replace_dimension(rows: DataFrame) -> DataFrame:
    """One row per (organization, account); all other columns break ties."""
    others = [c for c in rows.columns if c not in (*fx.DIMENSION_KEY, "updated_at")]
    return replace_by_key(rows, fx.DIMENSION_KEY, "updated_at", others)


def retention_rows(rows: DataFrame, as_of, days: int) -> DataFrame:
    """Rows whose day plus the retention is after ``as_of`` (a partition filter, no scan of expired days)."""
    return rows.where(F.col("event_date") > F.date_sub(F.lit(as_of).cast("date"), days))


def retention_content(events: DataFrame, as_of, days: int = fx.CONTENT_RETENTION_DAYS) -> DataFrame:
    """Blank the encrypted content of old events; the rows stay."""
    expired = F.col("event_date") <= F.date_sub(F.lit(as_of).cast("date"), days)
    empty = F.create_map().cast("map<string,string>")
    return events.withColumn("content_fields", F.when(expired, empty).otherwise(F.col("content_fields")))


def schema_evolve(old: DataFrame) -> DataFrame:
    """Read an older metrics layout: ``token_type`` became ``subtype``, ``start_type`` is new."""
    if "token_type" in old.columns and "subtype" not in old.columns:
        old = old.withColumnRenamed("token_type", "subtype")
    if "start_type" not in old.columns:
        old = old.withColumn("start_type", F.lit(""))
    return old
