"""Row projections and the Parquet tables behind the queries.

Bronze tables are append-only and hold every delivery. Silver tables hold the
latest version of each key plus flat copies of the hot map entries.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from usagelake.functions.maps import entry, text
from usagelake.functions.text import ns_timestamp
from usagelake.operators.replace import PART, replace_events, replace_metrics
from usagelake.schemas import EVENT_COLUMNS, HOT_ATTRIBUTES, HOT_DIMS, HOT_NUMBERS, METRIC_COLUMNS, hot_column
from usagelake.sources.folders import replace_partitions

METRIC_SORT = ("org_id", "name", "model", "user_hash", "session_id")
BRONZE_METRIC_SORT = ("org_id", "name", "session_id", "ts_ns")
BRONZE_EVENT_SORT = ("org_id", "event_type", "session_id", "ts_ns")
EVENT_SORT = ("org_id", "event_type", "dim_tool_name", "user_hash", "session_id")


def _user() -> Column:
    return F.coalesce("account_hash", "user_id_hash").alias("user_hash")


def metric_to_row(metrics: DataFrame) -> DataFrame:
    """Canonical metrics -> written columns; missing strings become ''."""
    texts = (
        "session_id", "model", "language", "edit_type", "subtype", "start_type", "query_source", "tool_name",
        "decision", "department", "team_id", "cost_center", "region", "app_version", "entrypoint",
    )
    return metrics.select(
        "ts_ns",
        "source",
        "name",
        "kind",
        text(F.col("unit")).alias("unit"),
        "value",
        "org_id",
        _user(),
        *[text(F.col(c)).alias(c) for c in texts],
        "attributes",
        text(F.col("dedup_id")).alias("dedup_id"),
    )


def event_to_row(events: DataFrame) -> DataFrame:
    """Canonical events -> written columns; model, status code and decision are lifted from the dims."""
    lifted = ("model", "status_code", "decision")
    texts = ("department", "team_id", "region", "app_version")
    return events.select(
        "ts_ns",
        "source",
        "event_type",
        "org_id",
        _user(),
        "session_id",
        text(F.col("correlation_id")).alias("correlation_id"),
        *[text(entry(F.col("dims"), k)).alias(k) for k in lifted],
        "numbers",
        "dims",
        *[text(F.col(c)).alias(c) for c in texts],
        "attributes",
        "redaction_flags",
        "content_class",
        "content_keyid",
        "content_fields",
        text(F.col("dedup_id")).alias("dedup_id"),
    )


def table_defaults(rows: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    """Add timestamp, event_date (UTC day) and ingest_time. Pass ``ingest_time`` for reproducible runs."""
    stamped = rows.withColumn("timestamp", ns_timestamp(F.col("ts_ns")))
    return stamped.withColumns(
        {
            "event_date": F.to_date("timestamp"),
            "ingest_time": F.current_timestamp() if ingest_time is None else ingest_time,
        }
    )


def named(writer: DataFrameWriter, name: str) -> DataFrameWriter:
    """A writer whose file names begin with ``name``, so that they can be told apart later."""
    return writer.option("mapreduce.output.basename", name) if name else writer


def append_rows(rows: DataFrame, path: str, columns: list[str], name: str = "") -> None:
    """Append to a day-partitioned table; ``name`` begins the names of the new files.

    Rows are written where they are, without a shuffle: deliveries come in order of time, so a task meets few days, and
    ``folders.compact`` merges the small files of tasks that meet many.
    """
    appended = rows.select(*columns).write.mode("append").option("compression", "zstd")
    appended.option("parquet.enable.dictionary#dedup_id", "false")  # nearly all ids differ
    named(appended, name).partitionBy("event_date").parquet(path)


def metrics_sink(metrics: DataFrame, path: str, ingest_time: Column | None = None) -> None:
    append_rows(table_defaults(metric_to_row(metrics), ingest_time), path, METRIC_COLUMNS)


def events_sink(events: DataFrame, path: str, ingest_time: Column | None = None) -> None:
    append_rows(table_defaults(event_to_row(events), ingest_time), path, EVENT_COLUMNS)


def promote_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns(
        {hot_column("attr", k): text(entry(F.col("attributes"), k)) for k in HOT_ATTRIBUTES}
    )


def promote_events(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            **{hot_column("dim", k): text(entry(F.col("dims"), k)) for k in HOT_DIMS},
            **{hot_column("num", k): entry(F.col("numbers"), k) for k in HOT_NUMBERS},
        }
    )


def silver_metrics(bronze: DataFrame) -> DataFrame:
    return promote_metrics(replace_metrics(bronze))


def silver_events(bronze: DataFrame) -> DataFrame:
    return promote_events(replace_events(bronze))


def write_silver(
    rows: DataFrame, path: str, sort: tuple[str, ...], promote: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """Write a silver table by day, sorted so row-group statistics skip other tenants and kinds.

    ``promote`` adds the flat copies once the rows are dealt, so that the shuffle does without them. Rows that
    ``dealt_by_day`` has dealt are not shuffled. Returns the rows as written.
    """
    by_day = rows.drop(PART) if PART in rows.columns else rows.hint("rebalance", F.col("event_date"))
    stored = promote(by_day).sortWithinPartitions("event_date", *sort)
    stored.write.mode("overwrite").option("compression", "zstd").partitionBy("event_date").parquet(path)
    return stored


def refresh_days(bronze: DataFrame, path: str, kind: str, first_day, last_day) -> None:
    """Rebuild the silver partitions of a range of days from bronze; other days keep their files."""
    touched = bronze.where(F.col("event_date").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    first, last = date.fromisoformat(str(first_day)), date.fromisoformat(str(last_day))
    days = [(first + timedelta(days=k)).isoformat() for k in range((last - first).days + 1)]
    if kind == "metrics":
        replace_partitions(silver_metrics(touched), path, days, METRIC_SORT)
    else:
        replace_partitions(silver_events(touched), path, days, EVENT_SORT)
