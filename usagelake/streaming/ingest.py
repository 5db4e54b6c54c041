"""Requests -> canonical rows -> keyed messages, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelake import fixed_values as fx
from usagelake.functions.identity import partition_key
from usagelake.operators.adapt import DEFAULT_ADAPTERS, adapt_events, adapt_metrics, enrich_events, enrich_metrics
from usagelake.operators.redact import OrgPolicies, redact_events
from usagelake.sources.otlp import read_otlp_logs, read_otlp_metrics
from usagelake.sources.tables import event_to_row, metric_to_row

MESSAGE = "topic STRING, key STRING, value STRING"


def metric_rows(bodies: DataFrame, pepper: str, adapters=DEFAULT_ADAPTERS) -> DataFrame:
    """Metrics requests -> table rows. Narrow: no shuffle, no state."""
    return metric_to_row(enrich_metrics(adapt_metrics(read_otlp_metrics(bodies), pepper, adapters)))


def event_rows(
    bodies: DataFrame,
    pepper: str,
    policies: OrgPolicies = OrgPolicies(),  # noqa: B008
    master_key: bytes | None = None,
    adapters=DEFAULT_ADAPTERS,
) -> DataFrame:
    """Logs requests -> table rows; redaction runs before the dedup id."""
    events = adapt_events(read_otlp_logs(bodies), pepper, adapters)
    return event_to_row(enrich_events(redact_events(events, policies, master_key)))


def to_messages(rows: DataFrame, topic: str) -> DataFrame:
    """Rows -> (topic, key, value) with the key that keeps a session together."""
    return rows.select(
        F.lit(topic).alias("topic"),
        partition_key(F.col("org_id"), F.col("session_id")).alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("value"),
    )


#: Most input of one micro-batch, so that a first run over a long log goes through it in bounded steps.
PER_TRIGGER = {"maxFilesPerTrigger": 64, "maxOffsetsPerTrigger": 5_000_000}


def canonical_source(spark, path: str | None = None, format: str = "parquet", **options) -> DataFrame:
    """Stream of messages from the beginning of the durable log.

    A folder of files by default; ``format='kafka'`` with ``subscribe`` works
    where that connector is installed. ``PER_TRIGGER`` bounds a micro-batch unless
    ``options`` set another bound.
    """
    bound = "maxOffsetsPerTrigger" if format == "kafka" else "maxFilesPerTrigger"
    reader = spark.readStream.format(format).options(**{bound: PER_TRIGGER[bound]} | options)
    if format == "kafka":
        source = reader.option("startingOffsets", "earliest").load()
        return source.select("topic", F.col("key").cast("string"), F.col("value").cast("string"))
    return reader.schema(MESSAGE).load(path)


def publish_stream(messages: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a message stream to the durable log."""
    return (
        messages.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("compression", "zstd")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_metrics(bodies: DataFrame, pepper: str) -> DataFrame:
    return to_messages(metric_rows(bodies, pepper), fx.METRICS_TOPIC)


def stream_events(
    bodies: DataFrame,
    pepper: str,
    policies: OrgPolicies = OrgPolicies(),  # noqa: B008
    master_key: bytes | None = None,
) -> DataFrame:
    return to_messages(event_rows(bodies, pepper, policies, master_key), fx.EVENTS_TOPIC)
