"""Vendor records -> canonical metrics and events.

One ``SourceAdapter`` describes one tool. All adapters are applied in a single
projection (a CASE over the routed source), so adding a tool adds no scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake import fixed_values as fx
from usagelake.functions.identity import (
    account_identity,
    device_identity,
    email_identity,
    event_dedup_id,
    metric_dedup_id,
    pseudonymize,
)
from usagelake.functions.maps import entry, text


@dataclass(frozen=True)
class SourceAdapter:
    """What one telemetry source calls things."""

    source: str
    service_names: tuple[str, ...] = ()
    scope_parts: tuple[str, ...] = ()
    prefix: str = ""
    promoted: dict[str, str] = field(default_factory=dict)
    event_types: dict[str, str] | None = None  # None: the source's log records are skipped
    content_keys: tuple[str, ...] = ()
    consumed_keys: tuple[str, ...] = ()

    def recognizes(self, service: Column, scope: Column) -> Column:
        lowered = F.lower(F.coalesce(scope, F.lit("")))
        match = F.lower(F.coalesce(service, F.lit(""))).isin(*self.service_names)
        for part in self.scope_parts:
            match = match | lowered.contains(part)
        return match


CLI_ADAPTER = SourceAdapter(
    source=fx.CLI_SOURCE,
    service_names=fx.CLI_SERVICE_NAMES,
    scope_parts=fx.CLI_SCOPE_PARTS,
    prefix=fx.CLI_PREFIX,
    promoted=fx.PROMOTED_ATTRIBUTES,
    event_types=fx.EVENT_TYPES,
    content_keys=fx.CONTENT_KEYS,
    consumed_keys=fx.CONSUMED_EVENT_KEYS,
)
DEFAULT_ADAPTERS = (CLI_ADAPTER,)


def route_source(service: Column, scope: Column, adapters=DEFAULT_ADAPTERS) -> Column:
    """Source id of the first adapter that recognizes the record, else 'unknown'."""
    routed = None
    for adapter in adapters:
        match = adapter.recognizes(service, scope)
        routed = F.when(match, adapter.source) if routed is None else routed.when(match, adapter.source)
    return F.lit(fx.UNKNOWN_SOURCE) if routed is None else routed.otherwise(fx.UNKNOWN_SOURCE)


def _per_source(adapters, choose, otherwise: Column) -> Column:
    """CASE over the routed source; ``choose`` gives the column of one adapter."""
    case = None
    for adapter in adapters:
        is_source = F.col("source") == adapter.source
        value = choose(adapter)
        case = F.when(is_source, value) if case is None else case.when(is_source, value)
    return otherwise if case is None else case.otherwise(otherwise)


def _without(map_column: Column, keys) -> Column:
    return F.map_filter(map_column, lambda k, _: ~k.isin(*keys))


def _unprefixed(name: Column, prefix: str) -> Column:
    return F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name)


def merge_context(records: DataFrame, pepper: str) -> DataFrame:
    """Add identity and resource columns read from resource and point attributes; the point wins.

    Raw identities are replaced by pseudonyms here and occur in no later column.
    """
    merged = F.col("_merged")
    return (
        records.withColumn("_merged", F.map_concat("resource_attributes", "attributes"))
        .withColumns(
            {
                "org_id": F.coalesce(entry(merged, "organization.id"), F.lit(fx.UNKNOWN_ORG)),
                "user_id_hash": pseudonymize(device_identity(merged), pepper),
                "account_hash": pseudonymize(account_identity(merged), pepper),
                "email_hash": pseudonymize(email_identity(merged), pepper),
                "session_id": text(entry(merged, "session.id")),
                "app_version": entry(merged, "app.version"),
                "entrypoint": entry(merged, "app.entrypoint"),
                "terminal_type": entry(merged, "terminal.type"),
                "department": entry(merged, "department"),
                "team_id": entry(merged, "team.id"),
                "cost_center": entry(merged, "cost_center"),
                "region": entry(merged, "region"),
                "resource_tail": resource_long_tail(F.col("resource_attributes")),
            }
        )
        .drop("_merged")
    )


def resource_long_tail(resource_attributes: Column) -> Column:
    return _without(resource_attributes, fx.RESOURCE_KEYS)


def _routed(records: DataFrame, adapters) -> DataFrame:
    service = entry(F.col("resource_attributes"), "service.name")
    return records.withColumn("source", route_source(service, F.col("scope_name"), adapters))


def adapt_metrics(points: DataFrame, pepper: str, adapters=DEFAULT_ADAPTERS) -> DataFrame:
    """Flat data points -> canonical metrics (unknown sources keep their names and attributes)."""
    raw = F.col("attributes")
    promoted_columns = list(fx.PROMOTED_ATTRIBUTES.values())

    def promoted(column: str) -> Column:
        def of(adapter: SourceAdapter) -> Column:
            keys = [k for k, target in adapter.promoted.items() if target == column]
            return entry(raw, keys[0]) if keys else F.lit(None).cast("string")

        return _per_source(adapters, of, F.lit(None).cast("string"))

    kept = _per_source(
        adapters,
        lambda a: _without(raw, (*a.promoted, *fx.RESOURCE_KEYS)),
        _without(raw, fx.RESOURCE_KEYS),
    )
    return (
        merge_context(_routed(points, adapters), pepper)
        .withColumns(
            {
                "schema_version": F.lit(fx.SCHEMA_VERSION),
                "name": _per_source(adapters, lambda a: _unprefixed(F.col("name"), a.prefix), F.col("name")),
                **{column: promoted(column) for column in promoted_columns},
                "attributes": kept,
            }
        )
        .drop("resource_attributes", "scope_name", "scope_version")
    )


def event_taxonomy(event_name: Column, adapter: SourceAdapter = CLI_ADAPTER) -> Column:
    """Canonical event type of a vendor event name; unlisted or missing names are 'unknown'."""
    types = F.create_map(*[F.lit(x) for pair in (adapter.event_types or {}).items() for x in pair])
    return F.coalesce(F.try_element_at(types, _unprefixed(event_name, adapter.prefix)), F.lit(fx.UNKNOWN_EVENT))


def split_mcp_tool(tool: Column) -> tuple[Column, Column]:
    """(server, tool) of 'mcp__<server>__<tool>', split at the first separator; NULLs otherwise."""
    rest = F.substring(tool, len(fx.MCP_PREFIX) + 1, 1 << 30)
    position = F.instr(rest, fx.MCP_SEPARATOR)  # 1-based, 0 when absent
    after = position + len(fx.MCP_SEPARATOR)
    valid = tool.startswith(fx.MCP_PREFIX) & (position > 1) & (after <= F.length(rest))
    server = F.when(valid, F.substring(rest, F.lit(1), position - 1))
    return server, F.when(valid, F.substring(rest, after, F.length(rest)))


def adapt_events(records: DataFrame, pepper: str, adapters=DEFAULT_ADAPTERS) -> DataFrame:
    """Flat log records -> canonical events with numbers, dims and staged free text.

    Records of sources without an event taxonomy are skipped; ``skipped_records`` counts them.
    """
    with_events = [a for a in adapters if a.event_types is not None]
    raw, empty = F.col("attributes"), F.create_map().cast("map<string,string>")
    routed = _routed(records, adapters).where(F.col("source").isin(*[a.source for a in with_events]))

    def split(adapter: SourceAdapter, content: bool) -> Column:
        dropped = [*adapter.consumed_keys, *fx.RESOURCE_KEYS]
        return F.map_filter(
            raw, lambda k, _: ~k.isin(*dropped) & (k.isin(*adapter.content_keys) == F.lit(content))
        )

    def is_numeric(value: Column) -> Column:
        return value.rlike(fx.NUMERIC_TEXT)

    fields = F.col("_fields")
    server, tool = split_mcp_tool(entry(F.col("dims"), "tool_name"))
    unlisted = F.when((F.col("event_type") == fx.UNKNOWN_EVENT) & (F.length("event_name") > 0), F.col("event_name"))
    # A step before they are used: in a function with a lambda each use would work them out again.
    extra = {"mcp_server": ("_server", server), "mcp_tool": ("_tool", tool), "event.name": ("_unlisted", unlisted)}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, (c, _) in extra.items()])
    more = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    has_more = F.coalesce(*[c for c, _ in extra.values()]).isNotNull()
    return (
        merge_context(routed, pepper)
        .withColumns(
            {
                "_fields": _per_source(with_events, lambda a: split(a, False), empty),
                "staged_content": _per_source(with_events, lambda a: split(a, True), empty),
                "event_type": _per_source(
                    with_events, lambda a: event_taxonomy(F.col("event_name"), a), F.lit(fx.UNKNOWN_EVENT)
                ),
                "correlation_id": entry(raw, "prompt.id"),
            }
        )
        .withColumns(
            {
                "schema_version": F.lit(fx.SCHEMA_VERSION),
                "numbers": F.transform_values(
                    F.map_filter(fields, lambda _, v: is_numeric(v)), lambda _, v: v.cast("double")
                ),
                "dims": F.map_filter(fields, lambda _, v: ~is_numeric(v)),
            }
        )
        .withColumns(dict(extra.values()))
        .withColumn("dims", F.when(has_more, F.map_concat("dims", more)).otherwise(F.col("dims")))
        .withColumn("attributes", empty)
        .drop("_fields", *[c for c, _ in extra.values()], "resource_attributes", "scope_name", "scope_version", "event_name", "body", "severity")
    )


def skipped_records(records: DataFrame, adapters=DEFAULT_ADAPTERS) -> DataFrame:
    """Log records without an event mapping, counted per service."""
    known = [a.source for a in adapters if a.event_types is not None]
    return (
        _routed(records, adapters)
        .where(~F.col("source").isin(*known))
        .groupBy(text(entry(F.col("resource_attributes"), "service.name")).alias("service"))
        .agg(F.count("*").alias("skipped"))
    )


def enrich_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("dedup_id", metric_dedup_id())


def enrich_events(events: DataFrame) -> DataFrame:
    """Call after redaction: the id covers the scrubbed dims."""
    return events.withColumn("dedup_id", event_dedup_id())
