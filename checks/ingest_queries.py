"""Ingestion, adaptation, redaction, store, dimension and streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks import oracle
from checks import oracle_ingest as given
from usagelake import fixed_values as fx
from usagelake.functions import redaction as scan
from usagelake.functions.crypto import decrypt_content
from usagelake.functions.identity import partition_key, pseudonymize
from usagelake.functions.maps import entry, text, zero
from usagelake.functions.text import ns_text, parse_ns
from usagelake.lake import Lake
from usagelake.operators import adapt, dimensions, redact, replace
from usagelake.operators.counters import cumulative_to_delta, read_deltas, refresh_deltas
from usagelake.operators.relational import merge_full_outer, merge_left, scope, team_join, union_all
from usagelake.sources import folders, tables, testdata
from usagelake.sources.otlp import flatten_anyvalue, read_otlp_logs, read_otlp_metrics, reject_malformed
from usagelake.schemas import EVENT_COLUMNS, EVENTS, METRIC_COLUMNS, ATTRIBUTES
from usagelake.streaming import ingest, store

PEPPER = given.PEPPER
MASTER_KEY = bytes(range(32))
POLICIES = redact.OrgPolicies(given.CAPTURE_ORGS, given.DENY, {"org_3": given.DENY_ORG_3})
INGEST_TIME = "2024-06-01"


def _m(lake):
    return scope(lake.metrics(), oracle.ORG, oracle.FIRST, oracle.LAST)


def _e(lake):
    return scope(lake.events(), oracle.ORG, oracle.FIRST, oracle.LAST)


def _points(lake) -> DataFrame:
    return read_otlp_metrics(lake.metric_requests(), keep=("ok", "pk"))


def _records(lake) -> DataFrame:
    return read_otlp_logs(lake.log_requests(), keep=("i",))


def _metrics(lake) -> DataFrame:
    return adapt.enrich_metrics(adapt.adapt_metrics(_points(lake), PEPPER))


def _events(lake) -> DataFrame:
    adapted = adapt.adapt_events(_records(lake), PEPPER)
    return adapt.enrich_events(redact.redact_events(adapted, redact.OrgPolicies()))


def _table(lake, name: str) -> DataFrame:
    return testdata.table(lake.spark, lake.sf_dir, name)


def _case(index: Column, *values: Column) -> Column:
    case = F.when(index == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        case = case.when(index == i, value)
    return case


def _lit_map(**columns) -> Column:
    pairs = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k.replace("__", ".")), v)])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def _day() -> Column:
    return F.date_format("event_date", "yyyy-MM-dd").alias("day")


# --- requests -------------------------------------------------------------------


def read_metrics(lake):
    p = _points(lake)
    return p.select(
        "ok",
        "pk",
        "name",
        "kind",
        text(F.col("unit")).alias("unit"),
        "value",
        "ts_ns",
        entry(F.col("resource_attributes"), "service.name").alias("service"),
        "scope_name",
        entry(F.col("attributes"), "session.id").alias("session_id"),
        F.size("attributes").alias("n_attributes"),
        F.size("resource_attributes").alias("n_resource"),
    )


def read_logs(lake):
    return _records(lake).select(
        "i",
        "event_name",
        "ts_ns",
        "severity",
        "scope_name",
        entry(F.col("attributes"), "prompt.id").alias("prompt_id"),
        F.size("attributes").alias("n_attributes"),
    )


def _nested(depth, member):
    """Value around a member: lists and key/value lists by turns, the outermost a list."""
    opening, closing = "", ""
    for k in range(depth):
        opening += '{"arrayValue":{"values":[' if k % 2 == 0 else '{"kvlistValue":{"values":[{"key":"k[]","value":'
        closing = ("]}}" if k % 2 == 0 else "}]}}") + closing
    return F.concat(F.lit(opening), member, F.lit(closing))


def anyvalue(lake):
    e = _table(lake, "events")
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    quote = F.lit('"')
    member = F.concat(F.lit('{"stringValue":"['), kind, F.lit('] \\\\ \\"'), number, F.lit('\\""}'))
    body = F.concat(
        F.lit('[{"key":"s","value":{"stringValue":"first"}},{"key":"s","value":{"stringValue":"'),
        kind,
        F.lit('"}},{"key":"b","value":{"boolValue":true}},{"key":"n","value":{"intValue":'),
        F.when(F.col("event_id") % 2 == 0, F.concat(quote, number, quote)).otherwise(number),
        F.lit('}},{"key":"d","value":{"doubleValue":'),
        F.col("value").cast("string"),
        F.lit('}},{"key":"a","value":{"arrayValue":{"values":[{"intValue":'),
        number,
        F.lit('},{"stringValue":"'),
        kind,
        F.lit('"},{}]}}},{"key":"m","value":{"kvlistValue":{"values":[{"key":"x","value":{"stringValue":"'),
        kind,
        F.lit('"}},{"key":"y","value":{"arrayValue":{"values":[{"intValue":'),
        F.col("user_id").cast("string"),
        F.lit('}]}}},{"key":"z"}]}}},{"key":"","value":{"intValue":1}},{"key":"none"},{"key":"empty","value":{}}'),
        *[x for k in (3, 6) for x in (F.lit(f',{{"key":"l{k}","value":'), _nested(k, member), F.lit("}"))],
        F.lit("]"),
    )
    flat = e.select("event_id", flatten_anyvalue(F.from_json(body, ATTRIBUTES)).alias("f"))
    return flat.select("event_id", *[entry(F.col("f"), k).alias(k) for k in ("s", "b", "n", "d", "a", "m", "l3", "l6")], F.size("f").alias("entries"))


def ns(lake):
    e = _table(lake, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    micros = F.col("us").cast("string")
    raw = _case(
        F.col("event_id") % 6,
        F.concat(micros, F.lit("789")),
        F.lit("abc"),
        F.lit(None).cast("string"),
        F.lit(""),
        F.concat(micros, F.lit("000.5")),
        F.concat(F.lit(" "), micros, F.lit("007 ")),
    )
    parsed = e.select("event_id", parse_ns(raw).alias("ts_ns"))
    return parsed.withColumn("ns_text", ns_text(F.col("ts_ns")))


def malformed(lake):
    bodies = lake.log_requests()
    i = F.col("i")
    broken = (
        F.when(i % 7 == 0, F.substring("value", 1, 60))
        .when(i % 11 == 0, F.lit("5"))
        .when(i % 13 == 0, F.lit("null"))
        .otherwise(F.col("value"))
    )
    return reject_malformed(bodies.withColumn("value", broken), signal="logs").select("i", "rejected")


# --- adaptation -----------------------------------------------------------------


def routed(lake):
    none = F.lit(None).cast("string")
    services = ("claude-code", "Claude_Code", "mystery-tool", None, None, None, "claude")
    scopes = ("x", None, "meter", "com.vendor.claude_code.events", "A.CLAUDE-CODE", "meter", None)

    def pick(values):
        return _case(F.col("event_id") % 7, *[none if v is None else F.lit(v) for v in values])

    source = adapt.route_source(pick(services), pick(scopes))
    return _table(lake, "events").select("event_id", source.alias("source"))


def context(lake):
    merged = adapt.merge_context(_points(lake), PEPPER)
    columns = (
        "org_id", "session_id", "app_version", "entrypoint", "department", "team_id", "region", "cost_center",
        "user_id_hash", "account_hash", "email_hash",
    )
    return merged.select("ok", "pk", "ts_ns", *[text(F.col(c)).alias(c) for c in columns])


def long_tail(lake):
    tail = _points(lake).select(adapt.resource_long_tail(F.col("resource_attributes")).alias("t"))
    return tail.groupBy(entry(F.col("t"), "host.name").alias("host"), F.size("t").alias("entries")).agg(
        F.count("*").alias("points")
    )


_PROMOTED = ("model", "language", "subtype", "start_type", "query_source", "tool_name", "decision")


def metric_known(lake):
    m = adapt.adapt_metrics(_points(lake), PEPPER).where(F.col("source") == fx.CLI_SOURCE)
    attributes = F.col("attributes")
    return m.select(
        "session_id",
        "ts_ns",
        "name",
        "kind",
        "value",
        *[text(F.col(c)).alias(c) for c in _PROMOTED],
        text(entry(attributes, "effort")).alias("effort"),
        text(entry(attributes, "agent.name")).alias("agent_name"),
        F.size(attributes).alias("n_attributes"),
    )


def metric_unknown(lake):
    m = adapt.adapt_metrics(_points(lake), PEPPER).where(F.col("source") == fx.UNKNOWN_SOURCE)
    return m.select(
        "session_id",
        "ts_ns",
        "name",
        text(F.col("model")).alias("model"),
        text(entry(F.col("attributes"), "model")).alias("model_attribute"),
        F.size("attributes").alias("n_attributes"),
    )


def event_adapted(lake):
    e = adapt.adapt_events(_records(lake), PEPPER)
    return e.select(
        "i",
        "event_type",
        "correlation_id",
        text(entry(F.col("dims"), "mcp_server")).alias("mcp_server"),
        text(entry(F.col("dims"), "mcp_tool")).alias("mcp_tool"),
        entry(F.col("numbers"), "duration_ms").alias("duration_ms"),
        entry(F.col("numbers"), "cost_usd").alias("cost_usd"),
        F.size("numbers").alias("n_numbers"),
        F.size("dims").alias("n_dims"),
        F.array_join(F.map_keys("staged_content"), ",").alias("staged"),
        "account_hash",
    )


def taxonomy(lake):
    names = [*fx.EVENT_TYPES, "api_request_body", "mystery"]
    e = _table(lake, "events")
    bare = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    sent = F.concat(F.when(F.col("event_id") % 2 == 0, fx.CLI_PREFIX).otherwise(""), F.col("vendor_name"))
    records = e.select(
        bare.alias("vendor_name"),
        "event_id",
        F.create_map(F.lit("service.name"), F.lit("claude-code")).alias("resource_attributes"),
        F.lit(None).cast("string").alias("scope_name"),
        F.lit(None).cast("string").alias("scope_version"),
        F.col("event_id").alias("ts_ns"),
    ).withColumn("event_name", sent)
    records = records.withColumns(
        {
            "attributes": F.create_map(F.lit("event.name"), F.col("event_name")),
            "body": F.lit(""),
            "severity": F.lit(0),
        }
    )
    adapted = adapt.adapt_events(records, PEPPER)
    kept = text(entry(F.col("dims"), "event.name")).alias("kept_name")
    return adapted.groupBy("vendor_name", "event_type", kept).agg(F.count("*").alias("records"))


def mcp_split(lake):
    e = _table(lake, "events")
    tool = _case(
        F.col("event_id") % 8,
        F.lit("mcp__github__search_issues"),
        F.lit("mcp__a__b__c"),
        F.lit("mcp__x"),
        F.lit("Bash"),
        F.lit("mcp____x__y"),
        F.lit("mcp__a__"),
        F.concat(F.lit("mcp__s"), F.col("user_id").cast("string"), F.lit("__t")),
        F.lit("xmcp__a__b"),
    )
    server, name = adapt.split_mcp_tool(F.col("tool"))
    return e.select("event_id", tool.alias("tool")).select(
        "event_id", "tool", text(server).alias("server"), text(name).alias("mcp_tool")
    )


def pseudonyms(lake):
    return _table(lake, "customer").select("c_custkey", pseudonymize(F.col("c_name"), PEPPER).alias("hash"))


def identities(lake):
    key = F.col("c_custkey")
    number = key.cast("string")

    def named(prefix: str) -> Column:
        return F.concat(F.lit(prefix), number)

    attributes = _lit_map(
        user__account_uuid=F.when(key % 5 == 0, named("uuid-")).when(key % 5 == 2, F.lit("")),
        user__account_id=F.when(key % 5 <= 2, named("id-")),
        user__email=F.when(key % 5 <= 3, F.concat(number, F.lit("@example.com"))),
        user__id=F.when(key % 3 == 0, named("dev-")),
        session__id=F.when(key % 3 <= 1, named("ses-")),
    )
    records = _table(lake, "customer").select(
        "c_custkey",
        F.create_map().cast("map<string,string>").alias("resource_attributes"),
        attributes.alias("attributes"),
    )
    merged = adapt.merge_context(records, PEPPER)
    return merged.select(
        "c_custkey", *[text(F.col(c)).alias(c) for c in ("user_id_hash", "account_hash", "email_hash")]
    )


def metric_rows(lake):
    return tables.metric_to_row(_metrics(lake)).drop("attributes")


def event_rows(lake):
    rows = tables.event_to_row(_events(lake))
    return rows.withColumn("flags", F.array_join("redaction_flags", ",")).drop(
        "numbers", "dims", "attributes", "redaction_flags", "content_fields"
    )


def partition_keys(lake):
    records = testdata.event_records(lake.spark, lake.sf_dir)
    key = partition_key(F.col("org_id"), text(F.col("session_id"))).alias("key")
    return records.groupBy(key).agg(F.count("*").alias("events"))


# --- store ----------------------------------------------------------------------


def defaults(lake):
    e = _table(lake, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"))
    return tables.table_defaults(e, F.lit(INGEST_TIME).cast("timestamp")).drop("ts_ns")


def replaced(lake):
    return replace.replace_metrics(lake.bronze_metrics()).select(
        "org_id", "source", "name", "session_id", "ts_ns", "value", "region", "app_version", "entrypoint"
    )


def retained_rows(lake):
    """Both tables in storage, and what a plain read of their folders finds after the retention job."""

    def daily(kind, rows, columns, as_of, days):
        path = lake.scratch(f"retained-{kind}")
        tables.append_rows(rows, path, columns)
        folders.drop_expired(lake.spark, path, as_of, days)
        if not folders.partitions(folders.Files(lake.spark, path), path):
            return lake.spark.createDataFrame([], "kind STRING, day STRING, rows BIGINT")
        return lake.spark.read.parquet(path).groupBy(F.lit(kind).alias("kind"), _day()).agg(F.count("*").alias("rows"))

    return union_all(
        daily("events", lake.bronze_events(), EVENT_COLUMNS, given.AS_OF_EVENTS, fx.EVENT_RETENTION_DAYS),
        daily("metrics", lake.bronze_metrics(), METRIC_COLUMNS, given.AS_OF_METRICS, fx.METRIC_RETENTION_DAYS),
    )


def retained_content(lake):
    """Events in storage after the job that blanks expired content: a plain read finds no ciphertext there."""
    path = lake.scratch("retained-content")
    tables.append_rows(lake.bronze_events(), path, EVENT_COLUMNS)
    folders.clear_expired_content(lake.spark, path, EVENTS, given.AS_OF_CONTENT, fx.CONTENT_RETENTION_DAYS)
    kept = lake.spark.read.parquet(path)
    return kept.groupBy(_day()).agg(
        F.count("*").alias("rows"), F.count_if(F.size("content_fields") > 0).alias("with_content")
    )


def evolved(lake):
    old = lake.bronze_metrics().withColumnRenamed("subtype", "token_type").drop("start_type")
    return replace.schema_evolve(old).groupBy("subtype", "start_type").agg(F.count("*").alias("rows"))


def loaded_directory(lake):
    files = testdata.directory_files(lake.spark, lake.sf_dir)
    return dimensions.directory_load(files, PEPPER, INGEST_TIME).select(
        "org_id", "account_hash", "display_name", "email", "external_id"
    )


def _ingest_time() -> Column:
    return F.lit(INGEST_TIME).cast("timestamp")


def metrics_written(lake):
    path = lake.scratch("metrics-sink")
    tables.metrics_sink(_metrics(lake), path, _ingest_time())
    return (
        lake.spark.read.parquet(path)
        .groupBy(_day())
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct("dedup_id").alias("ids"),
            zero(F.sum("value")).alias("total"),
        )
    )


def events_written(lake):
    path = lake.scratch("events-sink")
    tables.events_sink(_events(lake), path, _ingest_time())
    return (
        lake.spark.read.parquet(path)
        .groupBy(_day())
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct("dedup_id").alias("ids"),
            zero(F.sum(entry(F.col("numbers"), "cost_usd"))).alias("total"),
        )
    )


def delta(lake):
    counters = lake.metrics().where("kind = 'counter'").select("user_hash", "name", "ts_ns", "value")
    return cumulative_to_delta(counters, ["user_hash", "name"])


def carried_delta(lake):
    """Deltas out of the stream: the days each round touched, late points in the second one."""
    paths, log, checkpoint = _paths(lake), lake.scratch("log"), lake.scratch("offsets")
    silver, path = (lake.scratch("silver-m"), lake.scratch("silver-e")), lake.scratch("deltas")
    series, columns = ["user_hash", "name"], "user_hash STRING, name STRING, ts_ns BIGINT, value DOUBLE"

    def derive(days):
        points = lake.spark.read.parquet(silver[0]).where("kind = 'counter'").select(*series, "ts_ns", "value", "event_date")
        refresh_deltas(points, path, days["metrics"], series)

    messages = _read_log(lake, _log(lake, *[_metric_messages(lake)] * 2))
    late = F.pmod(F.xxhash64("value"), F.lit(5)) == 0
    for rows in (messages.where(~late), messages.where(late)):
        _deliver(rows, log)
        _store(lake, log, paths, checkpoint)
        store.refresh_silver(lake.spark, paths, *silver, derive=derive)
    return read_deltas(lake.spark, path, f"{columns}, event_date DATE", series).drop("event_date")


# --- messages and streams ---------------------------------------------------------


def _event_messages(lake) -> DataFrame:
    return ingest.to_messages(tables.event_to_row(_events(lake)), fx.EVENTS_TOPIC)


def _metric_messages(lake) -> DataFrame:
    return ingest.to_messages(tables.metric_to_row(_metrics(lake)), fx.METRICS_TOPIC)


def _poison(lake) -> DataFrame:
    broken = testdata.event_records(lake.spark, lake.sf_dir).where("i % 20 = 0")
    return broken.select(
        F.lit(fx.EVENTS_TOPIC).alias("topic"),
        partition_key(F.col("org_id"), text(F.col("session_id"))).alias("key"),
        F.concat(_case((F.col("i") / 20).cast("int") % len(given.POISON), *map(F.lit, given.POISON)), F.col("i").cast("string")).alias("value"),
    )


def _log(lake, *parts: DataFrame) -> str:
    """Messages written as the durable log, which a stream or a batch can read."""
    path = lake.scratch("log")
    for messages in parts:
        _deliver(messages, path)
    return path


def _deliver(messages: DataFrame, log: str) -> None:
    """More messages for a durable log, in row groups that tasks can share."""
    messages.write.mode("append").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(log)


def _full_log(lake) -> str:
    return _log(lake, _metric_messages(lake), _event_messages(lake), _poison(lake))


def _read_log(lake, path: str) -> DataFrame:
    return lake.spark.read.schema(ingest.MESSAGE).parquet(path)


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def source_read(lake):
    out = lake.scratch("consumed")
    stream = ingest.canonical_source(lake.spark, _full_log(lake))
    _finish(ingest.publish_stream(stream, out, lake.scratch("offsets")))
    return (
        lake.spark.read.schema(ingest.MESSAGE)
        .parquet(out)
        .groupBy("topic")
        .agg(F.count("*").alias("messages"), F.count_distinct("key").alias("keys"))
    )


def by_topic(lake):
    to_metrics, to_events = store.route_by_topic(_read_log(lake, _full_log(lake)))

    def counted(rows, name):
        return rows.agg(F.count("*").alias("messages")).select(F.lit(name).alias("table_name"), "messages")

    return union_all(counted(to_metrics, "metrics"), counted(to_events, "events"))


def dead_letters(lake):
    _, dead = store.dlq_split(_read_log(lake, _log(lake, _event_messages(lake), _poison(lake))))
    fields = F.from_json("value", "sourceTopic STRING, error STRING, original STRING")
    return dead.withColumn("v", fields).select(
        "topic", "key", F.col("v.sourceTopic").alias("source_topic"), "v.error", "v.original"
    )


def streamed_ingest(lake):
    bodies = lake.scratch("requests")
    for name, requests in (("metrics", lake.metric_requests()), ("logs", lake.log_requests())):
        requests.select("value").write.option("compression", "zstd").parquet(f"{bodies}/{name}")
    out = lake.scratch("published")

    def stream(name):
        return lake.spark.readStream.schema("value STRING").parquet(f"{bodies}/{name}")

    queries = [
        ingest.publish_stream(
            ingest.stream_metrics(stream("metrics"), PEPPER), f"{out}/metrics", lake.scratch("offsets")
        ),
        ingest.publish_stream(ingest.stream_events(stream("logs"), PEPPER), f"{out}/events", lake.scratch("offsets")),
    ]
    for query in queries:
        _finish(query)
    both = lake.spark.read.schema(ingest.MESSAGE).parquet(f"{out}/metrics", f"{out}/events")
    identifier = F.get_json_object("value", "$.dedup_id")
    return both.groupBy("topic").agg(F.count("*").alias("messages"), F.count_distinct(identifier).alias("ids"))


def _paths(lake) -> store.StorePaths:
    return store.StorePaths(lake.scratch("bronze-metrics"), lake.scratch("bronze-events"), lake.scratch("dead"))


def _store(lake, log: str, paths: store.StorePaths, checkpoint: str) -> None:
    _finish(store.store_stream(ingest.canonical_source(lake.spark, log), paths, checkpoint))


def streamed_store(lake):
    paths = _paths(lake)
    _store(lake, _full_log(lake), paths, lake.scratch("offsets"))

    def daily(path, name):
        rows = lake.spark.read.parquet(path)
        return rows.groupBy(F.lit(name).alias("table_name"), _day()).agg(F.count("*").alias("rows"))

    dead = lake.spark.read.schema(ingest.MESSAGE).parquet(paths.dead_letters)
    letters = dead.agg(F.count("*").alias("rows")).select(
        F.lit("dead_letters").alias("table_name"), F.lit("").alias("day"), "rows"
    )
    return union_all(daily(paths.metrics, "metrics"), daily(paths.events, "events"), letters)


def redelivered(lake):
    """The same batch stored twice, as after a crash between insert and commit."""
    paths = _paths(lake)
    messages = _read_log(lake, _full_log(lake))
    store.store_batch(messages, paths)
    store.store_batch(messages, paths)

    def counted(path, name, replaced_by):
        bronze = lake.spark.read.parquet(path)
        silver = replaced_by(bronze).agg(F.count("*").alias("silver_rows"))
        both = union_all(
            bronze.agg(F.count("*").alias("bronze_rows"), F.lit(None).cast("bigint").alias("silver_rows")),
            silver.select(F.lit(None).cast("bigint").alias("bronze_rows"), "silver_rows"),
        )
        return both.agg(F.max("bronze_rows").alias("bronze_rows"), F.max("silver_rows").alias("silver_rows")).select(
            F.lit(name).alias("table_name"), "bronze_rows", "silver_rows"
        )

    return union_all(
        counted(paths.metrics, "metrics", replace.replace_metrics),
        counted(paths.events, "events", replace.replace_events),
    )


def replayed(lake):
    """A log that holds every event twice: bronze keeps both, silver one."""
    paths = _paths(lake)
    once = _event_messages(lake)
    log = _log(lake, once, once)
    _store(lake, log, paths, lake.scratch("offsets"))
    bronze = lake.spark.read.parquet(paths.events)
    silver = replace.replace_events(bronze)
    twice = union_all(bronze.select(F.lit(1).alias("b"), F.lit(0).alias("s")), silver.select(F.lit(0), F.lit(1)).toDF("b", "s"))
    return twice.agg(F.sum("b").alias("bronze_rows"), F.sum("s").alias("silver_rows"))


def stored_once(lake):
    """Batches that stop after each of their writes, are repeated, and come once more: bronze equals the messages."""
    paths = _paths(lake)
    messages = _read_log(lake, _full_log(lake))
    part = F.pmod(F.xxhash64("key"), F.lit(4))

    def stop_at(name):
        def step(reached):
            if reached == name:
                raise InterruptedError(name)

        return step

    for batch, stop in enumerate(("dead letters", "metrics", "events", "")):
        rows = messages.where(part == batch)
        try:
            store.store_batch(rows, paths, batch=batch, step=stop_at(stop))
        except InterruptedError:
            store.store_batch(rows, paths, batch=batch)
        store.store_batch(rows, paths, batch=batch)

    def counted(rows, name):
        return rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")

    return union_all(
        counted(lake.spark.read.parquet(paths.metrics), "metrics"),
        counted(lake.spark.read.parquet(paths.events), "events"),
        counted(lake.spark.read.parquet(paths.dead_letters), "dead_letters"),
    )


def silver_refreshed(lake):
    """All four tables kept up to date by changed days and changed accounts, with late data in a second round.

    One row per table and day (dimensions: organization) with the number of rows and the sum of a column.
    """
    paths, log, checkpoint = _paths(lake), lake.scratch("log"), lake.scratch("offsets")
    silver = lake.scratch("silver-m"), lake.scratch("silver-e")
    events = _event_messages(lake)
    messages = _read_log(lake, _log(lake, _metric_messages(lake), events, events))
    late = F.pmod(F.xxhash64("value"), F.lit(5)) == 0
    for rows in (messages.where(~late), messages.where(late)):
        _deliver(rows, log)
        _store(lake, log, paths, checkpoint)
        store.refresh_silver(lake.spark, paths, *silver)

    def daily(name, path, value):
        rows = lake.spark.read.parquet(path)
        return rows.groupBy(F.lit(name).alias("table_name"), _day().alias("part")).agg(
            F.count("*").alias("rows"), zero(F.sum(value)).alias("total")
        )

    def by_org(name, rows, value):
        return rows.groupBy(F.lit(name).alias("table_name"), F.col("org_id").alias("part")).agg(
            F.count("*").alias("rows"), F.sum(value.cast("double")).alias("total")
        )

    teams = F.coalesce(F.substring_index("team", "-", -1).try_cast("int"), F.lit(0))
    mail = F.regexp_extract("email", r"^user(\d+)@", 1)
    return union_all(
        daily("metrics", silver[0], F.col("value")),
        daily("events", silver[1], F.col("num_cost_usd")),
        by_org("team_membership", lake.current_membership(), teams),
        by_org("person_directory", lake.current_directory(), mail),
    )


def compacted(lake):
    """Events stored in six small batches, then merged: rows per day, and whether each day has one file."""
    paths = _paths(lake)
    messages = _read_log(lake, _log(lake, _event_messages(lake)))
    for batch in range(6):
        store.store_batch(messages.where(F.pmod(F.xxhash64("value"), F.lit(6)) == batch), paths, batch=batch)
    folders.compact(lake.spark, paths.events, EVENTS, tables.BRONZE_EVENT_SORT, 1 << 40)
    rows = lake.spark.read.parquet(paths.events).withColumn("_file", F.col("_metadata.file_name"))
    return rows.groupBy(_day()).agg(F.count("*").alias("rows"), (F.count_distinct("_file") == 1).alias("merged"))


def late(lake):
    """The newer half arrives and is stored first; the older half still reaches its own days."""
    paths, checkpoint, log = _paths(lake), lake.scratch("offsets"), lake.scratch("log")
    messages = _read_log(lake, _log(lake, _event_messages(lake)))
    day = F.get_json_object("value", "$.ts_ns").cast("bigint")
    middle = 1_705_363_200_000_000_000  # 2024-01-16
    for half in (day >= middle, day < middle):
        _deliver(messages.where(half), log)
        _store(lake, log, paths, checkpoint)
    return lake.spark.read.parquet(paths.events).groupBy(_day()).agg(F.count("*").alias("rows"))


# --- redaction ------------------------------------------------------------------


def _scanned(function) -> Callable[[Lake], DataFrame]:
    def run(lake):
        docs = testdata.planted_documents(lake.spark, lake.sf_dir).withColumn("x", function(F.col("text")))
        return docs.select("doc_id", F.md5("x").alias("digest"), (F.col("x") != F.col("text")).alias("fired"))

    return run


def _document_events(lake) -> DataFrame:
    """Each document as an event: its text as a dimension and, for even ids, as staged content."""
    docs = testdata.planted_documents(lake.spark, lake.sf_dir)
    staged = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("prompt"), F.col("text")))
    return docs.select(
        "doc_id",
        "org_id",
        F.create_map(F.lit("note"), F.col("text")).alias("dims"),
        F.coalesce(staged, F.create_map().cast("map<string,string>")).alias("staged_content"),
    )


def fields_redacted(lake):
    redacted = redact.redact_fields(_document_events(lake), POLICIES)
    return redacted.select(
        "doc_id",
        F.md5(entry(F.col("dims"), "note")).alias("note"),
        text(F.md5(entry(F.col("staged_content"), "prompt"))).alias("prompt"),
        F.array_join("redaction_flags", ",").alias("flags"),
    )


def _redacted(lake) -> DataFrame:
    return redact.redact_events(_document_events(lake), POLICIES, MASTER_KEY)


def flags(lake):
    return _redacted(lake).groupBy(F.array_join("redaction_flags", ",").alias("flags")).agg(
        F.count("*").alias("events")
    )


def policies(lake):
    redacted = POLICIES.attach(redact.redact_fields(_document_events(lake), POLICIES))
    return redacted.groupBy("org_id", F.col("_policy.captures").alias("captures")).agg(
        F.count_if(F.array_contains("redaction_flags", fx.FLAG_DENY)).alias("denied"), F.count("*").alias("events")
    )


def policy_applied(lake):
    return _redacted(lake).select(
        "doc_id",
        F.array_join("redaction_flags", ",").alias("flags"),
        "content_class",
        "content_keyid",
        F.size("content_fields").alias("fields"),
    )


def encrypted(lake):
    sealed = _redacted(lake).where("content_class <> ''")
    return sealed.select(
        "doc_id", F.octet_length(F.unbase64(entry(F.col("content_fields"), "prompt"))).alias("sealed_bytes")
    )


def decrypted(lake):
    keys = POLICIES.key_frame(lake.spark, MASTER_KEY, "content")
    opened = _redacted(lake).where("content_class <> ''").join(keys, "org_id")
    plain = decrypt_content(entry(F.col("content_fields"), "prompt"), F.col("_key"))
    return opened.select("doc_id", F.md5(plain).alias("digest"))


def field_policies(lake):
    keys = _records(lake).select(F.explode(F.map_keys("attributes")).alias("field"))
    table = F.broadcast(redact.field_policy_frame(lake.spark))  # a fixed handful of rows
    counted = keys.join(table, "field").groupBy("field", "class", "action", "critical")
    return counted.agg(F.count("*").alias("records"))


# --- dimensions and merges ------------------------------------------------------


def upserted(lake):
    return dimensions.directory_upsert(lake.directory()).select(
        "org_id", "account_hash", "person_id", "display_name", "email"
    )


def resolved(lake):
    hashes = _m(lake).select(F.col("user_hash").alias("account_hash"))
    return dimensions.directory_resolve(dimensions.directory_upsert(lake.directory()), oracle.ORG, hashes)


def assigned(lake):
    history = lake.membership()
    moved = history.where((F.col("org_id") == oracle.ORG) & (F.col("team") == "team-1"))
    records = moved.select("org_id", "account_hash", F.lit(given.ASSIGNED_TEAM).alias("team"))
    return dimensions.membership_list(dimensions.membership_assign(history, records, INGEST_TIME), oracle.ORG)


def listed(lake):
    return dimensions.membership_list(lake.membership(), oracle.ORG)


def _per_user(rows, name):
    return rows.groupBy("user_hash").agg(F.count("*").alias(name))


def joined_teams(lake):
    cost = _m(lake).where("name = 'cost.usage'").groupBy("user_hash").agg(zero(F.sum("value")).alias("cost"))
    return team_join(cost, listed(lake)).select("user_hash", "team", "cost")


def merged_full(lake):
    return merge_full_outer(
        _per_user(_m(lake), "points"), _per_user(_e(lake), "events"), "user_hash", {"points": 0, "events": 0}
    )


def merged_left(lake):
    return merge_left(_per_user(_e(lake), "events"), _per_user(_m(lake), "points"), "user_hash", {"points": 0})


def stacked(lake):
    both = union_all(_per_user(_m(lake), "n"), _per_user(_e(lake), "n"))
    return both.groupBy("user_hash").agg(F.sum("n").alias("rows"))


PIPELINE: dict[str, Callable[[Lake], DataFrame]] = {
    "read_otlp_metrics": read_metrics,
    "read_otlp_logs": read_logs,
    "flatten_anyvalue": anyvalue,
    "parse_ns": ns,
    "reject_malformed": malformed,
    "canonical_source": source_read,
    "route_by_topic": by_topic,
    "dlq_split": dead_letters,
    "at_least_once_sink": redelivered,
    "metrics_sink": metrics_written,
    "events_sink": events_written,
    "metric_to_row": metric_rows,
    "event_to_row": event_rows,
    "table_defaults": defaults,
    "replace_by_key": replaced,
    "retention_rows": retained_rows,
    "retention_content": retained_content,
    "schema_evolve": evolved,
    "directory_load": loaded_directory,
    "route_source": routed,
    "merge_context": context,
    "resource_long_tail": long_tail,
    "adapt_metric": metric_known,
    "adapt_metric_default": metric_unknown,
    "adapt_event": event_adapted,
    "skipped_records": lambda lake: adapt.skipped_records(_records(lake)),
    "event_taxonomy": taxonomy,
    "split_mcp_tool": mcp_split,
    "pseudonymize": pseudonyms,
    "identity_resolution": identities,
    "metric_dedup_id": lambda lake: _metrics(lake).select("ok", "pk", "ts_ns", "dedup_id"),
    "event_dedup_id": lambda lake: _events(lake).select("i", "dedup_id"),
    "partition_key": partition_keys,
    "scan_secrets": _scanned(scan.scan_secrets),
    "scan_pii": _scanned(scan.scan_pii),
    "scan_paths": _scanned(scan.scan_paths),
    "scan_deny_list": _scanned(lambda x: scan.scan_deny_list(x, given.DENY)),
    "redact_fields": fields_redacted,
    "redaction_flags": flags,
    "org_policy": policies,
    "field_policy": policy_applied,
    "encrypt_content": encrypted,
    "decrypt_content": decrypted,
    "field_policy_table": field_policies,
    "directory_upsert": upserted,
    "directory_resolve": resolved,
    "membership_assign": assigned,
    "membership_list": listed,
    "team_join": joined_teams,
    "merge_full_outer": merged_full,
    "merge_left": merged_left,
    "union_all": stacked,
    "stream_ingest": streamed_ingest,
    "stream_store": streamed_store,
    "stream_replay": replayed,
    "late_data": late,
    "batch_log": stored_once,
    "silver_refresh": silver_refreshed,
    "compact_days": compacted,
    "cumulative_to_delta": delta,
    "optional_cumulative": carried_delta,
}
