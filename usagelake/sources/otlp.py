"""OTLP/JSON export requests -> flat data points and log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.maps import entry
from usagelake.functions.text import number_text, parse_ns
from usagelake.schemas import MEMBERS, OTLP_LOGS, OTLP_METRICS

_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


_INNERMOST = r"\[[^\[\]]*+\]"  # a list without lists in it, once brackets inside strings are escaped


def _once(value: Column, f) -> Column:
    """f(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _scalar_text(value: Column) -> Column:
    def double_text(given: Column) -> Column:
        return _once(given.try_cast("double"), lambda x: F.when(x.isNotNull(), number_text(x)).otherwise(given))

    double = value["doubleValue"]
    return F.coalesce(value["stringValue"], value["boolValue"], value["intValue"], F.when(double.isNotNull(), double_text(double)))


def _without_brackets(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("["), F.lit("\\u005b")), F.lit("]"), F.lit("\\u005d"))


def _worked_out(members: Column) -> Column:
    """JSON text of an innermost list -> JSON object with its texts as a list of values and as a key/value list."""

    def text(value: Column) -> Column:
        return F.coalesce(_scalar_text(value), value["arrayValue"]["values"]["list"], value["kvlistValue"]["values"]["fields"])

    parsed = F.from_json(members, MEMBERS)
    keyed = F.filter(parsed, lambda e: (F.length(e["key"]) > 0) & e["value"].isNotNull())
    fields = F.map_from_entries(F.transform(keyed, lambda e: F.struct(e["key"], text(e["value"]))))
    both = F.struct(
        F.to_json(F.transform(parsed, text)).alias("list"),
        F.to_json(F.map_filter(fields, lambda _, v: v.isNotNull())).alias("fields"),
    )
    return F.coalesce(_without_brackets(F.to_json(both)), F.lit("{}"))


def nested_texts(values: Column) -> Column:
    """JSON text of a list of values or of keys with values, nested to any depth -> STRUCT<list, fields> of its texts.

    Inside out: each step of the fold replaces all innermost lists by their texts, as many steps as lists are nested.
    Anything but a list gives NULL.
    """

    def levels(text: Column) -> Column:
        def count(at: Column, bracket: Column) -> Column:
            now = at["now"] + F.when(bracket == "[", 1).when(bracket == "]", -1).otherwise(0)
            return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

        start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
        return F.aggregate(F.split(F.regexp_replace(text, r"[^\[\]]+", ""), ""), start, count, lambda at: at["most"])

    def step(text: Column, _: Column) -> Column:
        lists = F.regexp_extract_all(text, F.lit(_INNERMOST), F.lit(0))
        texts = F.concat(F.transform(lists, _worked_out), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(text, _INNERMOST, -1), texts, lambda piece, t: F.concat(piece, t)), "")

    # no escaped quotes or backslashes: every second part between quotes is a string
    parts = F.split(F.replace(F.replace(values, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022")), '"', -1)
    escaped = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 1, _without_brackets(s)).otherwise(s)), '"')
    done = _once(escaped, lambda text: F.aggregate(F.sequence(F.lit(1), levels(text)), text, step))
    return F.from_json(F.when(values.rlike(r"^\s*\["), done), "STRUCT<list: STRING, fields: STRING>")


def value_text(value: Column) -> Column:
    """Text of an attribute value: string, bool, int, double, array, key/value list, in that order."""
    return F.coalesce(
        _scalar_text(value),
        nested_texts(value["arrayValue"]["values"])["list"],
        nested_texts(value["kvlistValue"]["values"])["fields"],
    )


def flatten_anyvalue(attributes: Column) -> Column:
    """KeyValue[] -> MAP<STRING,STRING>; entries without key or value are dropped, later keys win.

    A list of strings under non-empty keys becomes a map as it is: the functions with a lambda, which Spark interprets
    member by member, run for the other lists only.
    """
    keys, strings = attributes["key"], attributes["value"]["stringValue"]
    # false, and not NULL, only when every member is there; a string that is equal takes the longer way
    plain = ~F.array_contains(keys, "") & ~F.array_contains(strings, "\0")
    texts = F.transform(
        attributes,
        lambda e: F.struct(F.when(F.length(e["key"]) > 0, e["key"]).alias("key"), value_text(e["value"]).alias("value")),
    )
    present = F.map_from_entries(F.filter(texts, lambda e: e["key"].isNotNull() & e["value"].isNotNull()))
    return F.coalesce(F.when(plain, F.map_from_arrays(keys, strings)).otherwise(present), F.create_map().cast("map<string,string>"))


def _parsed(bodies: DataFrame, column: str, schema: str) -> DataFrame:
    return bodies.withColumn("_request", F.from_json(F.col(column), schema, _PERMISSIVE))


def _is_rejected(column: str) -> Column:
    """True for a body that is not a JSON object (a client fault, never retried).

    The second parse runs only for bodies the schema could not hold completely.
    """
    body = F.col(column)
    not_object = ~F.coalesce(body.rlike(r"^\s*[\[{]"), F.lit(False))
    corrupt = F.col("_request._corrupt_record")
    broken = F.when(corrupt.isNotNull(), F.try_parse_json(body).isNull()).otherwise(F.lit(False))
    return not_object | broken


def _accepted(column: str, groups: str) -> Column:
    """The request's groups, NULL for a rejected body.

    A CASE on the parsed column instead of a filter: a filter would be pushed
    below the parse and repeat it.
    """
    return F.when(~_is_rejected(column), F.col(f"_request.{groups}"))


def reject_malformed(bodies: DataFrame, column: str = "value", signal: str = "metrics") -> DataFrame:
    """Bodies with a boolean ``rejected`` column; filter it to split good from rejected."""
    schema = OTLP_METRICS if signal == "metrics" else OTLP_LOGS
    return _parsed(bodies, column, schema).withColumn("rejected", _is_rejected(column)).drop("_request")


def read_otlp_metrics(bodies: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per sum or gauge data point; other point kinds and unnamed metrics yield nothing.

    Narrow all the way (parse, explode, project), so it runs unchanged on a stream.
    ``keep`` names input columns carried along.
    """
    kept = [F.col(c) for c in keep]
    scopes = (
        _parsed(bodies, column, OTLP_METRICS)
        .select(*kept, F.explode(_accepted(column, "resourceMetrics")).alias("rm"))
        .select(*kept, F.col("rm.resource.attributes").alias("resource"), F.explode("rm.scopeMetrics").alias("sm"))
        .select(*kept, "resource", F.col("sm.scope").alias("scope"), F.explode("sm.metrics").alias("m"))
        .where(F.length("m.name") > 0)
    )
    # Two steps without a lambda: Spark reads them in one generated loop.
    kinds = [F.struct(F.lit(kind).alias("kind"), F.col(f"m.{part}.dataPoints").alias("points")) for kind, part in (("counter", "sum"), ("gauge", "gauge"))]
    points = scopes.select(*kept, "resource", "scope", "m.name", "m.unit", F.explode(F.array(*kinds)).alias("of")).select(
        *kept, "resource", "scope", "name", "unit", "of.kind", F.explode("of.points").alias("dp")
    )
    value = F.coalesce(
        F.col("dp.asDouble").try_cast("double"),
        F.when(
            F.col("dp.asInt").isNotNull(),
            F.coalesce(F.col("dp.asInt").try_cast("double"), F.lit(float("nan"))),
        ),
        F.lit(0.0),
    )
    return points.select(
        *kept,
        flatten_anyvalue(F.col("resource")).alias("resource_attributes"),
        F.col("scope.name").alias("scope_name"),
        F.col("scope.version").alias("scope_version"),
        "name",
        F.when(F.length("unit") > 0, F.col("unit")).alias("unit"),
        "kind",
        value.alias("value"),
        parse_ns(F.coalesce("dp.timeUnixNano", "dp.startTimeUnixNano")).alias("ts_ns"),
        flatten_anyvalue(F.col("dp.attributes")).alias("attributes"),
    )


def read_otlp_logs(bodies: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per log record, with the event name taken from its attributes."""
    kept = [F.col(c) for c in keep]
    records = (
        _parsed(bodies, column, OTLP_LOGS)
        .select(*kept, F.explode(_accepted(column, "resourceLogs")).alias("rl"))
        .select(*kept, F.col("rl.resource.attributes").alias("resource"), F.explode("rl.scopeLogs").alias("sl"))
        .select(*kept, "resource", F.col("sl.scope").alias("scope"), F.explode("sl.logRecords").alias("lr"))
        .select(
            *kept,
            flatten_anyvalue(F.col("resource")).alias("resource_attributes"),
            F.col("scope.name").alias("scope_name"),
            F.col("scope.version").alias("scope_version"),
            parse_ns(F.coalesce("lr.timeUnixNano", "lr.observedTimeUnixNano")).alias("ts_ns"),
            F.col("lr.severityNumber").try_cast("int").alias("severity"),
            F.col("lr.body.stringValue").alias("body"),
            flatten_anyvalue(F.col("lr.attributes")).alias("attributes"),
        )
    )
    name = F.coalesce(entry(F.col("attributes"), "event.name"), entry(F.col("attributes"), "name"))
    return records.withColumn("event_name", name)
