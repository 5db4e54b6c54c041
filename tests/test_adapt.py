import json

from pyspark.sql import functions as F

from usagelake.functions.text import ns_text, parse_ns
from usagelake.operators import adapt
from usagelake.sources.otlp import read_otlp_logs, read_otlp_metrics, reject_malformed
from usagelake.sources.tables import metric_to_row
from usagelake.streaming.ingest import event_rows, metric_rows

PEPPER = "test-pepper"


def kv(**pairs):
    return [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in pairs.items()]


def metrics_body(points, resource=None, scope="meter", name="claude_code.token.usage", kind="sum"):
    return json.dumps(
        {
            "resourceMetrics": [
                {
                    "resource": {"attributes": resource or kv(service__name="claude-code", organization__id="o")},
                    "scopeMetrics": [
                        {"scope": {"name": scope}, "metrics": [{"name": name, "unit": "", kind: {"dataPoints": points}}]}
                    ],
                }
            ]
        }
    )


def logs_body(attributes, service="claude-code", **record):
    return json.dumps(
        {
            "resourceLogs": [
                {
                    "resource": {"attributes": kv(service__name=service, organization__id="o")},
                    "scopeLogs": [{"logRecords": [{"attributes": attributes, **record}]}],
                }
            ]
        }
    )


def frame(spark, *bodies):
    return spark.createDataFrame([(b,) for b in bodies], "value STRING")


def test_point_values_kinds_and_times(spark):
    points = [
        {"asInt": "5", "timeUnixNano": "1751812607123456789"},
        {"asInt": 7, "startTimeUnixNano": "9"},
        {"asDouble": 0.0123, "asInt": "3", "timeUnixNano": "abc"},
        {},
    ]
    rows = read_otlp_metrics(frame(spark, metrics_body(points))).collect()
    assert [(r.value, r.ts_ns, r.kind, r.unit) for r in rows] == [
        (5.0, 1751812607123456789, "counter", None),
        (7.0, 9, "counter", None),
        (0.0123, 0, "counter", None),
        (0.0, 0, "counter", None),
    ]
    gauge = read_otlp_metrics(frame(spark, metrics_body([{"asInt": 1}], kind="gauge"))).first()
    assert gauge.kind == "gauge"


def test_other_point_kinds_and_unnamed_metrics_yield_nothing(spark):
    bodies = frame(
        spark, metrics_body([{"asInt": 1}], kind="histogram"), metrics_body([{"asInt": 1}], name=""), "{}", "[]"
    )
    assert read_otlp_metrics(bodies).count() == 0


def test_only_non_objects_are_rejected(spark):
    bodies = ["{}", "[]", "5", '"x"', "null", "{broken", "", metrics_body([{"asInt": 1}])]
    rejected = reject_malformed(frame(spark, *bodies)).select("rejected").collect()
    assert [r[0] for r in rejected] == [False, False, True, True, True, True, True, False]


def test_parse_ns_and_text(spark):
    texts = ["1751812607123456789", "x", None, "1.5", " 7 "]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select(parse_ns(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [1751812607123456789, 0, 0, 0, 7]
    assert df.select(ns_text(F.col("n"))).first()[0] == "2025-07-06 14:36:47.123456789"


def test_routing(spark):
    cases = [("claude-code", None, "claude_code"), ("mystery-tool", None, "unknown"), (None, "x.Claude_Code.y", "claude_code")]
    df = spark.createDataFrame([c[:2] for c in cases], "service STRING, scope STRING")
    got = df.select(adapt.route_source(F.col("service"), F.col("scope"))).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]


def test_second_adapter_needs_no_second_scan(spark):
    other = adapt.SourceAdapter("other_tool", ("other",), prefix="oth.", promoted={"m": "model"})
    body = metrics_body([{"asInt": 1, "attributes": kv(m="x", model="y")}], kv(service__name="other"), name="oth.a.b")
    row = adapt.adapt_metrics(read_otlp_metrics(frame(spark, body)), PEPPER, (adapt.CLI_ADAPTER, other)).first()
    assert (row.source, row.name, row.model, row.attributes) == ("other_tool", "a.b", "x", {"model": "y"})


def test_mcp_split(spark):
    cases = {
        "mcp__github__search_issues": ("github", "search_issues"),
        "mcp__a__b__c": ("a", "b__c"),
        "mcp__x": (None, None),
        "Bash": (None, None),
        "mcp____x__y": (None, None),
    }
    df = spark.createDataFrame([(c,) for c in cases], "t STRING")
    got = df.select(*adapt.split_mcp_tool(F.col("t"))).collect()
    assert [tuple(r) for r in got] == list(cases.values())


def test_numbers_and_dims(spark):
    attributes = kv(event__name="claude_code.tool_result", a="12", b="-1.5", c="1.", d="12\n", e="1e3", f="", prompt="p")
    row = adapt.adapt_events(read_otlp_logs(frame(spark, logs_body(attributes))), PEPPER).first()
    assert row.numbers == {"a": 12.0, "b": -1.5}
    assert row.dims == {"c": "1.", "d": "12\n", "e": "1e3", "f": ""}
    assert row.staged_content == {"prompt": "p"}


def test_unknown_event_names_are_kept(spark):
    row = adapt.adapt_events(read_otlp_logs(frame(spark, logs_body(kv(name="claude_code.new")))), PEPPER).first()
    assert (row.event_type, row.dims) == ("unknown", {"event.name": "claude_code.new"})


def test_records_of_unknown_sources_are_skipped_and_counted(spark):
    records = read_otlp_logs(frame(spark, logs_body(kv(name="x"), service="other")))
    assert adapt.adapt_events(records, PEPPER).count() == 0
    assert [tuple(r) for r in adapt.skipped_records(records).collect()] == [("other", 1)]


def test_identity_is_hashed_and_never_stored(spark):
    secrets = {
        "user__account_uuid": "acct-uuid-999", "user__id": "device-123", "user__email": "ada@acme.com",
        "session__id": "sess-1",
    }
    points = [{"asInt": 1, "attributes": kv(model="m", **secrets)}]
    row = adapt.adapt_metrics(read_otlp_metrics(frame(spark, metrics_body(points))), PEPPER).first()
    assert row.account_hash == "7Yh2Oy2BWa_Dv3Vtx3g_CuFvSdD"
    assert row.email_hash is None
    stored = str(metric_rows(frame(spark, metrics_body(points)), PEPPER).collect())
    stored += str(event_rows(frame(spark, logs_body(kv(name="x", **secrets))), PEPPER).collect())
    for raw in ("acct-uuid-999", "device-123", "ada@acme.com"):
        assert raw not in stored


def test_email_is_a_fallback(spark):
    points = [{"asInt": 1, "attributes": kv(user__email="a@b.co")}]
    row = adapt.adapt_metrics(read_otlp_metrics(frame(spark, metrics_body(points))), PEPPER).first()
    assert row.account_hash is None and row.email_hash and row.user_id_hash


def test_rows_use_empty_strings_for_missing(spark):
    row = metric_to_row(
        adapt.enrich_metrics(adapt.adapt_metrics(read_otlp_metrics(frame(spark, metrics_body([{"asInt": 1}]))), PEPPER))
    ).first()
    assert None not in row
    event = event_rows(frame(spark, logs_body(kv(name="x", status_code="429"))), PEPPER).first()
    assert None not in event and event.status_code == "" and event.numbers == {"status_code": 429.0}
