"""What ingestion has Spark interpret row by row, and how its work is shared by tasks."""

import json
from glob import glob
from urllib.parse import urlparse

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from checks import ingest_queries as q
from tests.test_plans import plan
from usagelake.functions import redaction as scan
from usagelake.operators.redact import OrgPolicies, redact_fields
from usagelake.schemas import ATTRIBUTES, METRIC_COLUMNS, METRICS
from usagelake.sources import tables, testdata
from usagelake.sources.otlp import flatten_anyvalue


def test_requests_are_written_without_lambdas(spark, sf_dir):
    for requests in (testdata.metric_requests(spark, sf_dir), testdata.log_requests(spark, sf_dir)):
        assert "lambda" not in plan(requests, "simple")
        assert all(json.loads(r.value) for r in requests.limit(50).collect())


def test_points_are_exploded_in_generated_code(lake):
    lines = [line for line in plan(q._points(lake), "simple").splitlines() if "Generate explode" in line]
    assert lines and all("*(" in line and "lambda" not in line for line in lines)


def test_plain_and_other_lists_flatten_alike(spark):
    def member(key, **value):
        return {"key": key, "value": value}

    cases = [
        ([member("a", stringValue="x"), member("b", stringValue="")], {"a": "x", "b": ""}),
        ([member("a", stringValue="x"), member("a", stringValue="y")], {"a": "y"}),
        ([member("a", stringValue="x"), member("", stringValue="y")], {"a": "x"}),
        ([member("a", stringValue="x"), member("b")], {"a": "x"}),
        ([member("a", stringValue="x"), {"key": "b"}], {"a": "x"}),
        ([{"value": {"stringValue": "x"}}, member("b", stringValue="y")], {"b": "y"}),
        ([member("a", stringValue="\0")], {"a": "\0"}),
        ([member("a", stringValue="x"), member("b", doubleValue=12.0), member("c", intValue="7")], {"a": "x", "b": "12", "c": "7"}),
        ([member("a", doubleValue=0.0000001), member("b", doubleValue="z")], {"a": "1e-7", "b": "z"}),
        ([], {}),
    ]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i INT, v STRING")
    flat = rows.select("i", flatten_anyvalue(F.from_json("v", ATTRIBUTES)).alias("f"))
    text = plan(flat, "simple")
    assert "map_from_arrays" in text
    assert {r.i: r.f for r in flat.collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_scanners_run_for_texts_with_a_hint(spark):
    found = ["-----BEGIN X", "eyJ", "sk-", "ghp_", "gho_", "ghs_", "ghu_", "AKIA", "xox", "@", "1.2", "/home/a", "/Users/a", "a\\b"]
    clean = ["", "plain words", "12", "1\n.\n2", "Bash"]
    rows = spark.createDataFrame([(t,) for t in [*found, *clean]], "t STRING")
    assert {r.t: r.f for r in rows.select("t", scan.may_find(F.col("t")).alias("f")).collect()} == dict.fromkeys(found, True) | dict.fromkeys(clean, False)


def test_events_without_a_hint_keep_their_texts(spark):
    events = [
        (1, "o", {"a": "plain", "b": "x"}, {}),
        (2, "o", {"a": "mail x@example.com"}, {"prompt": "see /home/someone/src"}),
        (3, "o", {"a": "plain"}, {"prompt": "key sk-abcdefghijklmnop1234"}),
        (4, "d", {"a": "plain"}, {}),
        (5, "o", None, {"prompt": "x"}),
    ]
    rows = spark.createDataFrame(events, "i INT, org_id STRING, dims MAP<STRING,STRING>, staged_content MAP<STRING,STRING>")
    got = {r.i: (r.dims, r.redaction_flags) for r in redact_fields(rows, OrgPolicies(deny_by_org={"d": ("plain",)})).collect()}
    assert got[1] == ({"a": "plain", "b": "x"}, [])
    assert got[2][0] != events[1][2] and len(got[2][1]) == 2
    assert got[3][0] == {"a": "plain"} and len(got[3][1]) == 1
    assert got[4][0] != {"a": "plain"} and len(got[4][1]) == 1
    assert got[5][0] is None
    shared = {r.i: r.redaction_flags for r in redact_fields(rows, OrgPolicies(deny_list=("plain",))).collect()}
    assert len(shared[1]) == len(shared[4]) == 1


def test_a_log_file_is_read_by_several_tasks(lake):
    texts = F.concat(*[F.sha2(F.concat(F.col("id"), F.lit(f"-{k}")), 256) for k in range(10)])
    log = q._log(lake, lake.spark.range(0, 120_000, 1, 1).select(F.lit("t").alias("topic"), F.lit("k").alias("key"), texts.alias("value")))
    assert len(glob(f"{urlparse(log).path}/part-*.parquet")) == 1
    tasks = q._read_log(lake, log).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 120_000


def test_ids_are_stored_without_a_dictionary(spark, tmp_path):
    types = dict(c.strip().split(" ", 1) for c in METRICS.replace("\n", " ").split(",") if " " in c.strip() and "<" not in c)
    rows = spark.range(0, 1000, 1, 1).select(
        *[(F.expr("DATE'2024-01-01'") if c == "event_date" else (F.col("id") % 5).cast("string") if c in ("dedup_id", "name") else F.lit(None).cast(types.get(c, "string"))).alias(c) for c in METRIC_COLUMNS]
    )
    tables.append_rows(rows, str(tmp_path / "t"), METRIC_COLUMNS)
    (file,) = glob(f"{tmp_path}/t/*/*.parquet")
    group = pq.ParquetFile(file).metadata.row_group(0)
    encodings = {group.column(k).path_in_schema: group.column(k).encodings for k in range(group.num_columns)}
    assert any("DICTIONARY" in e for e in encodings["name"]) and not any("DICTIONARY" in e for e in encodings["dedup_id"])
