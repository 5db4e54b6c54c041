"""Shape of the plans that matter at scale."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from checks.registry import ANALYTICS, comparable
from usagelake.operators.quantile import exact_quantiles
from usagelake.operators.relational import scope
from usagelake.plans import overview, tools
from usagelake.session import work_dir


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def scoped(lake):
    return (
        scope(lake.metrics(), "org_1", "2024-01-05", "2024-01-25"),
        scope(lake.events(), "org_1", "2024-01-05", "2024-01-25"),
    )


def test_cost_by_model_prunes_days_rows_and_columns(scoped):
    text = plan(overview.cost_by_model(scoped[0]))
    assert re.search(r"PartitionFilters: .*event_date.*2024-01-05", text)
    assert "EqualTo(org_id,org_1)" in text and "EqualTo(name,cost.usage)" in text
    assert re.search(r"ReadSchema: struct<name:string,value:double,org_id:string,model:string>", text)


def test_tools_read_flat_columns_instead_of_maps(scoped):
    text = plan(tools.tools_list(scoped[1]))
    schemas = re.findall(r"ReadSchema: (.*)", text)
    assert schemas and not any("map<" in s for s in schemas)


def test_one_tool_is_filtered_in_the_scan(scoped):
    assert "EqualTo(dim_tool_name,Edit)" in plan(tools.tool_uses_by_day(scoped[1], "Edit"))


def test_quantiles_shuffle_counts_and_not_single_values(spark, scoped):
    """Near-unique doubles: what the shuffles carry is counts of slices and parts, and the values of one part."""
    path = work_dir(spark) + "/near-unique-" + uuid.uuid4().hex
    spark.range(400_000).select((F.col("id") % 3).alias("k"), (1000 + F.rand(1) * 9000).alias("v")).write.parquet(path)
    df = spark.read.parquet(path)
    for keys, most in (([], None), (["k"], 3)):
        found = exact_quantiles(df, keys, "v", {"p50": 0.5, "p95": 0.95}, most)
        got = sorted(tuple(r) for r in found.collect())
        want = df.groupBy(*keys).agg(F.percentile("v", 0.5), F.percentile("v", 0.95)).collect()
        for g, w in zip(got, sorted(tuple(r) for r in want), strict=True):
            assert g == pytest.approx(w, rel=1e-12)
        written = [int(m.replace(",", "")) for m in re.findall(r"shuffle records written: ([\d,]+)", metrics(found))]
        assert written and sum(written) < 60_000
    assert "ReadSchema: struct<event_type:string,org_id:string,dim_tool_name:string,num_duration_ms:double>" in plan(tools.tool_latency(scoped[1], "Edit"))


def metrics(df) -> str:
    """Names and values of all metrics of an executed plan."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "ShuffleExchangeExec":
            out.append(f"shuffle records written: {node.metrics().apply('shuffleRecordsWritten').value()}")
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return "\n".join(out)


def test_breakdowns_scan_once_and_shuffle_once(scoped):
    text = plan(overview.metric_breakdowns(scoped[0]), "simple")
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_no_cross_join_and_no_python(lake):
    for name, build in ANALYTICS.items():
        text = plan(comparable(build(lake)), "simple")
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "Python" not in text and "Pandas" not in text, name


def test_pepper_stays_out_of_explain(spark):
    from pyspark.sql import functions as F

    from usagelake.functions.identity import pseudonymize

    text = plan(spark.range(1).select(pseudonymize(F.col("id").cast("string"), "hidden-pepper")), "extended")
    pad = bytes(b ^ 0x36 for b in b"hidden-pepper").hex()
    assert pad.upper() not in text.upper()


def over_facts(text: str) -> list[str]:
    """Sort aggregates of a plan tree whose rows come from a scan without a hash aggregate between."""
    lines = [re.match(r"([\s:+\-|]*)(.*)", line).groups() for line in text.splitlines()]
    bad = []
    for k, (indent, node) in enumerate(lines):
        if "SortAggregate" not in node:
            continue
        reduced = None  # depth of the nearest hash aggregate above the current node
        for below, inner in lines[k + 1 :]:
            if len(below) <= len(indent):
                break
            if reduced is not None and len(below) <= reduced:
                reduced = None
            if "HashAggregate" in inner and reduced is None:
                reduced = len(below)
            if "FileScan" in inner and reduced is None:
                bad.append(node)
    return bad


def test_no_report_sorts_facts_to_aggregate_them(lake):
    for name, build in ANALYTICS.items():
        assert not over_facts(plan(build(lake), "simple")), name


def test_plans_do_not_grow_with_the_number_of_organizations(spark):
    from usagelake.operators import redact

    schema = "org_id STRING, dims MAP<STRING,STRING>, staged_content MAP<STRING,STRING>"
    events = spark.createDataFrame([(f"o{k}", {"a": f"term{k} all x"}, {"p": "text"}) for k in (0, 7, 9_999, 20_000)], schema)

    def redacted(n):
        names = [f"o{k}" for k in range(n)]
        return redact.redact_events(events, redact.OrgPolicies(tuple(names[::2]), ("all",), {o: (f"TERM{o[1:]}",) for o in names}), b"k" * 32)

    sizes = [len(plan(redacted(n), "simple")) for n in (10, 10_000)]
    assert abs(sizes[0] - sizes[1]) < 50
    rows = {r.org_id: r for r in redacted(10_000).collect()}
    mark = "[REDACTED:denylist]"
    assert rows["o7"].dims["a"] == rows["o9999"].dims["a"] == rows["o0"].dims["a"] == f"{mark} {mark} x"
    assert rows["o20000"].dims["a"] == f"term20000 {mark} x"
    assert [bool(rows[o].content_fields) for o in ("o0", "o7", "o9999", "o20000")] == [True, False, False, False]


def test_a_sort_aggregate_over_facts_is_seen(scoped):
    from pyspark.sql import functions as F

    sorted_facts = scoped[1].groupBy("session_id").agg(F.max_by("dim_tool_name", F.struct("ts_ns", "dedup_id")))
    assert over_facts(plan(sorted_facts, "simple"))
    assert not over_facts(plan(scoped[1].groupBy("session_id").agg(F.count("*").alias("n"), F.max("ts_ns").alias("t")).groupBy("n").agg(F.max_by("session_id", "t")), "simple"))
