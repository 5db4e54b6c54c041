import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.registry import comparable
from usagelake import fixed_values as fx
from usagelake.operators import dimensions
from usagelake.operators.counters import cumulative_to_delta
from usagelake.operators.quantile import exact_quantiles
from usagelake.operators.relational import scope
from usagelake.operators.replace import replace_by_key, replace_metrics, retention_rows, schema_evolve
from usagelake.plans import capabilities, derived, health, overview, people, teams, tools
from usagelake.plans.repository import Analytics, DateRange
from usagelake.session import work_dir
from usagelake.sources import tables
from usagelake.sources.testdata import directory_files
from usagelake.streaming import ingest, store

VALUES = st.one_of(
    st.floats(min_value=-1e9, max_value=1e9, allow_nan=False), st.integers(-50, 50).map(float), st.just(0.0)
)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), VALUES), min_size=1, max_size=120), st.sampled_from([0.0, 0.5, 0.95, 1.0]))
def test_quantiles_equal_numpy(spark, rows, p):
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", {"q": p}).collect()}
    for group in {g for g, _ in rows}:
        want = np.quantile([v for g, v in rows if g == group], p)
        assert got[group] == pytest.approx(want, rel=1e-9, abs=1e-9)
    everything = exact_quantiles(df, [], "v", {"q": p}).first().q
    assert everything == pytest.approx(np.quantile([v for _, v in rows], p), rel=1e-9, abs=1e-9)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([("a", None)], "g STRING, v DOUBLE")
    assert exact_quantiles(empty, ["g"], "v", {"q": 0.5}).count() == 0
    assert exact_quantiles(empty, [], "v", {"q": 0.5}).count() == 0


def test_one_value_holding_most_rows(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    values = [7.0 if i % 3 == 0 else float(i) for i in range(100_000)]
    got = exact_quantiles(df, [], "v", {"a": 0.1, "b": 0.5, "c": 0.95}).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.95])))


def test_newest_version_wins_before_filters(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key STRING, v INT, model STRING")
    assert replace_by_key(rows, ["key"], "v").where("model = 'old'").count() == 0


def test_hot_key_is_cut_before_the_shuffle(spark):
    rows = spark.range(10).select((F.col("id") % 2).alias("key"), F.col("id").alias("v"))
    plan = replace_by_key(rows, ["key"], "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_replays_change_nothing(lake):
    bronze = lake.bronze_metrics()
    once = replace_metrics(bronze).drop("attributes")
    again = replace_metrics(bronze.unionByName(bronze)).drop("attributes")
    assert once.exceptAll(again).count() == again.exceptAll(once).count() == 0


def test_retention_and_layout(spark):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "d STRING").select(F.to_date("d").alias("event_date"))
    assert retention_rows(days, "2024-03-31", 90).count() == 1
    old = spark.createDataFrame([("input",)], "token_type STRING")
    assert schema_evolve(old).first().asDict() == {"subtype": "input", "start_type": ""}


def test_refresh_rewrites_only_touched_days(lake, spark):
    path = lake.scratch("refresh")
    bronze = lake.bronze_metrics()
    tables.write_silver(tables.silver_metrics(bronze), path, tables.METRIC_SORT)
    before = spark.read.parquet(path).groupBy("event_date").count().collect()
    changed = bronze.withColumn("region", F.lit("moved"))
    tables.refresh_days(changed, path, "metrics", "2024-01-03", "2024-01-04")
    after = spark.read.parquet(path)
    assert sorted(after.groupBy("event_date").count().collect()) == sorted(before)
    moved = {str(r[0]) for r in after.where("region = 'moved'").select("event_date").distinct().collect()}
    assert moved == {"2024-01-03", "2024-01-04"}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.integers(0, 20).map(float)), min_size=1, max_size=60))
def test_deltas_equal_a_loop(spark, rows):
    hour = 3_600_000_000_000
    data = [(s, t * hour // 2, v) for s, t, v in rows]
    df = spark.createDataFrame(data, "s STRING, ts_ns BIGINT, value DOUBLE")
    got = sorted((r.s, r.ts_ns, r.value, r.delta) for r in cumulative_to_delta(df, ["s"]).collect())
    want, last = [], {}
    for s, t, v in sorted(data):
        before = last.get(s)
        want.append((s, t, v, v if before is None or v < before else v - before))
        last[s] = v
    assert got == sorted(want)


DIRECTORY = "org_id STRING, account_hash STRING, person_id STRING, display_name STRING, email STRING, external_id STRING, updated_at TIMESTAMP"


def directory(spark, *rows):
    from datetime import datetime

    return spark.createDataFrame(
        [(o, h, p, n, e, "", datetime(2024, 1, d)) for o, h, p, n, e, d in rows], DIRECTORY
    )


def test_directory_contract(spark):
    people_rows = dimensions.directory_upsert(
        directory(
            spark,
            ("a", "H1", "", "Old", "o@x", 1),
            ("a", "H1", None, "Ada", "a@x", 2),
            ("a", "H2", "P2", "Alan", "b@x", 1),
        )
    )
    got = {r.account_hash: r for r in dimensions.directory_resolve(people_rows, "a", ["H1", "H2", "H9"]).collect()}
    assert set(got) == {"H1", "H2"}
    assert (got["H1"].person_id, got["H1"].display_name, got["H2"].person_id) == ("H1", "Ada", "P2")
    assert dimensions.directory_resolve(people_rows, "b", ["H1"]).count() == 0
    assert dimensions.directory_resolve(people_rows, "a", []).count() == 0
    with pytest.raises(ValueError):
        dimensions.directory_resolve(people_rows, "a", ["x"] * (fx.IDENTITY_REQUEST_LIMIT + 1))


@pytest.mark.parametrize(
    "body", ['{"people": []}', '{"org": "o"}', '{"org": "o", "people": [{"displayName": "x"}]}', "junk"]
)
def test_bad_directory_files_fail_the_load(spark, body):
    files = spark.createDataFrame([(body,)], "value STRING")
    with pytest.raises(Exception, match="invalid directory file|missing required"):
        dimensions.directory_load(files, "p", "2024-01-01").collect()


def test_loaded_directory_joins_telemetry(lake, spark):
    loaded = dimensions.directory_load(directory_files(spark, lake.sf_dir), "p", "2024-01-01")
    assert loaded.count() == loaded.select("account_hash").distinct().count() > 0


def analytics(lake):
    return lake.analytics(), DateRange("org_1", "2024-01-05", "2024-01-25")


def test_other_tenants_and_hostile_values(lake):
    api, r = analytics(lake)
    assert api.metrics(DateRange("x' OR '1'='1", r.first_day, r.last_day)).count() == 0
    e, m = api.events(r), api.metrics(r)
    assert {row[0] for row in m.select("org_id").distinct().collect()} == {"org_1"}
    hostile = "x' OR '1'='1"
    assert capabilities.plugin_info(e, hostile).count() == 0
    assert tools.tool_uses_by_day(e, hostile).count() == 0
    assert people.model_cost_by_day(m, hostile).count() == 0


def test_empty_range_gives_zeros(lake):
    api, _ = analytics(lake)
    r = DateRange("org_1", "1999-01-01", "1999-01-02")
    assert list(health.session_duration(api.events(r)).first()) == [0.0, 0, 0.0, 0.0]
    assert list(tools.tool_latency(api.events(r), "Edit").first()) == [0.0, 0.0]
    assert overview.commits(api.metrics(r)).first()[0] == 0.0
    assert health.efficiency(api.events(r)).first().cache_hit_ratio == 0.0
    assert derived.overview_kpis(api.metrics(r), api.events(r)).first().edit_accept_pct is None


def test_totals_go_beyond_the_lists(spark):
    n, day = F.col("id"), F.lit("2024-01-05").cast("date").alias("event_date")
    dims = F.create_map(
        F.lit("tool_name"), F.concat(F.lit("t"), n), F.lit("agent.name"), F.concat(F.lit("a"), n % 30)
    )
    e = spark.range(600).select(
        F.lit("tool_result").alias("event_type"), dims.alias("dims"),
        F.create_map().cast("map<string,double>").alias("numbers"), F.lit("").alias("decision"),
        F.lit("u0").alias("user_hash"), n.alias("ts_ns"), n.cast("string").alias("dedup_id"), day,
    )
    m = spark.range(120).select(
        F.lit("token.usage").alias("name"), F.lit("").alias("subtype"), F.lit("").alias("decision"),
        F.lit("").alias("model"), F.lit(1.0).alias("value"), F.concat(F.lit("u"), n).alias("user_hash"),
        F.concat(F.lit("s"), n).alias("session_id"), day,
    )
    kpis, insights = derived.overview_kpis(m, e).first(), derived.tool_insights(e).first()
    assert (kpis.tool_calls, kpis.subagent_runs) == (600, 600)
    assert (insights.calls, insights.distinct_tools) == (600, 600)
    membership = m.select(F.col("user_hash").alias("account_hash"), F.lit("all").alias("team"))
    pages = {r.page: r for r in derived.detail_totals(m, e, membership, "u0", "x", "all", "x").collect()}
    assert pages["person"].uses == 600
    assert (pages["team"].tokens, pages["team"].uses) == (120.0, 120.0)


def test_a_cluster_session_must_name_the_shared_folder():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://x"}.get(key, default))

    with pytest.raises(RuntimeError, match="checkpoint"):
        work_dir(Cluster)


def test_prior_range():
    assert derived.prior_range("2024-01-05", "2024-01-25") == ("2023-12-15", "2024-01-04")
    assert derived.prior_range("2024-03-01", "2024-03-01") == ("2024-02-29", "2024-02-29")
    with pytest.raises(ValueError):
        DateRange("")


def test_change_is_judged(spark):
    cases = [(100.0, 0.0), (100.0, 100.01), (120.0, 100.0), (80.0, 100.0)]
    df = spark.createDataFrame(cases, "c DOUBLE, p DOUBLE").withColumn("m", derived.change(F.col("c"), F.col("p")))
    rows = df.select("m", derived.is_good(F.col("m")), derived.is_good(F.col("m"), True)).collect()
    assert [tuple(r) for r in rows] == [(None, None, None), (0.0, None, None), (0.2, True, False), (-0.2, False, True)]


def test_reports_cover_every_block(lake):
    api, r = analytics(lake)
    assert len(api.summary(r)) == 21
    for report in (
        api.person_detail(r, "u45"), api.model_detail(r, "model-2"), api.tool_detail(r, "Edit"), api.agent_detail(r, "x"),
        api.team_detail(r, "team-1"), api.capabilities(r), api.plugin_detail(r, "plg-1"), api.reliability(r),
        api.environment(r), api.governance(r), api.engagement(r),
    ):
        assert all(df.columns for df in report.values())
    assert api.identities("org_1", ["u45"]).columns and api.teams(r).columns and api.orgs().columns
    assert isinstance(api, Analytics)


def test_user_in_no_team_is_unassigned(lake):
    api, r = analytics(lake)
    none = api.membership("org_1").where("false")
    only = teams.teams(api.metrics(r), api.events(r), none).collect()
    assert [row.team for row in only] == [fx.UNASSIGNED_LABEL]


def test_maps_and_hot_columns_agree(lake):
    """The query blocks also run on tables without the flat copies."""
    _, r = analytics(lake)
    plain = scope(tables.replace_events(lake.bronze_events()), r.org, r.first_day, r.last_day)
    hot = scope(lake.events(), r.org, r.first_day, r.last_day)
    assert comparable(tools.tools_list(plain)).collect() == comparable(tools.tools_list(hot)).collect()


def test_a_batch_splits_into_tables_and_dead_letters(spark, lake):
    metric = '{"ts_ns":1704067200000000001,"source":"s","name":"n","kind":"counter","value":2.5,"org_id":"o","dedup_id":"d"}'
    rows = [
        (fx.METRICS_TOPIC, "o:1", metric),
        ("canonical.other", "o:1", metric),
        (fx.EVENTS_TOPIC, "o:1", '{"ts_ns":5,"event_type":"x","org_id":"o","numbers":{"a":1.0},"dims":{}}'),
        (fx.EVENTS_TOPIC, "o:2", "{not json"),
    ]
    paths = store.StorePaths(lake.scratch("m"), lake.scratch("e"), lake.scratch("d"))
    store.store_batch(spark.createDataFrame(rows, ingest.MESSAGE), paths)
    stored = spark.read.parquet(paths.metrics).collect()
    assert len(stored) == 2 and str(stored[0].event_date) == "2024-01-01" and stored[0].ts_ns % 10 == 1
    event = spark.read.parquet(paths.events).first()
    assert event.numbers == {"a": 1.0} and event.dedup_id == ""
    dead = spark.read.parquet(paths.dead_letters).collect()
    assert [(d.topic, d.key) for d in dead] == [(fx.DLQ_TOPIC, "o:2")] and "{not json" in dead[0].value


def test_recent_replays_can_be_dropped_in_the_stream(spark, lake):
    path = lake.scratch("stream")
    spark.range(10).select(
        F.timestamp_seconds("id").alias("timestamp"), (F.col("id") % 5).alias("dedup_id")
    ).write.parquet(path)
    source = spark.readStream.schema("timestamp TIMESTAMP, dedup_id BIGINT").parquet(path)
    out = lake.scratch("out")
    query = (
        store.drop_recent_replays(source, ["dedup_id"])
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", lake.scratch("offsets"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_only_whole_rows_are_decodable(spark):
    from usagelake import fixed_values as fx
    from usagelake.streaming import store

    row = '{"org_id":"o","ts_ns":5%s}'  # other fields may be missing, the dedup id too
    values = [row % "", row % ',"value":1.5', "5", "null", "[]", '"x"', "{}", '{"broken":', '{"ts_ns":"abc","org_id":"o","dedup_id":"d"}', None]
    for topic in (fx.EVENTS_TOPIC, fx.METRICS_TOPIC):
        messages = spark.createDataFrame([(topic, "k", v) for v in values], "topic string, key string, value string")
        good, dead = store.dlq_split(messages)
        assert good.count() == 2 and dead.count() == len(values) - 2


def test_quantiles_with_infinities(spark):
    from usagelake.operators.quantile import exact_quantiles

    inf = float("inf")
    rows = spark.createDataFrame([("a", v) for v in (-inf, 1.0, 2.0, 3.0, inf)] + [("b", inf)], "k string, v double")
    got = {r.k: (r.low, r.mid, r.high) for r in exact_quantiles(rows, ["k"], "v", {"low": 0.25, "mid": 0.5, "high": 0.75}).collect()}
    assert got["a"] == (1.0, 2.0, 3.0)
    assert got["b"] == (inf, inf, inf)
