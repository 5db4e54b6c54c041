"""Jobs over stored tables: swaps that stop anywhere, retention, compaction, the log of batches, dimensions."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from usagelake import fixed_values as fx
from usagelake.operators import dimensions
from usagelake.operators.replace import replace_dimension
from usagelake.schemas import EVENT_COLUMNS, EVENTS, METRICS, TEAM_MEMBERSHIP
from usagelake.sources import folders, tables
from usagelake.streaming import ingest, store

ROWS = "event_date DATE, k BIGINT, v STRING"


def stop_at(name):
    def step(reached):
        if reached == name:
            raise InterruptedError(name)

    return step


def days_table(spark, path, parts=3):
    for n in range(parts):
        rows = spark.range(12).select(
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("event_date"), (F.col("id") + 12 * n).alias("k"), F.lit("old").alias("v")
        )
        rows.coalesce(1).write.mode("append").partitionBy("event_date").parquet(path)


def content(df):
    return sorted((str(r.event_date), r.k, r.v) for r in df.select("event_date", "k", "v").collect())


def names(spark, path):
    return {n for n, _ in folders.data_files(folders.Files(spark, path), path)}


@pytest.mark.parametrize("stop", ["written", "named", "moving", "moved", ""])
def test_a_swap_that_stops_shows_old_or_new_rows(spark, lake, stop):
    path = lake.scratch("swap")
    days_table(spark, path)
    before, old_names = content(folders.read_folders(spark, path, ROWS)), names(spark, path)
    new = folders.read_folders(spark, path, ROWS).where("event_date = DATE'2024-01-02'").withColumn("v", F.lit("new"))
    want = sorted((d, k, "new" if d == "2024-01-02" else v) for d, k, v in before)
    try:
        folders.replace_partitions(new, path, ["2024-01-02"], ("k",), step=stop_at(stop))
        assert not stop
    except InterruptedError:
        seen = content(folders.read_folders(spark, path, ROWS))
        assert seen == (before if stop == "written" else want)
        days_table(spark, path, 1)  # rows that arrive meanwhile stay
        before, want = (sorted(x + [(d, k, "old") for d, k, v in before if k < 12]) for x in (before, want))
        folders.recover(spark, path)
    after = spark.read.schema(ROWS).parquet(path)  # a plain read
    assert content(after) == (before if stop == "written" else want)
    kept = {n for n in old_names if not n.startswith("event_date=2024-01-02")}
    assert kept <= names(spark, path)
    assert not folders.Files(spark, path).matching(f"{path}/_swap/*")


def test_a_swap_to_nothing_and_a_table_that_is_missing(spark, lake):
    path = lake.scratch("swap")
    assert folders.read_folders(spark, path, ROWS).count() == 0
    days_table(spark, path)
    empty = spark.createDataFrame([], ROWS)
    folders.replace_partitions(empty, path, ["2024-01-03", "2030-01-01"], ("k",))
    assert {d for d, *_ in content(spark.read.schema(ROWS).parquet(path))} == {"2024-01-01", "2024-01-02"}


def test_expired_days_leave_the_folder(spark, lake):
    path = lake.scratch("retention")
    days_table(spark, path)
    assert folders.drop_expired(spark, path, "2024-04-01", 90) == ["2024-01-01", "2024-01-02"]
    assert folders.drop_expired(spark, path, "2024-04-01", 90) == []
    assert {d for d, *_ in content(spark.read.parquet(path))} == {"2024-01-03"}


@pytest.mark.parametrize("stop", ["written", "named", "moved", ""])
def test_expired_content_leaves_the_folder(spark, lake, stop):
    path = lake.scratch("content")
    events = lake.bronze_events().where("event_date BETWEEN DATE'2024-01-03' AND DATE'2024-01-12'")
    tables.append_rows(events, path, EVENT_COLUMNS)
    rows, before = spark.read.parquet(path).count(), names(spark, path)
    try:
        cleared = folders.clear_expired_content(spark, path, EVENTS, "2024-02-08", 30, step=stop_at(stop))
        assert not stop and cleared
    except InterruptedError:
        assert folders.read_folders(spark, path, EVENTS).count() == rows
        folders.clear_expired_content(spark, path, EVENTS, "2024-02-08", 30)
    after = spark.read.parquet(path)
    assert after.count() == rows
    held = {str(r[0]) for r in after.where("size(content_fields) > 0").select("event_date").distinct().collect()}
    assert held and min(held) >= "2024-01-10"
    assert {n for n in before if n >= "event_date=2024-01-10"} <= names(spark, path)
    assert folders.clear_expired_content(spark, path, EVENTS, "2024-02-08", 30) == 0


def test_fifty_batches_become_a_file_a_day(spark, lake):
    path = lake.scratch("compact")
    days_table(spark, path, 50)
    before = content(spark.read.parquet(path))
    assert len(names(spark, path)) == 150
    with pytest.raises(InterruptedError):
        folders.compact(spark, path, ROWS, ("k",), step=stop_at("moving"))
    assert content(folders.read_folders(spark, path, ROWS)) == before
    folders.recover(spark, path)
    assert len(names(spark, path)) == 3 and content(spark.read.parquet(path)) == before
    assert folders.compact(spark, path, ROWS, ("k",)) == []
    for name in names(spark, path):
        ks = [r.k for r in spark.read.parquet(f"{path}/{name}").collect()]
        assert ks == sorted(ks)
    days_table(spark, path, 2)
    size = max(s for _, s in folders.data_files(folders.Files(spark, path), path))
    folders.compact(spark, path, ROWS, ("k",), target_bytes=2 * size)
    assert len(names(spark, path)) <= 6


def messages_of(spark, n, day="2024-01-01", first=0):
    start = int(spark.sql(f"SELECT unix_micros(TIMESTAMP'{day} 00:00:00')").first()[0]) * 1000
    rows = [
        (fx.METRICS_TOPIC if k % 2 else fx.EVENTS_TOPIC, "o:s", json.dumps(
            {"org_id": "o", "ts_ns": start + k, "source": "s", "name": "n", "event_type": "x", "session_id": "s", "correlation_id": "", "value": 1.0, "numbers": {}, "dims": {}, "attributes": {}}))
        for k in range(first, first + n)
    ]
    return spark.createDataFrame([*rows, (fx.EVENTS_TOPIC, "o:s", "{")], ingest.MESSAGE)


@pytest.mark.parametrize("stop", ["dead letters", "metrics", "events"])
def test_a_batch_is_stored_once(spark, lake, stop):
    paths = store.StorePaths(lake.scratch("m"), lake.scratch("e"), lake.scratch("d"), lake.scratch("log"))
    batch = messages_of(spark, 20)
    with pytest.raises(InterruptedError):
        store.store_batch(batch, paths, batch=0, writer="w", step=stop_at(stop))
    for _ in range(2):
        store.store_batch(batch, paths, batch=0, writer="w")
    store.store_batch(messages_of(spark, 4, first=100), paths, batch=1, writer="w")
    store.store_batch(messages_of(spark, 4, first=200), paths, batch=10, writer="w")  # its name begins like that of batch 1
    assert [spark.read.parquet(p).count() for p in (paths.metrics, paths.events, paths.dead_letters)] == [14, 14, 3]


def test_silver_follows_touched_days_only(spark, lake):
    paths = store.StorePaths(lake.scratch("m"), lake.scratch("e"), lake.scratch("d"))
    silver = lake.scratch("silver-m"), lake.scratch("silver-e")
    store.store_batch(messages_of(spark, 10, "2024-01-01"), paths, batch=0, writer="w")
    store.store_batch(messages_of(spark, 10, "2024-01-02"), paths, batch=1, writer="w")
    with pytest.raises(InterruptedError):
        store.refresh_silver(spark, paths, *silver, step=stop_at("metrics"))
    assert store.refresh_silver(spark, paths, *silver)["events"] == ["2024-01-01", "2024-01-02"]
    first = names(spark, silver[0])
    store.store_batch(messages_of(spark, 10, "2024-01-02", first=5), paths, batch=2, writer="w")  # half of it again, and late rows
    assert store.refresh_silver(spark, paths, *silver)["metrics"] == ["2024-01-02"]
    assert store.refresh_silver(spark, paths, *silver) == {"metrics": [], "events": []}
    assert {n for n in first if "01-01" in n} == {n for n in names(spark, silver[0]) if "01-01" in n}
    for path, bronze, schema, whole, keys in (
        (silver[0], paths.metrics, METRICS, tables.silver_metrics, "ts_ns"), (silver[1], paths.events, EVENTS, tables.silver_events, "ts_ns"),
    ):
        got = sorted((str(r.event_date), r.ts_ns) for r in spark.read.parquet(path).collect())
        want = sorted((str(r.event_date), r.ts_ns) for r in whole(folders.read_folders(spark, bronze, schema)).collect())
        assert got == want and len(got) in (12, 13)


def test_dimension_snapshots_equal_a_full_rebuild(spark, lake):
    path, seen = lake.scratch("membership"), []

    def change(version, *rows):
        frame = spark.createDataFrame([(*r, version) for r in rows], "org_id STRING, account_hash STRING, team STRING, at STRING")
        frame = frame.withColumn("updated_at", F.col("at").cast("timestamp")).drop("at")
        seen.append(frame)
        dimensions.append_changes(frame, path)

    def check():
        history = seen[0]
        for frame in seen[1:]:
            history = history.unionByName(frame)
        want = sorted(map(str, replace_dimension(history).select("org_id", "account_hash", "team", "updated_at").collect()))
        got = dimensions.current(spark, path, TEAM_MEMBERSHIP).select("org_id", "account_hash", "team", "updated_at")
        assert sorted(map(str, got.collect())) == want
        return got

    assert dimensions.current(spark, path, TEAM_MEMBERSHIP).count() == 0 and dimensions.fold(spark, path, TEAM_MEMBERSHIP) == 0
    change("2024-01-02", ("o", "a", "t1"), ("o", "b", "t1"), ("p", "a", "t9"))
    check()
    assert dimensions.fold(spark, path, TEAM_MEMBERSHIP)
    plan = check()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    change("2024-01-01", ("o", "a", "late"), ("o", "c", "t3"))  # older than the snapshot's row
    change("2024-01-02", ("o", "b", "t2"), ("o", "b", "t0"))  # ties with it, and with each other
    change("2024-01-03", ("p", "a", None))
    check()
    for stop in ("written", "named", "moved"):
        with pytest.raises(InterruptedError):
            dimensions.fold(spark, path, TEAM_MEMBERSHIP, stop_at(stop))
        check()
        folders.recover(spark, path)
        check()
        change("2024-02-01", ("q", stop, "t"))
    dimensions.fold(spark, path, TEAM_MEMBERSHIP)
    check()


def test_no_report_ranks_versions_of_dimensions(lake):
    from tests.test_operators import analytics

    api, r = analytics(lake)
    assert date.fromisoformat(r.first_day)
    for df in (api.teams(r), *api.team_detail(r, "team-1").values(), api.identities("org_1", ["u45"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        ranked = [line for line in plan.splitlines() if "row_number" in line]
        assert all("updated_at" in line for line in ranked)  # of the changes since the snapshot only
        assert plan.count("part#") or "LocalRelation" in plan
