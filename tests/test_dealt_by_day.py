"""Silver builds deal narrow rows by day and shuffle no wide ones."""

from pyspark.sql import functions as F

from tests.test_plans import plan
from usagelake.operators.replace import PART, dealt_by_day, replace_events, replace_metrics
from usagelake.sources import tables, testdata


def test_rows_dealt_by_day_are_not_shuffled_again(spark, sf_dir):
    for rows in (
        replace_metrics(testdata.bronze_metrics(spark, sf_dir, by_day=True)),
        replace_events(testdata.bronze_events(spark, sf_dir, by_day=True)),
    ):
        text = plan(rows, "simple")
        assert "WindowGroupLimit" in text and "hashpartitioning(org_id" not in text
        assert text.index("Window") < text.index("Exchange")  # no shuffle above the window


def test_a_silver_table_is_written_as_dealt(spark, sf_dir, tmp_path):
    bronze = testdata.bronze_metrics(spark, sf_dir, by_day=True)
    stored = tables.write_silver(replace_metrics(bronze), f"{tmp_path}/m", tables.METRIC_SORT, tables.promote_metrics)
    assert "rebalance" not in plan(stored, "extended").lower() and PART not in stored.columns
    assert spark.read.parquet(f"{tmp_path}/m").count() == replace_metrics(testdata.bronze_metrics(spark, sf_dir)).count()


def test_parts_hold_few_days_and_bounded_rows(spark):
    day = F.when(F.col("id") < 40_000, F.lit(1)).when(F.col("id") < 99_000, F.col("id") % 3 + 2).when(F.col("id") < 99_500, F.lit(9))
    rows = spark.range(0, 100_000, 1, 3).withColumn("day", day)
    dealt = dealt_by_day(rows, rows.select("day"), "day", (F.col("id"),), 5_000)
    parts = dealt.groupBy(F.spark_partition_id().alias("at"), PART).agg(F.count("*").alias("n"), F.count_distinct("day").alias("days")).collect()
    assert all(r["at"] == r[PART] for r in parts) and sum(r.n for r in parts) == 100_000
    assert max(r.n for r in parts) < 6_000 and max(r.days for r in parts) <= 2
    assert sorted(dealt.select("id").toPandas()["id"]) == list(range(100_000))


def test_copies_of_a_key_share_a_part(spark, sf_dir):
    rows = testdata.bronze_metrics(spark, sf_dir, by_day=True)
    key = ("org_id", "source", "name", "session_id", "ts_ns", "dedup_id")
    assert rows.groupBy(*key).agg(F.count_distinct(PART).alias("n")).where("n > 1").isEmpty()


def test_no_rows(spark):
    rows = spark.range(0).withColumn("day", F.lit(1))
    assert dealt_by_day(rows, rows.select("day"), "day", (F.col("id"),), 10).count() == 0
