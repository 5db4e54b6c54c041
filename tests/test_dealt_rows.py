"""What a silver build shuffles, and how rows are dealt."""

from pyspark.sql import functions as F

from tests.test_plans import plan
from usagelake.operators.replace import replace_events, replace_metrics
from usagelake.sources import testdata


def test_copies_meet_without_a_shuffle_of_wide_rows(lake):
    for rows in (replace_metrics(lake.bronze_metrics()), replace_events(lake.bronze_events())):
        text = plan(rows, "simple")
        assert "WindowGroupLimit" in text and "hashpartitioning(org_id" not in text


def test_rows_are_dealt_in_parts_of_bounded_size(spark):
    rows = spark.range(0, 100_000, 1, 1).withColumn("key", F.concat(F.lit("s"), F.col("id").cast("string")))
    dealt = testdata.dealt(rows, "key", 2_000)
    assert dealt.rdd.getNumPartitions() == 50
    sizes = [r[0] for r in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 3_000
