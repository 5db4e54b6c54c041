"""What appending rows to a stored table shuffles."""

import os
from glob import glob

from pyspark.sql import functions as F

from usagelake.schemas import METRIC_COLUMNS, METRICS
from usagelake.sources import tables


def test_appended_rows_are_neither_shuffled_nor_sorted(spark, tmp_path):
    day = F.expr("date_add(DATE'2024-01-01', int(id % 20))")
    types = dict(c.strip().split(" ", 1) for c in METRICS.replace("\n", " ").split(",") if " " in c.strip() and "<" not in c)
    rows = spark.range(0, 20_000, 1, 3).select(
        *[(day if c == "event_date" else F.col("id") if c == "ts_ns" else F.lit(None).cast(types.get(c, "string"))).alias(c) for c in METRIC_COLUMNS]
    )
    tables.append_rows(rows, str(tmp_path / "t"), METRIC_COLUMNS, "w-1")
    files = glob(f"{tmp_path}/t/event_date=*/w-1-*.parquet")
    assert len({os.path.dirname(f) for f in files}) == 20
    assert len(files) == 60  # a shuffle by day would leave a file per day
    assert all(".zstd." in f for f in files)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.count() == 20_000 and stored.agg(F.sum("ts_ns")).first()[0] == sum(range(20_000))
