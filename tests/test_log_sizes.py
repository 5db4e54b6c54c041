"""What queries over landed requests shuffle, and what a message log takes on disk."""

from glob import glob
from urllib.parse import urlparse

from pyspark.sql import functions as F

from checks import ingest_queries as q
from tests.test_plans import plan


def test_rows_of_landed_requests_are_not_shuffled(lake):
    for query in (q.PIPELINE["read_otlp_metrics"], q.PIPELINE["metric_to_row"], q.PIPELINE["metric_dedup_id"]):
        assert "Exchange" not in plan(query(lake), "simple")
    text = plan(q.PIPELINE["resource_long_tail"](lake), "simple")
    assert text.count("Exchange") == 1 and text.count("HashAggregate") == 2  # counts per group only


def test_a_message_log_is_a_fraction_of_its_text(lake):
    path = q._full_log(lake)
    messages = q._read_log(lake, path)
    texts = messages.agg(F.sum(F.octet_length("value"))).first()[0]
    files = glob(f"{urlparse(path).path}/part-*.parquet")
    assert files and all(".zstd." in f for f in files)
    assert 0 < sum(len(open(f, "rb").read()) for f in files) < texts / 4
