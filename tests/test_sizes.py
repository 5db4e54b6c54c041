"""What stored requests take on disk."""

from pyspark.sql import functions as F

from usagelake.sources.folders import Files


def test_landed_requests_are_a_fraction_of_their_text(spark, lake):
    for requests in (lake.metric_requests(), lake.log_requests()):
        texts = requests.agg(F.sum(F.octet_length("value"))).first()[0]
        folders = {f.rsplit("/", 1)[0] for f in requests.inputFiles()}
        stored = sum(size for folder in folders for _, size in Files(spark, folder).matching(f"{folder}/part-*"))
        assert 0 < stored < texts / 4
