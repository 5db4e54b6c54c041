"""Bronze, silver and dimension tables over one folder of generated tables.

Silver tables are written once per session and input state into the shared
working folder, so queries scan pruned day partitions instead of repeating the
replacement shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from usagelake.operators import dimensions
from usagelake.operators.replace import replace_events, replace_metrics
from usagelake.plans.repository import Analytics
from usagelake.schemas import PERSON_DIRECTORY, TEAM_MEMBERSHIP
from usagelake.session import prepare, work_dir
from usagelake.sources import tables, testdata

_written: dict[tuple, tuple[str, StructType]] = {}  # input state -> folder and schema


def _state(spark: SparkSession, paths: tuple[str, ...]) -> tuple:
    """Number, size and age of the input files; listing only, no file is read."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "modificationTime")
    row = files.agg(
        F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
    ).first()
    return tuple(str(x) for x in row)


def _land(rows: DataFrame, path: str) -> DataFrame:
    """Write request bodies compressed, in small row groups and files of bounded rows.

    JSON text compresses far below the work of decoding it and readers size their
    splits by file bytes; what a file costs to open keeps the rows of a split bounded.
    """
    writer = rows.write.option("compression", "zstd").option("maxRecordsPerFile", 100_000)
    writer.option("parquet.block.size", 16 << 20).parquet(path)
    return rows


class Lake:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def bronze_metrics(self) -> DataFrame:
        return testdata.bronze_metrics(self.spark, self.sf_dir)

    def bronze_events(self) -> DataFrame:
        return testdata.bronze_events(self.spark, self.sf_dir)

    def metrics(self) -> DataFrame:
        return self._written_once(
            "silver-metrics",
            ("lineitem", "orders"),
            lambda: replace_metrics(testdata.bronze_metrics(self.spark, self.sf_dir, by_day=True)),
            lambda rows, path: tables.write_silver(rows, path, tables.METRIC_SORT, tables.promote_metrics),
        )

    def events(self) -> DataFrame:
        return self._written_once(
            "silver-events",
            ("events",),
            lambda: replace_events(testdata.bronze_events(self.spark, self.sf_dir, by_day=True)),
            lambda rows, path: tables.write_silver(rows, path, tables.EVENT_SORT, tables.promote_events),
        )

    def metric_requests(self) -> DataFrame:
        """Landed export requests: (ok, pk, value)."""
        return self._written_once(
            "metric-requests",
            ("lineitem", "orders"),
            lambda: testdata.metric_requests(self.spark, self.sf_dir),
            _land,
        )

    def log_requests(self) -> DataFrame:
        """Landed export requests: (i, value)."""
        return self._written_once(
            "log-requests",
            ("events",),
            lambda: testdata.log_requests(self.spark, self.sf_dir),
            _land,
        )

    def membership(self) -> DataFrame:
        return testdata.membership_history(self.spark, self.sf_dir)

    def directory(self) -> DataFrame:
        return testdata.directory_history(self.spark, self.sf_dir)

    def current_membership(self) -> DataFrame:
        return self._dimension("membership", TEAM_MEMBERSHIP, self.membership)

    def current_directory(self) -> DataFrame:
        return self._dimension("directory", PERSON_DIRECTORY, self.directory)

    def _dimension(self, name: str, schema: str, history: Callable[[], DataFrame]) -> DataFrame:
        """A stored dimension: two thirds of the versions folded into the snapshot, the rest as changes."""

        def write(rows: DataFrame, path: str) -> DataFrame:
            late = F.pmod(F.xxhash64("account_hash", "updated_at"), F.lit(3)) == 0
            dimensions.append_changes(rows.where(~late), path)
            dimensions.fold(self.spark, path, schema)
            dimensions.append_changes(rows.where(late), path)
            return rows

        path, _ = self._folder_once(name, ("customer",), history, write)
        return dimensions.current(self.spark, path, schema)

    def analytics(self) -> Analytics:
        return Analytics(
            self.metrics(),
            self.events(),
            self.current_membership(),
            self.current_directory(),
            self.bronze_metrics(),
            self.bronze_events(),
        )

    def scratch(self, purpose: str) -> str:
        """A new folder below the shared working folder."""
        return f"{work_dir(self.spark)}/{purpose}-{uuid.uuid4().hex}"

    def _written_once(
        self,
        name: str,
        inputs: tuple[str, ...],
        build: Callable[[], DataFrame],
        write: Callable[[DataFrame, str], DataFrame],  # gives the rows as stored
    ) -> DataFrame:
        path, schema = self._folder_once(name, inputs, build, write)
        return self.spark.read.schema(schema).parquet(path)

    def _folder_once(
        self,
        name: str,
        inputs: tuple[str, ...],
        build: Callable[[], DataFrame],
        write: Callable[[DataFrame, str], DataFrame],  # gives the rows as stored
    ) -> tuple[str, StructType]:
        paths = tuple(f"{self.sf_dir}/{t}.parquet" for t in inputs)
        key = (self.spark.sparkContext.applicationId, name, paths, _state(self.spark, paths))
        if key not in _written:
            path, rows = self.scratch(name), build()
            _written[key] = path, write(rows, path).schema
        return _written[key]
