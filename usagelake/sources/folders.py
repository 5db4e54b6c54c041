"""Jobs that rewrite parts of a stored table: swapping files, retention, compaction.

A table is a folder of partition folders (``event_date=2024-01-05``) with Parquet files. A job writes the new files
below ``_swap`` (hidden from plain reads), then a manifest with the names of all new and old files, then moves the new
ones in and deletes the old ones. Before the manifest exists nothing has changed; after it exists the rest is repeated
until done, by ``recover`` or the next job. ``read_folders`` shows the old or the new files at any moment; a plain read
shows the new ones once the job has ended. Files that others append meanwhile are in no manifest and stay.

One maintenance job per table runs at a time. Listings and manifests hold file names only.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "event_date"
_SWAP = "_swap"


class Files:
    """The file system of a path, by Hadoop's interface: local, HDFS or an object store."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._utf8 = spark._jvm.java.nio.charset.StandardCharsets.UTF_8

    def matching(self, pattern: str) -> list[tuple[str, int]]:
        """(path, bytes) of what a glob pattern matches, in order."""
        found = self._fs.globStatus(self._path(pattern)) or []
        return sorted((s.getPath().toUri().getPath(), s.getLen()) for s in found)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._path(target).getParent())
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot move {source} to {target}")

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, self._utf8)
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write a small file that appears whole or not at all."""
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        stream = self._fs.create(self._path(draft))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(self._path(path)):
            self._fs.delete(self._path(path), False)
        self.move(draft, path)


def _plain(path: str) -> str:
    return path.rstrip("/")


@dataclass(frozen=True)
class Swap:
    """Names relative to the table: files to delete, and new files with their place below the staging folder."""

    staging: str
    old: list[str]
    new: list[str]


def _pending(files: Files, path: str) -> list[tuple[str, Swap]]:
    out = []
    for manifest, _ in files.matching(f"{path}/{_SWAP}/*.manifest"):
        out.append((manifest, Swap(**json.loads(files.read(manifest)))))
    return out


def data_files(files: Files, path: str, by: str = DAY, value: str = "*") -> list[tuple[str, int]]:
    """(partition folder/file name, bytes) of the data files; names that start with _ or . are no data."""
    found = files.matching(f"{path}/{by}={value}/[!_.]*")
    return [("/".join(name.split("/")[-2:]), size) for name, size in found]


def partitions(files: Files, path: str, by: str = DAY) -> list[str]:
    return [name.rsplit("=", 1)[1] for name, _ in files.matching(f"{path}/{by}=*")]


def recover(spark: SparkSession, path: str) -> None:
    """End swaps that a stopped job left behind, and remove what it wrote before its manifest."""
    path, files = _plain(path), Files(spark, path)
    for manifest, swap in _pending(files, path):
        _apply(files, path, manifest, swap)
    files.delete(f"{path}/{_SWAP}")


def _apply(files: Files, path: str, manifest: str, swap: Swap) -> None:
    """New files in, old files out; any step may already be done."""
    for name in swap.new:
        staged = f"{path}/{_SWAP}/{swap.staging}/{name}"
        if files.exists(staged):
            files.move(staged, f"{path}/{name}")
    for name in swap.old:
        files.delete(f"{path}/{name}")
    files.delete(manifest)
    files.delete(f"{path}/{_SWAP}/{swap.staging}")


def swap_files(
    spark: SparkSession, path: str, old: Iterable[str], write: Callable[[str], None] | None, by: str = DAY,
    step: Callable[[str], None] = lambda name: None,
) -> None:
    """Replace the ``old`` files by what ``write`` puts into the folder it is given.

    ``step`` is called between the steps; tests stop the job there.
    """
    path, files, staging = _plain(path), Files(spark, path), uuid.uuid4().hex
    if write:
        write(f"{path}/{_SWAP}/{staging}")
    step("written")
    new = [name for name, _ in data_files(files, f"{path}/{_SWAP}/{staging}", by)]
    manifest, swap = f"{path}/{_SWAP}/{staging}.manifest", Swap(staging, sorted(old), new)
    files.write(manifest, json.dumps(swap.__dict__))
    step("named")
    for k, name in enumerate(swap.new):
        files.move(f"{path}/{_SWAP}/{staging}/{name}", f"{path}/{name}")
        if k == 0:
            step("moving")
    step("moved")
    _apply(files, path, manifest, swap)


def read_files(spark: SparkSession, schema: str, base: str, names: list[str]) -> DataFrame:
    """The rows of single files below ``base``."""
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{n}" for n in names])


def read_folders(spark: SparkSession, path: str, schema: str, by: str = DAY) -> DataFrame:
    """The table's rows; while a swap is under way, the rows after it."""
    path, files = _plain(path), Files(spark, path)
    pending = _pending(files, path)
    if not files.exists(path):
        return spark.createDataFrame([], schema)
    if not pending:
        return spark.read.schema(schema).parquet(path)
    gone = {name for _, swap in pending for name in swap.old}
    rows = read_files(spark, schema, path, [n for n, _ in data_files(files, path, by) if n not in gone])
    for _, swap in pending:
        base = f"{path}/{_SWAP}/{swap.staging}"
        rows = rows.unionByName(read_files(spark, schema, base, [n for n in swap.new if files.exists(f"{base}/{n}")]))
    return rows


def replace_partitions(rows: DataFrame, path: str, values: Iterable[str], sort: tuple[str, ...], by: str = DAY, **job) -> None:
    """Make ``rows`` the whole content of the partitions ``values``; all others keep their files."""
    spark, values = rows.sparkSession, list(values)
    recover(spark, path)
    files = Files(spark, path)
    old = [n for v in values for n, _ in data_files(files, _plain(path), by, v)]

    def write(folder: str) -> None:
        (
            rows.where(F.col(by).cast("string").isin(values))
            .hint("rebalance", F.col(by))
            .sortWithinPartitions(by, *sort)
            .write.partitionBy(by)
            .parquet(folder)
        )

    swap_files(spark, path, old, write if values else None, by, **job)


# --- retention --------------------------------------------------------------------


def drop_expired(spark: SparkSession, path: str, as_of, days: int) -> list[str]:
    """Delete the day folders whose day plus ``days`` is not after ``as_of``. Each is one delete; a stopped job goes on."""
    recover(spark, path)
    files, last = Files(spark, path), _cutoff(as_of, days)
    gone = [d for d in partitions(files, _plain(path)) if d <= last]
    for d in gone:
        files.delete(f"{_plain(path)}/{DAY}={d}")
    return gone


def _cutoff(as_of, days: int) -> str:
    return (date.fromisoformat(str(as_of)[:10]) - timedelta(days=days)).isoformat()


def clear_expired_content(spark: SparkSession, path: str, schema: str, as_of, days: int, sort: tuple[str, ...] = (), **job) -> int:
    """Blank ``content_fields`` of days that are ``days`` old, in storage. Returns the number of files rewritten.

    Only files that hold content are rewritten; finding them reads that one column of the old days.
    """
    recover(spark, path)
    path, files, last = _plain(path), Files(spark, path), _cutoff(as_of, days)
    old_days = [d for d in partitions(files, path) if d <= last]
    if not old_days:
        return 0
    rows = spark.read.schema(schema).parquet(path).where(F.col(DAY) <= F.lit(last).cast("date"))
    held = rows.where(F.size("content_fields") > 0).select(F.date_format(DAY, "yyyy-MM-dd").alias("d"), F.col("_metadata.file_name").alias("f"))
    names = [f"{DAY}={r.d}/{r.f}" for r in held.distinct().collect()]  # file names, not rows
    if not names:
        return 0
    blank = F.create_map().cast("map<string,string>")

    def write(folder: str) -> None:
        cleared = read_files(spark, schema, path, names).withColumn("content_fields", blank)
        cleared.hint("rebalance", F.col(DAY)).sortWithinPartitions(DAY, *sort).write.partitionBy(DAY).parquet(folder)

    swap_files(spark, path, names, write, **job)
    return len(names)


# --- compaction -------------------------------------------------------------------


def compact(
    spark: SparkSession, path: str, schema: str, sort: tuple[str, ...], target_bytes: int = 256 << 20, by: str = DAY, **job
) -> list[str]:
    """Merge the small files of each partition into files of about ``target_bytes``. Returns the partitions touched.

    Files of at least half that size stay as they are. A partition's rows are dealt by a hash of the sort columns into as
    many files as its bytes ask for, each sorted.
    """
    recover(spark, path)
    path, files = _plain(path), Files(spark, path)
    small: dict[str, list[tuple[str, int]]] = {}
    for name, size in data_files(files, path, by):
        if size < target_bytes / 2:
            small.setdefault(name.split("/")[0].split("=", 1)[1], []).append((name, size))
    small = {p: found for p, found in small.items() if len(found) > 1}
    names = [name for found in small.values() for name, _ in found]
    shares = [(p, max(1, math.ceil(sum(size for _, size in found) / target_bytes))) for p, found in small.items()]
    if not small:
        return []

    def write(folder: str) -> None:
        share = spark.createDataFrame(shares, "_part STRING, _share INT")  # one row per partition
        rows = read_files(spark, schema, path, names)
        dealt = rows.join(F.broadcast(share), rows[by].cast("string") == F.col("_part")).withColumn(
            "_slice", F.pmod(F.xxhash64(*sort), F.col("_share"))
        )
        dealt = dealt.repartition(min(sum(n for _, n in shares), 10_000), by, "_slice").sortWithinPartitions(by, "_slice", *sort)
        dealt.drop("_part", "_share", "_slice").write.partitionBy(by).parquet(folder)

    swap_files(spark, path, names, write, by, **job)
    return sorted(small)
