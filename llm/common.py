"""Helpers shared by the operators: words, intermediate tables, prefix sums, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)

_own: dict[str, str] = {}
_remembered: dict[str, tuple] = {}  # memos of this process by operator


def folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="llm-")
    return _own[app]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    del df
    gc.collect()
    spark._jvm.System.gc()  # lets Spark drop the shuffle files of plans that nothing refers to any more
    kept.stash_path = path
    return kept


def discard(df: DataFrame) -> None:
    """Remove a table written by ``stash`` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remember(operator: str, *memos) -> None:
    """Name what an operator keeps in this process from task to task, and empty what other operators have kept.

    Workers outlive the stage they were started for, so they would hold the memos of all stages of a chain.
    """
    for other in [k for k in _remembered if k != operator]:
        for memo in _remembered.pop(other):
            memo.clear()
    _remembered[operator] = memos


def words(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def key_of(value: Column) -> Column:
    """A string that is never NULL and differs for NULL and every string."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), value.cast("string")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(rows: int, per_slice: int = 65_536, least: int = 64) -> int:
    """A power of two of slices that hold about ``per_slice`` rows each, at least ``least``."""
    return max(least, 1 << max(0, (max(rows, 1) - 1) // per_slice).bit_length())


def running_total(df: DataFrame, keys: list[str], part: str, order: list, value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the same keys, ordered by ``part`` and then ``order``.

    Only rows of one (keys, part) meet in a task; whole keys meet as one total per part. No key column is NULL.
    """
    at = [*keys, part]
    within = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        df.groupBy(*at)
        .agg(F.sum(value).alias("_sum"))
        .select(*at, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    )
    inside = df.withColumn("_inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inside.join(bases, at).withColumn(name, F.col("_base") + F.col("_inside")).drop("_base", "_inside")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node per node, for undirected ``links`` (a, b) of longs: rows (node, component).

    Each round a node takes the smallest label among itself and its neighbours and then the label of that label,
    so the number of rounds grows with the logarithm of a chain's length. Labels are written out after each round.
    Self-links are allowed; a node without links does not appear.
    """
    both = stash(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("near"))
            .withColumnRenamed("a", "node")
        )
        nearest = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = stash(
            nearest.join(roots, "label").select("node", "old", F.least("label", "root").alias("label")), "labels"
        )
        changed = after.where("label <> old").limit(1).count()
        discard(labels)
        labels = _narrow(after)
        if not changed:
            discard(both)
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"labels still change after {rounds} rounds")


def _narrow(df: DataFrame) -> DataFrame:
    kept = df.select("node", "label")
    kept.stash_path = df.stash_path
    return kept
