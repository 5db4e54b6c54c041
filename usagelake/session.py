"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# UTC days, last-wins map keys, HMAC pads / long hex literals kept out of explain output, one open file per day of a
# writing task instead of a sort by day, and no generated method of a size that the JVM does not compile (8000 bytes).
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.redaction.string.regex": r"(?i)0x[0-9a-f]{128}|X'[0-9a-f]{128}'",
    "spark.sql.maxConcurrentOutputFileWriters": "64",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_local_dirs: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator here relies on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", memory: str = "12g", app: str = "usagelake") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    partitions = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def work_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors for written intermediate tables.

    A cluster must name it in ``spark.checkpoint.dir``. A single-machine session
    without that setting gets a fresh temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="usagelake-")
    return _local_dirs[app]
