"""Person directory and team membership.

A stored dimension has two parts: ``part=snapshot`` with one row per account, and ``part=delta`` with the changes since.
Reads merge the newest change of each account into the snapshot; ``fold`` makes that the next snapshot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake import fixed_values as fx
from usagelake.functions.identity import pseudonymize
from usagelake.functions.maps import text
from usagelake.operators.replace import replace_dimension
from usagelake.schemas import DIRECTORY_FILE
from usagelake.sources import folders

PART, SNAPSHOT, DELTA = "part", "snapshot", "delta"


def directory_load(files: DataFrame, pepper: str, updated_at, column: str = "value") -> DataFrame:
    """Directory documents ``{org, people[]}`` -> directory rows, hashed like the telemetry.

    The whole load fails on a document without org or people, or on a person
    without account id or name.
    """
    doc = F.from_json(F.col(column), DIRECTORY_FILE)
    parsed = files.select(doc.alias("doc"))
    good_file = (F.length("doc.org") > 0) & F.col("doc.people").isNotNull()
    people = parsed.select(
        F.when(F.coalesce(good_file, F.lit(False)), F.col("doc.org"))
        .otherwise(F.raise_error(F.lit("invalid directory file: expected { org, people[] }")))
        .alias("org_id"),
        F.explode_outer("doc.people").alias("p"),
    )
    # An empty people list keeps its row until here, so that the org check runs.
    people = people.where(F.col("org_id").isNotNull() & F.col("p").isNotNull())
    named = F.coalesce((F.length("p.accountUuid") > 0) & (F.length("p.displayName") > 0), F.lit(False))
    account = F.when(named, F.col("p.accountUuid")).otherwise(
        F.raise_error(F.lit("person is missing required accountUuid or displayName"))
    )
    return people.select(
        "org_id",
        pseudonymize(account, pepper).alias("account_hash"),
        F.col("p.personId").alias("person_id"),
        F.col("p.displayName").alias("display_name"),
        text(F.col("p.email")).alias("email"),
        text(F.col("p.externalId")).alias("external_id"),
        F.lit(updated_at).cast("timestamp").alias("updated_at"),
    )


def append_changes(rows: DataFrame, path: str) -> None:
    """Add versions of a dimension's rows."""
    rows.withColumn(PART, F.lit(DELTA)).write.mode("append").partitionBy(PART).parquet(path)


def _merged(stored: DataFrame) -> DataFrame:
    """The newest row of each account: the snapshot's, or the newest change where that is not older.

    Only changes are ranked. Ties between equal versions fall to the greater remaining columns, as in a full rebuild.
    """
    key = list(fx.DIMENSION_KEY)
    others = [c for c in stored.columns if c not in (*key, "updated_at", PART)]
    row = F.struct("updated_at", *others)
    changes = replace_dimension(stored.where(F.col(PART) == DELTA).drop(PART)).select(*key, row.alias("_new"))
    known = stored.where(F.col(PART) == SNAPSHOT).select(*key, row.alias("_old"))
    newest = known.join(changes, key, "full").select(*key, F.greatest("_old", "_new").alias("_row"))
    return newest.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in stored.columns if c != PART])


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per account of a stored dimension, in the columns of ``schema``."""
    rows = folders.read_folders(spark, path, f"{schema}, {PART} STRING", PART)
    if not folders.data_files(folders.Files(spark, path), path.rstrip("/"), PART, DELTA):
        return rows.drop(PART)
    return _merged(rows)


def fold(spark: SparkSession, path: str, schema: str, step: Callable[[str], None] = lambda name: None) -> int:
    """Merge the changes into a new snapshot and swap it in. Returns the number of change files folded.

    Changes that arrive meanwhile stay for the next fold. The snapshot is sorted by account, so that one
    organization's rows lie in few row groups.
    """
    folders.recover(spark, path)
    path, files = path.rstrip("/"), folders.Files(spark, path)
    changes = [n for n, _ in folders.data_files(files, path, PART, DELTA)]
    if not changes:
        return 0
    names = [*changes, *[n for n, _ in folders.data_files(files, path, PART, SNAPSHOT)]]

    def write(folder: str) -> None:
        rows = _merged(folders.read_files(spark, f"{schema}, {PART} STRING", path, names))
        sorted_rows = rows.hint("rebalance").sortWithinPartitions(*fx.DIMENSION_KEY)
        sorted_rows.withColumn(PART, F.lit(SNAPSHOT)).write.partitionBy(PART).parquet(folder)

    folders.swap_files(spark, path, names, write, PART, step)
    return len(changes)


def named_people(current_rows: DataFrame) -> DataFrame:
    """Directory rows whose missing person id is the account hash."""
    person = F.when(F.length("person_id") > 0, F.col("person_id")).otherwise(F.col("account_hash"))
    return current_rows.withColumn("person_id", person)


def directory_upsert(history: DataFrame) -> DataFrame:
    """Latest directory row per (org, account) of a history; a missing person id is the account hash."""
    return named_people(replace_dimension(history))


def directory_resolve(directory: DataFrame, org: str, hashes: DataFrame | Sequence[str]) -> DataFrame:
    """Persons behind account hashes of one organization; unknown hashes are left out.

    A list is a request and limited in length; a frame with ``account_hash`` may
    have any size and is joined.
    """
    people = directory.where(F.col("org_id") == F.lit(org)).select(
        "account_hash", "person_id", "display_name", "email"
    )
    if isinstance(hashes, DataFrame):
        return people.join(hashes.select("account_hash"), "account_hash", "left_semi")
    if len(hashes) > fx.IDENTITY_REQUEST_LIMIT:
        raise ValueError(f"too many hashes (max {fx.IDENTITY_REQUEST_LIMIT})")
    return people.where(F.col("account_hash").isin(*hashes) if hashes else F.lit(False))


def membership_assign(history: DataFrame, records: DataFrame, updated_at) -> DataFrame:
    """Append (org_id, account_hash, team) upserts with one version."""
    stamped = records.select(
        "org_id", "account_hash", "team", F.lit(updated_at).cast("timestamp").alias("updated_at")
    )
    return history.unionByName(stamped)


def membership_list(rows: DataFrame, org: str, latest: bool = False) -> DataFrame:
    """Current (account_hash, team) of one organization; ``latest`` says that ``rows`` has one row per account."""
    own = rows.where(F.col("org_id") == F.lit(org))
    return (own if latest else replace_dimension(own)).select("account_hash", "team")
