"""Snapshot reads over a versioned log.

``max_by`` of the version in one aggregate: partial sums in each task, one
shuffle on user_key, none if the rows are laid out by it. Key ranges and the
read timestamp are filtered below it and reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.plans.model import UNBOUNDED, Bound, within

KEYS = ("user_key", "ts")


def as_of(log: DataFrame, ts: int | None = None) -> DataFrame:
    return log if ts is None else log.where(F.col("ts") <= ts)


def newest(log: DataFrame, ts: int | None = None) -> DataFrame:
    """The newest version at or before ``ts`` of each key, deletions too."""
    best = F.max(F.struct("ts", "value")).alias("v")
    return as_of(log, ts).groupBy("user_key").agg(best).select("user_key", "v.ts", "v.value")


def visible(log: DataFrame, ts: int | None = None) -> DataFrame:
    """Live keys at ``ts``; deletions are dropped after the version is chosen."""
    return newest(log, ts).where("value is not null")


def snapshot_scan(log: DataFrame, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED, ts: int | None = None) -> DataFrame:
    return visible(log.where(within(F.col("user_key"), lo, hi)), ts)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of a cursor: keys ascending, versions from the newest."""
    return rows.orderBy("user_key", F.desc("ts"))


def prefix_scan(log: DataFrame, prefix: str, ts: int | None = None) -> DataFrame:
    return visible(log.where(F.col("user_key").startswith(prefix)), ts)


def point_get(log: DataFrame, key: str, ts: int | None = None) -> DataFrame:
    """The live version of a key as at most one row."""
    return visible(log.where(F.col("user_key") == key), ts)


def multi_get(log: DataFrame, keys: DataFrame, ts: int | None = None) -> DataFrame:
    """(user_key, value) for each row of ``keys``, null where nothing lives: one job for any number of keys."""
    wanted = keys.select("user_key")
    found = visible(log.join(wanted.distinct(), "user_key", "left_semi"), ts)
    return wanted.join(found.select("user_key", "value"), "user_key", "left")


def exact_version(log: DataFrame, key: str, ts: int) -> DataFrame:
    return log.where((F.col("user_key") == key) & (F.col("ts") == ts))


def collect_garbage(log: DataFrame, watermark: int, bottom: bool = True, prefix: str | None = None) -> DataFrame:
    """Versions that a reader at or after ``watermark`` can need.

    Of versions at or below it the newest stays, unless it is a deletion, the
    newest of all, and the output is the bottom; or its key has the filtered
    prefix. The newest is a maximum, summed up in each task first, so a key with
    many versions is no task's burden; versions above the watermark aren't moved.
    """
    old = F.col("ts") <= watermark
    latest = log.groupBy("user_key").agg(F.max(F.when(old, F.struct("ts", "value"))).alias("v"), F.max("ts").alias("last"))
    keep = F.col("v").isNotNull()
    if bottom:
        keep &= ~((F.col("v.ts") == F.col("last")) & F.col("v.value").isNull())
    if prefix is not None:
        keep &= ~F.col("user_key").startswith(prefix)
    return log.where(~old).select("user_key", "ts", "value").unionByName(latest.where(keep).select("user_key", "v.ts", "v.value"))


def last_write_wins(batch: DataFrame) -> DataFrame:
    """One row (user_key, value) for each key of a batch (seq, op, user_key, value): its last record's."""
    last = batch.groupBy("user_key").agg(F.max(F.struct("seq", F.when((F.col("op") != 0) & (F.col("value") != ""), F.col("value")).alias("value"))).alias("v"))
    return last.select("user_key", "v.value")


def row_bytes() -> Column:
    """Accounted size of a version: key, 8 for the timestamp, value."""
    return (F.octet_length("user_key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")
