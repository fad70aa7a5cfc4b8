"""Merging sorted inputs: k ways with precedence, overlay on base, chains of disjoint runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.mvcc import KEYS, visible
from tidelog.plans.model import UNBOUNDED, Bound, within


def tagged(inputs: list[DataFrame]) -> DataFrame:
    """All inputs with ``src_idx``, their place in order of precedence."""
    return reduce(DataFrame.unionByName, (x.withColumn("src_idx", F.lit(i)) for i, x in enumerate(inputs)))


def merge_tagged(rows: DataFrame) -> DataFrame:
    """One row for each (user_key, ts): that of the least src_idx. A partial aggregate, no sort of values."""
    return rows.groupBy(*KEYS).agg(F.min_by("value", "src_idx").alias("value"), F.min("src_idx").alias("src_idx"))


def merge(inputs: list[DataFrame]) -> DataFrame:
    return merge_tagged(tagged(inputs)).drop("src_idx")


def merge_two(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both inputs; where they share (user_key, ts), the first's row."""
    return first.unionByName(second.join(first.select(*KEYS), list(KEYS), "left_anti"))


def concat(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)


def overlap_errors(zones: DataFrame) -> DataFrame:
    """Runs of a level (level, run_id, first_key, last_key) that overlap the one before, or end before they begin."""
    before = F.lag("last_key").over(Window.partitionBy("level").orderBy("first_key", "run_id"))
    return zones.withColumn("before", before).where("first_key > last_key or before >= first_key").drop("before")


def overlay_scan(local: DataFrame, log: DataFrame, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED, ts: int | None = None) -> DataFrame:
    """(user_key, value): a transaction's own writes over the snapshot, deletions hiding it."""
    own = local.where(within(F.col("user_key"), lo, hi)).select("user_key", "value")
    below = visible(log.where(within(F.col("user_key"), lo, hi)), ts).select("user_key", "value")
    return own.unionByName(below.join(own.select("user_key"), "user_key", "left_anti")).where("value is not null")


def overlay_scan_unresolved(local: DataFrame, log: DataFrame, ts: int | None = None) -> DataFrame:
    """Both sides' rows, local deletions only dropped: the regression fixture of a scan that doesn't override."""
    return local.where("value is not null").select("user_key", "value").unionByName(visible(log, ts).select("user_key", "value"))


def overlay_get(local: DataFrame, log: DataFrame, keys: DataFrame, ts: int | None = None) -> DataFrame:
    """(user_key, value) of each wanted key, own writes first; null where it is deleted or absent."""
    wanted = keys.select("user_key")
    own = local.select("user_key", F.col("value").alias("own"), F.lit(True).alias("written"))
    stored = visible(log.join(wanted.distinct(), "user_key", "left_semi"), ts).select("user_key", F.col("value").alias("stored"))
    return wanted.join(own, "user_key", "left").join(stored, "user_key", "left").select("user_key", F.when(F.col("written"), F.col("own")).otherwise(F.col("stored")).alias("value"))
