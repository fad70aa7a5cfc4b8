"""The data model: a log of (user_key, ts, value), where a null value marks a deletion.

Keys are ordered by bytes, versions of a key from the newest. ``''`` is a
deletion too and becomes null at ingest. Keys are never empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = "user_key string not null, ts bigint not null, value string"
RUN_LOG = LOG + ", level string, run_id bigint, src_idx int"
PUT, DELETE = 1, 0


@dataclass(frozen=True)
class Bound:
    """An end of a key range: ``unbounded``, ``included`` or ``excluded``."""

    kind: str = "unbounded"
    key: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("unbounded", "included", "excluded") or (self.kind == "unbounded") != (self.key is None):
            raise ValueError(f"no such bound: {self.kind} {self.key!r}")

    def lower(self, column: Column) -> Column:
        return F.lit(True) if self.key is None else column >= self.key if self.kind == "included" else column > self.key

    def upper(self, column: Column) -> Column:
        return F.lit(True) if self.key is None else column <= self.key if self.kind == "included" else column < self.key


UNBOUNDED = Bound()


def included(key: str) -> Bound:
    return Bound("included", key)


def excluded(key: str) -> Bound:
    return Bound("excluded", key)


def within(column: Column, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED) -> Column:
    """Whether a key is in the range; reaches the Parquet scan as a pushed filter."""
    return lo.lower(column) & hi.upper(column)


def from_internal(key: str, ts: int) -> Column:
    """Whether a row is at or after an internal position (key, ts) in log order."""
    return (F.col("user_key") > key) | ((F.col("user_key") == key) & (F.col("ts") <= ts))


def overlaps(first: Column, last: Column, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED) -> Column:
    """Whether a run of keys first..last can hold keys of the range."""
    return lo.lower(last) & hi.upper(first)


def key_within(first: Column, last: Column, key: Column | str) -> Column:
    key = key if isinstance(key, Column) else F.lit(key)
    return (first <= key) & (key <= last)


def normalised(rows: DataFrame) -> DataFrame:
    """The log's columns, with ``''`` as a deletion; rows without a key are refused when they are read."""
    key = F.when(F.length("user_key") > 0, F.col("user_key")).otherwise(F.raise_error(F.lit("a key must not be empty")))
    return rows.select(key.cast("string").alias("user_key"), F.col("ts").cast("long").alias("ts"), F.nullif(F.col("value").cast("string"), F.lit("")).alias("value"))
