"""Dropping, or fetching, rows by key without shuffling what stays.

A bitmap of fixed size, broadcast, tells which rows can have a key of a set.
Rows it rules out stay where they are. Of the rest the keys alone are shuffled
and compared; rows that only share a bit with the set are fetched by a bitmap of
theirs and an exact join. Full bitmaps cost a shuffle of the rows, no result.

Case handling: a key is one column or more, and nulls in it are values; rows of
equal keys, repeated rows too, are dropped or fetched together; repeated keys of
the set are one; an empty set drops nothing, empty rows stay empty; the rows'
other columns come through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import stored

#: Bits of the bitmap: at most BITS / 64 broadcast rows of 16 bytes, 4 MB.
BITS = 1 << 24


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(row, maybe) of the rows: whether the key can be among the keys."""
    bit = F.xxhash64(*keys.columns).bitwiseAND(F.lit(BITS - 1))
    words = keys.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    known = rows.select(F.struct(*rows.columns).alias("row"), bit.alias("bit")).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(words), "word", "left")
    return known.select("row", F.coalesce(F.expr("shiftright(bits, cast(bit & 63 as int)) & 1 = 1"), F.lit(False)).alias("maybe"))


def _same(columns: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"row.{c}").eqNullSafe(F.col(f"key.{c}")) for c in columns))


def fetched(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose values in the keys' columns are among the keys."""
    wanted = keys.distinct().select(F.struct(*keys.columns).alias("key"))
    return _marked(rows, keys).where("maybe").join(wanted, _same(keys.columns), "left_semi").select("row.*")


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose values in the keys' columns aren't among the keys."""
    keys = stored(keys.distinct(), "keys")
    sure = _marked(rows, keys).where("not maybe").select("row.*")
    maybe = _marked(rows.select(keys.columns), keys).where("maybe").distinct()
    shared = stored(maybe.join(keys.select(F.struct(*keys.columns).alias("key")), _same(keys.columns), "left_anti").select("row.*"), "shared")
    return sure.unionByName(fetched(rows, shared))
