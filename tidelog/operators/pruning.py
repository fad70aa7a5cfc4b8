"""Zone maps and Bloom filters: which runs and blocks a read can skip."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.hashes import fingerprint32
from tidelog.operators.mvcc import row_bytes
from tidelog.plans.model import UNBOUNDED, Bound, key_within, overlaps


def zone_map(rows: DataFrame, *by: str) -> DataFrame:
    """First and last internal key, greatest ts, rows and bytes of each run."""
    place = F.struct("user_key", (-F.col("ts")).alias("back"))
    zones = rows.groupBy(*by).agg(F.min(place).alias("f"), F.max(place).alias("l"), F.max("ts").alias("max_ts"), F.count("*").alias("n_rows"), F.sum(row_bytes()).alias("bytes"))
    return zones.select(*by, F.col("f.user_key").alias("first_key"), (-F.col("f.back")).alias("first_ts"), F.col("l.user_key").alias("last_key"), (-F.col("l.back")).alias("last_ts"), "max_ts", "n_rows", "bytes")


def overlapping(zones: DataFrame, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED) -> DataFrame:
    return zones.where(overlaps(F.col("first_key"), F.col("last_key"), lo, hi))


def holding(zones: DataFrame, key: str) -> DataFrame:
    return zones.where(key_within(F.col("first_key"), F.col("last_key"), key))


def overlapping_runs(zones: DataFrame, chosen: Column, level: Column) -> DataFrame:
    """Runs of a level that overlap the hull of the chosen ones, by internal key. The hull is one row."""
    first, last = F.struct("first_key", (-F.col("first_ts")).alias("ts")), F.struct("last_key", (-F.col("last_ts")).alias("ts"))
    hull = zones.where(chosen).agg(F.min(first).alias("lo"), F.max(last).alias("hi"))
    below = zones.where(level).withColumns({"f": F.struct(F.col("first_key"), (-F.col("first_ts")).alias("ts")), "l": F.struct(F.col("last_key").alias("first_key"), (-F.col("last_ts")).alias("ts"))})
    hull = hull.select("lo", F.struct(F.col("hi.last_key").alias("first_key"), F.col("hi.ts").alias("ts")).alias("hi"))
    return below.join(F.broadcast(hull), (F.col("f") <= F.col("hi")) & (F.col("l") >= F.col("lo"))).select(*zones.columns)


def block_of(probes: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each probe (user_key) the last block (block, first_key) that starts at or before it, else block 0.

    Both sides are dealt to ranges of keys by one shuffle; in a range the last
    block's number runs along the order, and what runs over from the ranges
    before is one row a range. Equal keys, a block's first, are in one range.
    """
    both = blocks.select(F.col("first_key").alias("k"), "block", F.lit(0).alias("side")).unionByName(probes.select(F.col("user_key").alias("k"), F.lit(None).cast("long").alias("block"), F.lit(1).alias("side")))
    dealt = both.repartitionByRange("k").withColumn("part", F.spark_partition_id())
    order = Window.partitionBy("part").orderBy("k", "side")
    lasts = dealt.groupBy("part").agg(F.max_by("block", F.when(F.col("block").isNotNull(), F.struct("k", "side"))).alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = lasts.select("part", F.last("b", ignorenulls=True).over(before).alias("earlier"))
    found = dealt.withColumn("own", F.last("block", ignorenulls=True).over(order)).where("side = 1")
    return found.join(carried, "part").select(F.col("k").alias("user_key"), F.coalesce("own", "earlier", F.lit(0)).cast("long").alias("block"))


def block_estimate(entry_bytes: Column | int, n: Column | int) -> Column:
    """Size of a block of n entries: the entries, an offset of two bytes for each, their number."""
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return (of(entry_bytes) + 2 * of(n) + 2).cast("long")


def entry_bytes(key: Column, shared: Column, value: Column) -> Column:
    """Size of an entry whose key shares its first bytes with the block's first key."""
    return (6 + 8 + F.octet_length(key) - shared + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def fits(estimate: Column, entry: Column, block_size: int) -> Column:
    """Whether an entry may be added to a block; the first always may."""
    return (estimate + entry <= block_size - 6) | (estimate <= 2)


def bits_per_key(rate: float) -> int:
    return math.ceil(-math.log(rate) / math.log(2) ** 2)


def bloom_shape(n: int, per_key: int) -> tuple[int, int]:
    """Probes of a key and bits of a filter of n keys."""
    return min(max(int(per_key * 0.69), 1), 30), -(-max(n * per_key, 64) // 8) * 8


def probe_bits(hashed: Column, k: int, nbits: Column) -> Column:
    """The k bits of a hash."""
    turn = (F.shiftleft(hashed, 15).bitwiseOR(F.shiftright(hashed, 17))).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (hashed + i * turn).bitwiseAND(F.lit(0xFFFFFFFF)) % nbits)


def bloom_bits(keys: DataFrame, rate: float = 0.01) -> DataFrame:
    """(run_id, k, nbits, bit) of each run's distinct keys (run_id, user_key)."""
    per_key = bits_per_key(rate)
    k = bloom_shape(1, per_key)[0]
    sized = keys.groupBy("run_id").agg(F.count_distinct("user_key").alias("n")).withColumn("nbits", (F.ceil(F.greatest(F.col("n") * per_key, F.lit(64)) / 8) * 8).cast("long")).select("run_id", "nbits")
    hashed = keys.select("run_id", "user_key").distinct().withColumn("h", fingerprint32("user_key"))
    bits = hashed.join(sized, "run_id").select("run_id", F.lit(k).cast("int").alias("k"), "nbits", F.explode(probe_bits(F.col("h"), k, F.col("nbits"))).alias("bit"))
    return bits.distinct()


def bloom_bytes(bits: DataFrame) -> DataFrame:
    """(run_id, filter): each run's filter as bytes, bit i the i % 8th from the right of byte i / 8, and the number of probes as the last byte."""
    byte = F.expr("cast(bit div 8 as int)")
    held = bits.groupBy("run_id", byte.alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("byte"))
    every = bits.select("run_id", "k", "nbits").distinct().select("run_id", "k", F.explode(F.expr("sequence(0, cast(nbits div 8 as int) - 1)")).alias("at"))
    dense = every.join(held, ["run_id", "at"], "left").groupBy("run_id", "k").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("byte", F.lit(0)).alias("byte")))).alias("bytes"))
    digits = F.expr("array_join(transform(bytes, x -> lpad(hex(x.byte), 2, '0')), '')")
    return dense.select("run_id", F.unhex(F.concat(digits, F.lpad(F.hex("k"), 2, "0"))).alias("filter"))


def bloom_from_bytes(filters: DataFrame) -> DataFrame:
    """(run_id, k, nbits, bit) of filters as bytes, the inverse of ``bloom_bytes``."""
    sized = filters.select("run_id", "filter", (F.octet_length("filter") - 1).alias("n"))
    byte = "cast(conv(hex(substring(filter, i + 1, 1)), 16, 10) as int)"
    bits = F.expr(f"flatten(transform(sequence(0, n - 1), i -> transform(filter(sequence(0, 7), j -> (shiftright({byte}, j) & 1) = 1), j -> cast(8 * i + j as bigint))))")
    k = F.expr("cast(conv(hex(substring(filter, n + 1, 1)), 16, 10) as int)")
    return sized.select("run_id", k.alias("k"), (F.col("n") * 8).cast("long").alias("nbits"), F.explode(bits).alias("bit"))


def bloom_probe(bits: DataFrame, asked: DataFrame) -> DataFrame:
    """Those pairs (run_id, user_key) asked for that the run's filter can't rule out.

    Which runs a key is asked of is the zone maps' to say; each of a pair's
    probes is one row of an equi-join on (run_id, bit).
    """
    shape = bits.groupBy("run_id").agg(F.first("k").alias("k"), F.first("nbits").alias("nbits"))
    k = bloom_shape(1, bits_per_key(0.01))[0]
    hashed = asked.select("run_id", "user_key").distinct().withColumn("h", fingerprint32("user_key")).join(shape, "run_id")
    wanted = hashed.select("run_id", "user_key", F.array_distinct(probe_bits(F.col("h"), k, F.col("nbits"))).alias("probes"))
    probed = wanted.select("run_id", "user_key", F.size("probes").alias("need"), F.explode("probes").alias("bit"))
    hit = probed.join(bits.select("run_id", "bit"), ["run_id", "bit"]).groupBy("run_id", "user_key").agg(F.count("*").alias("hits"), F.max("need").alias("need"))
    return hit.where("hits = need").select("run_id", "user_key")
