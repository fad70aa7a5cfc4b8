"""Hand-made log: reads, bounds, garbage collection, merges and overlays."""

import random
from itertools import product

import pytest

from tidelog.functions.hashes import crc32c, crc32c_of, fingerprint32, fingerprint_of
from tidelog.operators import merge, mvcc, pruning
from tidelog.plans.model import LOG, UNBOUNDED, Bound, excluded, included, normalised

ROWS = [("a", 1, "1"), ("a", 4, "2"), ("b", 2, "x"), ("b", 5, None), ("c", 3, "y"), ("d", 6, "z"), ("d", 7, None), ("d", 8, "w")]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, LOG)


def pairs(df):
    return {r.user_key: r.value for r in df.collect()}


def versions(df):
    return {f"{r.user_key}@{r.ts}" for r in df.collect()}


def test_gets(log):
    for key, ts, want in (("a", None, {"a": "2"}), ("b", None, {}), ("c", None, {"c": "y"}), ("d", None, {"d": "w"}), ("a", 3, {"a": "1"}), ("b", 4, {"b": "x"}), ("d", 7, {}), ("q", None, {})):
        assert pairs(mvcc.point_get(log, key, ts)) == want
    assert mvcc.exact_version(log, "d", 6).first().value == "z"


def test_scans(log):
    assert pairs(mvcc.snapshot_scan(log, ts=3)) == {"a": "1", "b": "x", "c": "y"}
    for lo, hi, want in ((included("a"), included("c"), "ac"), (excluded("a"), included("c"), "c"), (included("a"), excluded("c"), "a"), (excluded("a"), excluded("c"), ""), (included("e"), UNBOUNDED, "")):
        assert "".join(sorted(pairs(mvcc.snapshot_scan(log, lo, hi)))) == want
    assert pairs(mvcc.prefix_scan(log, "d")) == {"d": "w"}
    assert [r.user_key for r in mvcc.ordered(mvcc.visible(log)).collect()] == ["a", "c", "d"]


def test_multi_get(log, spark):
    keys = spark.createDataFrame([("a",), ("b",), ("nobody",)], "user_key string")
    assert pairs(mvcc.multi_get(log, keys)) == {"a": "2", "b": None, "nobody": None}


@pytest.mark.parametrize(
    ("watermark", "bottom", "prefix", "want"),
    [(5, True, None, "a@4 c@3 d@8 d@7 d@6"), (5, False, None, "a@4 b@5 c@3 d@8 d@7 d@6"), (7, True, None, "a@4 c@3 d@8 d@7"), (7, True, "a", "c@3 d@8 d@7")],
)
def test_garbage(log, watermark, bottom, prefix, want):
    assert versions(mvcc.collect_garbage(log, watermark, bottom, prefix)) == set(want.split())


def test_garbage_keeps_snapshots(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(6)}", ts, rng.choice(["v", "w", None])) for ts in range(1, 80)]
    log = spark.createDataFrame(rows, LOG)
    kept = mvcc.collect_garbage(log, 40)
    for ts in (40, 55, 79):
        assert pairs(mvcc.visible(kept, ts)) == pairs(mvcc.visible(log, ts))


def test_overlays(log, spark):
    local = spark.createDataFrame([("a", "9"), ("c", None), ("e", "5")], "user_key string, value string")
    assert pairs(merge.overlay_scan(local, log)) == {"a": "9", "d": "w", "e": "5"}
    assert sorted((r.user_key, r.value) for r in merge.overlay_scan_unresolved(local, log).collect()) == [("a", "2"), ("a", "9"), ("c", "y"), ("d", "w"), ("e", "5")]
    wanted = spark.createDataFrame([("a",), ("c",), ("d",), ("q",)], "user_key string")
    assert pairs(merge.overlay_get(local, log, wanted)) == {"a": "9", "c": None, "d": "w", "q": None}


def test_merges(spark):
    first = spark.createDataFrame([("a", 1, "new"), ("b", 2, "b")], LOG)
    second = spark.createDataFrame([("a", 1, "old"), ("a", 0, "older")], LOG)
    want = {("a", 1, "new"), ("b", 2, "b"), ("a", 0, "older")}
    assert {tuple(r) for r in merge.merge([first, second]).collect()} == want
    assert {tuple(r) for r in merge.merge_two(first, second).collect()} == want
    zones = pruning.zone_map(first.withColumnsRenamed({}).selectExpr("*", "1 as run_id", "'L1' as level").unionByName(second.selectExpr("*", "2 as run_id", "'L1' as level")), "level", "run_id")
    assert merge.overlap_errors(zones).count() == 1


def test_batch(spark):
    batch = spark.createDataFrame([(0, 1, "k", "1"), (1, 0, "k", None), (2, 1, "k", "2"), (3, 1, "e", ""), (0, 1, "gone", "x"), (1, 0, "gone", "x")], "seq bigint, op int, user_key string, value string")
    assert pairs(mvcc.last_write_wins(batch)) == {"k": "2", "e": None, "gone": None}


def test_ingest(spark):
    rows = spark.createDataFrame([("a", 1, "")], "user_key string, ts int, value string")
    assert normalised(rows).first().value is None
    with pytest.raises(Exception, match="must not be empty"):
        normalised(spark.createDataFrame([("", 1, "x")], "user_key string, ts int, value string")).collect()
    with pytest.raises(ValueError):
        Bound("included")


def test_golden_vectors(spark):
    prints = {"": 0, "a": 938421039, "ab": 858384071, "abc": 1247626862, "key1": 2553204862, "key_0": 283403779, "key_12345": 3466383164, "key_0123456789ABCDEF": 589328291}
    more = ["é", "éé", "日本", "x" * 100, "ÿ" * 7]
    df = spark.createDataFrame([(k,) for k in [*prints, *more]], "k string")
    got = {r.k: r.f for r in df.select("k", fingerprint32("k").alias("f")).collect()}
    assert got == prints | {k: fingerprint_of(k.encode()) for k in more}
    sums = {"": 0, "a": 2477592673, "key1": 104638944, "123456789": 1491335712}
    assert {k: crc32c_of(k.encode()) for k in sums} == sums
    sums |= {k: crc32c_of(k.encode()) for k in more}
    df = spark.createDataFrame([(k,) for k in sums], "k string")
    assert {r.k: r.c for r in df.select("k", crc32c("k").alias("c")).collect()} == sums


def test_bloom(spark):
    assert pruning.bits_per_key(0.01) == 10 and pruning.bloom_shape(5, 10) == (6, 64)
    keys = spark.createDataFrame([(1, f"key_{i}") for i in range(5)], "run_id long, user_key string")
    bits = pruning.bloom_bits(keys)
    assert sum(1 << r.bit for r in bits.collect()).to_bytes(8, "little").hex() == "1c8a8986ba4860be"
    assert pruning.bloom_probe(bits, keys).count() == 5
    packed = pruning.bloom_bytes(bits)
    assert packed.first().filter.hex() == "1c8a8986ba4860be06"
    assert sorted(map(tuple, pruning.bloom_from_bytes(packed).collect())) == sorted(map(tuple, bits.select("run_id", "k", "nbits", "bit").collect()))
    plan = pruning.bloom_probe(bits, keys)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_block_lookup(spark):
    """Keys that all begin alike are dealt to several tasks; the order holds over their borders."""
    rng = random.Random(4)
    starts = sorted({f"key{rng.randrange(5000):05d}" for _ in range(200)})
    probes = {f"key{rng.randrange(5200):05d}" for _ in range(1500)} | {"a", "z", *starts[:20]}
    blocks = spark.createDataFrame([(k, i + 7) for i, k in enumerate(starts)], "first_key string, block long")
    found = pruning.block_of(spark.createDataFrame([(k,) for k in probes], "user_key string").repartition(3), blocks)
    want = {k: max((i + 7 for i, s in enumerate(starts) if s <= k), default=0) for k in probes}
    assert {r.user_key: r.block for r in found.collect()} == want
    assert pruning.block_of(spark.createDataFrame([("b",)], "user_key string"), blocks.limit(0)).first().block == 0


def test_block_size(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(pruning.block_estimate(100, 3), pruning.entry_bytes(F.lit("key12"), F.lit(3), F.lit("value")), pruning.fits(F.lit(4000), F.lit(90), 4096), pruning.fits(F.lit(4000), F.lit(91), 4096), pruning.fits(F.lit(2), F.lit(9999), 4096)).first()
    assert tuple(row) == (108, 21, True, False, True)


def test_garbage_of_a_hot_key(spark):
    """A key with most versions isn't sorted in one task: its newest is a maximum."""
    rows = [("hot", ts, str(ts)) for ts in range(1, 400)] + [("cold", 5, None), ("late", 390, "x")]
    kept = mvcc.collect_garbage(spark.createDataFrame(rows, LOG), 395)
    assert versions(kept) == {"hot@395", "hot@396", "hot@397", "hot@398", "hot@399", "late@390"}
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()


def test_plan_pushes_filters(spark, tmp_path, log):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    log.write.parquet(str(tmp_path / "log"))
    plan = mvcc.snapshot_scan(spark.read.parquet(str(tmp_path / "log")), included("a"), excluded("c"), 3)._jdf.queryExecution().executedPlan().toString()
    assert all(x in plan for x in ("GreaterThanOrEqual(user_key,a)", "LessThan(user_key,c)", "LessThanOrEqual(ts,3)"))


def test_nine_bounds(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(9)}", ts, rng.choice(["v", None])) for ts in range(1, 60)]
    log = spark.createDataFrame(rows, LOG)
    live = {}
    for k, _, v in rows:
        live[k] = v
    tests = {"included": (lambda k, b: k >= b, lambda k, b: k <= b), "excluded": (lambda k, b: k > b, lambda k, b: k < b), "unbounded": (lambda k, b: True, lambda k, b: True)}
    for lo, hi in product(tests, tests):
        got = pairs(mvcc.snapshot_scan(log, Bound(lo, "k2" if lo != "unbounded" else None), Bound(hi, "k6" if hi != "unbounded" else None)))
        assert got == {k: v for k, v in live.items() if v and tests[lo][0](k, "k2") and tests[hi][1](k, "k6")}
