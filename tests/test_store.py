"""Store, transactions, recovery, policies and streaming ingest."""

import random
import time
from pathlib import Path

import pytest

from tidelog.operators.compaction import MIB, Layout, Leveled, NoCompaction, Run, SimpleLeveled, Tiered
from tidelog.plans.model import included
from tidelog.sources.store import Options, Store, TransactionClosed
from tidelog.streaming.ingest import ingest, newest_versions


def live(store, ts=None):
    return {r.user_key: r.value for r in store.scan(ts=ts).collect()}


@pytest.mark.parametrize("compaction", [Leveled(level0_file_num_compaction_trigger=2), SimpleLeveled(), Tiered(num_tiers=2)])
def test_model(spark, tmp_path, compaction):
    """Random batches with flushes, compactions and a reopening against a dict of histories."""
    rng = random.Random(5)
    options = Options(target_run_bytes=60, num_memtable_limit=2, compaction=compaction, checkpoint_every=5)
    store = Store.open(spark, (tmp_path / "s").as_uri(), options)
    state, history = {}, [{}]
    for step in range(8):
        records = [(rng.choice([0, 1, 1]), f"k{rng.randrange(5)}", str(rng.random())) for _ in range(3)]
        assert store.write_batch(records) == step + 1
        for op, k, v in records:
            state.pop(k, None)
            if op:
                state[k] = v
        history.append(dict(state))
        if step == 4:
            reader = store.new_txn()
        if step % 2:
            store.trigger_flush()
            store.compact()
    assert live(store) == state and live(store, 6) == history[6]
    store.close()
    store.compact(full=True)
    assert {r.user_key: r.value for r in reader.scan().collect()} == history[5]
    assert live(store) == state and live(store, 5) == history[5]
    reader.rollback()
    again = Store.open(spark, (tmp_path / "s").as_uri(), options)
    assert live(again) == state and again.state.latest == 8
    assert again.get("k1") == state.get("k1")
    assert again.vacuum(0) and live(again) == state
    assert live(Store.open(spark, (tmp_path / "s").as_uri(), options)) == state
    assert [r.user_key for r in again.cursor(included("k1"))] == sorted(k for k in state if k >= "k1")


def test_transactions(spark, tmp_path):
    store = Store.open(spark, (tmp_path / "t").as_uri(), Options(serializable=True))
    store.write_batch([(1, "key1", "val1")])
    first, second = store.new_txn(), store.new_txn()
    assert first.get("key1") == "val1"
    first.put("key1", "val2")
    second.put("key1", "val12")
    assert second.commit() and not first.commit() and not first.commit()
    assert store.get("key1") == "val12"
    with pytest.raises(TransactionClosed):
        second.get("key1")
    blind, other = store.new_txn(), store.new_txn()
    blind.put("key1", "a")
    other.put("key1", "b")
    assert blind.commit() and other.commit() and store.get("key1") == "b"
    reads, writes = store.new_txn(), store.new_txn()
    reads.get("key1")
    writes.put("key1", "c")
    before = store.state.latest
    assert writes.commit() and reads.commit() and store.state.latest == before + 2
    scan = store.new_txn()
    scan.put("key2", "x")
    scan.delete("key1")
    assert {r.user_key: r.value for r in scan.scan().collect()} == {"key2": "x"}
    first.rollback()
    scan.rollback()
    assert store.retained_snapshots() == 0


def test_watermark(spark, tmp_path):
    store = Store.open(spark, (tmp_path / "w").as_uri())
    store.readers += [3, 3, 7]
    assert store.watermark() == 3 and store.retained_snapshots() == 2
    store.readers.remove(3)
    assert store.watermark() == 3
    store.readers.remove(3)
    assert store.watermark() == 7


def test_prefix_filter(spark, tmp_path):
    store = Store.open(spark, (tmp_path / "p").as_uri())
    store.write_batch([(1, "a1", "x"), (1, "b1", "y"), (1, "", "z")][:2])
    store.close()
    store.add_filter("a")
    assert store.compact(full=True) and live(store) == {"b1": "y"}


def test_leveled_targets():
    policy = Leveled(level_size_multiplier=2, base_level_size_mb=4)
    assert policy.targets([0, 0, 0, 0, 3 * MIB]) == ([0, 0, 0, 0, 4 * MIB], 5)
    assert policy.targets([0, 0, 0, 0, 20 * MIB]) == ([0, 5 * MIB // 2, 5 * MIB, 10 * MIB, 20 * MIB], 2)


def test_leveled_pick():
    runs = {i: Run(i, f"k{i}", f"k{i}z", 9 * MIB) for i in range(6)}
    task = Leveled().pick(Layout(l0=(3, 2, 1), levels=((), (), (), (), (0,))), runs)
    assert (task.upper, task.lower_level, task.lower) == ((3, 2, 1), 3, ())  # targets 9, 4.5 and 2.25 MiB upwards, then none
    after = Leveled.apply(Layout(l0=(4, 3), levels=((0,), ())), type(task)(0, (3,), 1, (0,), True), [Run(5, "a", "b", 1)], runs)
    assert after.l0 == (4,) and after.levels == ((5,), ())
    assert Leveled().pick(Layout(levels=((), (), (), (), (0,))), runs) is None


def test_simple_and_tiered_pick():
    assert SimpleLeveled(size_ratio_percent=200).pick(Layout(l0=(1, 2), levels=((), (), ())), {}).lower_level == 1
    assert SimpleLeveled(size_ratio_percent=200).pick(Layout(l0=(1,), levels=((), (), ())), {}) is None
    tiers = lambda *n: Layout(tiers=tuple((i, tuple(range(10 * i, 10 * i + k))) for i, k in enumerate(n)))
    assert Tiered().pick(tiers(1, 1), {}) is None
    assert len(Tiered().pick(tiers(1, 1, 1), {}).upper) == 3  # twice the last tier stands above it
    assert Tiered(max_size_amplification_percent=900).pick(tiers(1, 1, 4), {}).upper == (0, 10)
    after = Tiered().apply(tiers(1, 1, 4), Tiered(max_size_amplification_percent=900).pick(tiers(1, 1, 4), {}), [Run(99, "a", "b", 1)], {})
    assert [files for _, files in after.tiers] == [(99,), (20, 21, 22, 23)]
    with pytest.raises(ValueError):
        NoCompaction().apply(Layout(), None, [], {})


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1, f"k{i % 3}", str(i)) for i in range(9)], "seq bigint, op int, user_key string, value string")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    store = Store.open(spark, (tmp_path / "s").as_uri())
    for _ in range(2):
        ingest(stream, store, str(tmp_path / "c")).awaitTermination()
    assert live(store) == {"k0": "6", "k1": "7", "k2": "8"} and store.state.latest == 1


def test_checkpoints(spark, tmp_path):
    """Opening reads the last checkpoint and the records after it; older records may be gone."""
    options = Options(checkpoint_every=3)
    store = Store.open(spark, (tmp_path / "c").as_uri(), options)
    for i in range(5):
        store.write_batch([(1, f"k{i}", str(i)), (1, "all", str(i))])
    store.freeze()
    store.flush()
    store.write_batch([(0, "k0", None)])
    assert store.folder.names("checkpoints") == ["0000000003.json", "0000000006.json"] and store.state.version == 8
    again = Store.open(spark, store.folder.root, options)
    assert again.state == store.state
    gone = again.vacuum(0)
    assert {f"manifest/{v:010d}.json" for v in range(1, 7)} <= set(gone) and "checkpoints/0000000003.json" in gone
    last = Store.open(spark, store.folder.root, options)
    assert last.state == store.state and live(last) == {"k1": "1", "k2": "2", "k3": "3", "k4": "4", "all": "4"}
    assert set(last.state.paths) == {*last.state.runs, *last.state.open}


def test_vacuum_keeps_what_is_new(spark, tmp_path):
    store = Store.open(spark, (tmp_path / "v").as_uri())
    store.write_batch([(1, "a", "1")])
    store.close()
    assert store.vacuum() == [] and len(store.vacuum(0)) == 1


def test_split_at_keys(spark, tmp_path):
    store = Store.open(spark, (tmp_path / "x").as_uri(), Options(target_run_bytes=400))
    for ts in range(3):
        store.write_batch([(1, f"key{i:03d}", "v" * 10) for i in range(60)])
        store.freeze()
        store.flush()
    assert store.new_txn().read_ts == 3 and len(store.state.layout.l0) > 3
    store.readers[:] = [1]
    store.compact(full=True)
    runs = sorted(store.state.runs.values(), key=lambda r: r.first_key)
    assert len(runs) > 4 and all(a.last_key < b.first_key for a, b in zip(runs, runs[1:])) and sum(r.n_rows for r in runs) == 180
    assert [store.state.runs[i] for i in store.state.layout.levels[0]] == runs
    assert len(store.surviving(included("key030"), included("key030"))) == 1
    assert store.run_scan(runs[0].run_id, included(runs[0].first_key)).count() == runs[0].n_rows


def test_damaged_page(spark, tmp_path):
    store = Store.open(spark, (tmp_path / "d").as_uri(), Options(block_size=1024))
    store.write_batch([(1, f"key{i:05d}", f"value {i}") for i in range(3000)])
    store.close()
    assert store.scan().count() == 3000
    file = next(Path(tmp_path / "d" / "runs").rglob("*.parquet"))
    whole, rows = file.read_bytes(), store.versions().collect()
    file.with_name(f".{file.name}.crc").unlink()
    for at in range(100, len(whole), 97):  # till the page can be decoded, to other rows
        file.write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        try:
            if sorted(spark.read.parquet(str(file)).collect()) != sorted(rows):
                break
        except Exception:
            continue
    else:
        raise AssertionError("no damage that decodes")
    cursor = store.cursor()
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        list(cursor)
    assert store.num_active_cursors() == 0
    with pytest.raises(RuntimeError, match="has failed"):
        next(cursor)


def test_cursors(spark, tmp_path):
    store = Store.open(spark, (tmp_path / "n").as_uri())
    store.write_batch([(1, "a", "1"), (1, "b", "2")])
    one, two = store.cursor(), store.cursor()
    assert store.num_active_cursors() == 2 and next(one).user_key == "a" and store.vacuum(0) == []
    assert [r.user_key for r in two] == ["a", "b"] and store.num_active_cursors() == 1
    one.close()
    assert store.num_active_cursors() == 0 and list(one) == []


def test_own_writes(spark, tmp_path):
    store = Store.open(spark, (tmp_path / "o").as_uri(), Options(serializable=True))
    store.write_batch([(1, "b", "stored")])
    txn = store.new_txn()
    txn.write([(1, "c", "3"), (0, "a", None), (1, "d", "4")])
    assert [tuple(r) for r in txn.scan_out().collect()] == [("a", None), ("c", "3"), ("d", "4")]
    assert [r.user_key for r in txn.scan_out(included("c"), included("c")).collect()] == ["c"] and not txn.read_keys and not txn.read_sets
    assert txn.commit()
    with pytest.raises(TransactionClosed):
        txn.scan_out()


def test_without_log(spark, tmp_path):
    options = Options(enable_wal=False)
    store = Store.open(spark, (tmp_path / "w").as_uri(), options)
    store.write_batch([(1, "a", "1")])
    store.freeze()
    store.flush()
    store.write_batch([(1, "b", "2")])
    assert live(store) == {"a": "1", "b": "2"} and store.sync() == 1
    again = Store.open(spark, store.folder.root, options)
    assert live(again) == {"a": "1"} and again.state.latest == 1
    assert again.write_batch([(1, "c", "3")]) == 2
    again.close()
    assert live(Store.open(spark, store.folder.root)) == {"a": "1", "c": "3"}


def test_streamed_batch_counts_once(spark, tmp_path):
    """A crash between the commit and the stream's own mark, and a reopening: the batch is known by the manifest."""
    store = Store.open(spark, (tmp_path / "s").as_uri(), Options(checkpoint_every=2))
    assert store.write_batch([(1, "a", "1")], "stream", 0) == 1 and store.write_batch([(1, "a", "again")], "stream", 0) == 1
    again = Store.open(spark, store.folder.root, store.options)
    assert again.write_batch([(1, "a", "again")], "stream", 0) == 1 and live(again) == {"a": "1"}
    assert again.write_batch([(1, "a", "2")], "stream", 1) == 2 and again.write_batch([(1, "b", "3")], "other", 0) == 3
    assert Store.open(spark, store.folder.root, store.options).state.streams == {"stream": 1, "other": 0}


def test_maintenance_on_a_clock(spark, tmp_path):
    store = Store.open(spark, (tmp_path / "m").as_uri(), Options(target_run_bytes=1, num_memtable_limit=2, compaction=Leveled(level0_file_num_compaction_trigger=2)))
    store.start_maintenance(0.01)
    for i in range(4):
        store.write_batch([(1, f"k{i}", str(i))])
    until = time.time() + 60
    while time.time() < until and (store.state.frozen or not any(store.state.layout.levels)):
        time.sleep(0.1)
    store.close()
    assert store.failure is None and any(store.state.layout.levels) and live(store) == {f"k{i}": str(i) for i in range(4)}


def test_newest_versions(spark, tmp_path):
    rows = [(f"k{i % 3}", i, str(i)) for i in range(9)]
    for part in range(3):
        spark.createDataFrame(rows[3 * part : 3 * part + 3], "user_key string, ts bigint, value string").repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_key string, ts bigint, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = newest_versions(stream, (tmp_path / "work").as_uri())
    assert {(r.user_key, r.ts) for r in got.collect()} == {("k0", 6), ("k1", 7), ("k2", 8)}
    assert len(list((tmp_path / "work" / "changes").iterdir())) == 3
