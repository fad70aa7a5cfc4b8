"""A versioned key-value store on Parquet.

A commit writes its rows as one Parquet batch (the log) and then publishes the
next manifest record; without the record the batch doesn't exist, so a batch is
whole or absent, and a torn tail is never read. Batches form the open memory
run; frozen ones wait, newest first; a flush merges the oldest into runs of
sorted rows, cut at key borders near the target size, with Bloom filters on the
key. The manifest is folded on open: the last checkpoint record, of which one is
written every ``checkpoint_every`` records, and those after it.

Reads take the runs that zone maps leave, filter and merge them, and verify page
checksums: any number of keys is one job (``get_many``); ``get`` is for few.

Without the log (``enable_wal=False``) batches count in this process alone until
they are flushed. Readers of other processes keep the state that they opened;
``vacuum`` leaves what was changed within its retention to them.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import mvcc
from tidelog.operators.compaction import Layout, Leveled, NoCompaction, Run, Task, full_task, policy
from tidelog.operators.merge import overlay_scan
from tidelog.operators.pruning import zone_map
from tidelog.plans.model import DELETE, PUT, UNBOUNDED, Bound, within
from tidelog.sources.files import Folder

BATCH = "seq bigint, op int, user_key string, value string"
SCHEMA = "user_key string, ts bigint, value string"


class TransactionClosed(RuntimeError):
    """A committed transaction was used."""


class Conflict(RuntimeError):
    """A batch read what another had changed."""


@dataclass(frozen=True)
class Options:
    block_size: int = 1 << 20
    target_run_bytes: int = 1 << 20
    num_memtable_limit: int = 3
    compaction: NoCompaction | Leveled = field(default_factory=Leveled)
    enable_wal: bool = True
    serializable: bool = False
    bloom: bool = True
    file_rows: int = 5_000_000
    checkpoint_every: int = 50


@dataclass(frozen=True)
class State:
    """What a reader sees: batches of the open run and of frozen ones (newest first), and laid-out runs; the last batch of each stream."""

    version: int = 0
    latest: int = 0
    next_id: int = 1
    open: tuple[int, ...] = ()
    open_bytes: int = 0
    frozen: tuple[tuple[int, ...], ...] = ()
    layout: Layout = field(default_factory=Layout)
    runs: dict[int, Run] = field(default_factory=dict)
    paths: dict[int, str] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


def restored(saved: dict) -> State:
    """The state that a checkpoint record holds, as ``asdict`` gave it."""
    numbered = lambda d: {int(k): v for k, v in d.items()}
    layout = Layout(**{k: _tuples(v) for k, v in saved["layout"].items()})
    runs = {k: Run(**v) for k, v in numbered(saved["runs"]).items()}
    return State(**saved | {"open": _tuples(saved["open"]), "frozen": _tuples(saved["frozen"]), "layout": layout, "runs": runs, "paths": numbered(saved["paths"])})


def fold(state: State, record: dict, compaction) -> State:
    """The state after one manifest record."""
    kind = record["kind"]
    if kind == "batch":
        streams = state.streams | ({record["stream"]: record["number"]} if record.get("stream") else {})
        state = replace(state, open=(*state.open, record["id"]), open_bytes=state.open_bytes + record["bytes"], latest=max(state.latest, record["ts"]), next_id=max(state.next_id, record["id"] + 1), paths=state.paths | {record["id"]: record["path"]}, streams=streams)
    elif kind == "freeze":
        state = replace(state, open=(), open_bytes=0, frozen=(state.open, *state.frozen))
    elif kind in ("flush", "compaction"):
        output = [Run(**r) for r in record["output"]]
        named = {int(k): v for k, v in record["paths"].items()}
        new = state.runs | {r.run_id: r for r in output}
        if kind == "flush":
            ids = tuple(r.run_id for r in output)
            layout = state.layout
            if ids:
                layout = replace(layout, l0=(*ids, *layout.l0)) if compaction.flush_to_l0 else replace(layout, tiers=((ids[0], ids), *layout.tiers))
            state = replace(state, frozen=state.frozen[:-1], layout=layout, latest=max([state.latest, *(r.max_ts for r in output)]), streams=state.streams | record.get("streams", {}))
        else:
            task = Task(record["task"]["upper_level"], tuple(record["task"]["upper"]), record["task"]["lower_level"], tuple(record["task"]["lower"]), record["task"]["bottom"])
            gone = {*task.upper, *task.lower}
            state = replace(state, layout=compaction.apply(state.layout, task, output, state.runs))
            new = {i: r for i, r in new.items() if i not in gone}
        live = {*new, *state.open, *(b for group in state.frozen for b in group)}
        paths = {i: p for i, p in (state.paths | named).items() if i in live}
        state = replace(state, runs=new, paths=paths, next_id=max([state.next_id, *(r.run_id + 1 for r in output)]))
    return replace(state, version=record["version"])


class Cursor:
    """Rows in key order, fetched a partition at a time. An error ends it, and every later step raises it again."""

    def __init__(self, store: Store, rows: DataFrame):
        self._store, self._wanted, self._rows, self._error = store, rows, None, None
        store.cursors.add(self)

    def __iter__(self) -> Iterator[Row]:
        return self

    def __next__(self) -> Row:
        if self._error is not None:
            raise RuntimeError("the cursor has failed") from self._error
        try:
            if self._rows is None:
                self._rows = mvcc.ordered(self._wanted).toLocalIterator()
            return next(self._rows)
        except StopIteration:
            self.close()
            raise
        except Exception as error:
            self._error = error
            self.close()
            raise

    def close(self) -> None:
        self._store.cursors.discard(self)
        self._rows = iter(())


class Store:
    """``Store.open(spark, path)`` opens or makes a store; one writer at a time, readers keep their state."""

    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.options, self.lock = spark, options, threading.RLock()
        self.folder = Folder(spark, path)
        for name in ("manifest", "checkpoints"):
            self.folder.make(name)
        self.readers: list[int] = []
        self.cursors: set[Cursor] = set()
        self.filters: list[str] = []
        self._ticking: tuple[threading.Event, threading.Thread] | None = None
        self.failure: Exception | None = None
        self.state = State(layout=Layout(levels=((),) * options.compaction.max_levels))
        saved = self.folder.names("checkpoints")
        if saved:
            self.state = restored(self.folder.read(f"checkpoints/{saved[-1]}"))
        for name in self.folder.names("manifest"):
            if int(name.removesuffix(".json")) > self.state.version:
                self.state = fold(self.state, self.folder.read(f"manifest/{name}"), options.compaction)

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        return cls(spark, path, options or Options())

    def close(self) -> None:
        """Stop the maintenance and flush everything."""
        self.stop_maintenance()
        with self.lock:
            if self.state.open:
                self.freeze()
            while self.state.frozen:
                self.flush()

    def sync(self) -> int:
        """The last version on disk, which with the log is every commit's."""
        return self.state.version

    def _publish(self, record: dict, durable: bool = True) -> None:
        """Fold a record into the state, after it is in the manifest; one that isn't durable is in this process alone."""
        if not durable:
            self.state = fold(self.state, record | {"version": self.state.version}, self.options.compaction)
            return
        record |= {"version": self.state.version + 1}
        if not self.folder.publish(f"manifest/{record['version']:010d}.json", record):
            raise Conflict(f"manifest record {record['version']} was written by another")
        self.state = fold(self.state, record, self.options.compaction)
        if self.options.enable_wal and record["version"] % self.options.checkpoint_every == 0:
            self.folder.publish(f"checkpoints/{record['version']:010d}.json", asdict(self.state))

    # reads

    def _read(self, paths: list[str]) -> DataFrame:
        """Rows of batches and runs; pages are verified by their checksums."""
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)

    def _rows(self, state: State, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED) -> DataFrame:
        """The versions of all runs that the range leaves; equal (key, ts) exist once by construction."""
        chosen = [state.paths[b] for b in (*state.open, *(b for group in state.frozen for b in group))]
        chosen += [state.paths[i] for i in self.surviving(lo, hi, state)]
        return self._read(chosen).where(within(F.col("user_key"), lo, hi))

    def versions(self, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED) -> DataFrame:
        """All versions in the range, deletions too."""
        return self._rows(self.state, lo, hi)

    def mem_scan(self, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED) -> DataFrame:
        """All versions of the open memory run in the range; see ``cursor`` for order."""
        return self._read([self.state.paths[b] for b in self.state.open]).where(within(F.col("user_key"), lo, hi))

    def run_scan(self, run_id: int, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED) -> DataFrame:
        """All versions of one laid-out run in the range."""
        return self._read([self.state.paths[run_id]]).where(within(F.col("user_key"), lo, hi))

    def surviving(self, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED, state: State | None = None) -> list[int]:
        """Runs that can hold keys of the range, by their first and last keys."""

        def inside(r: Run) -> bool:
            above = lo.key is None or (r.last_key >= lo.key if lo.kind == "included" else r.last_key > lo.key)
            return above and (hi.key is None or (r.first_key <= hi.key if hi.kind == "included" else r.first_key < hi.key))

        return [i for i, r in sorted((state or self.state).runs.items()) if inside(r)]

    def scan(self, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED, ts: int | None = None) -> DataFrame:
        """Live rows (user_key, ts, value) of the range at ``ts``, in no order; see ``cursor``."""
        state = self.state
        return mvcc.visible(self._rows(state, lo, hi), state.latest if ts is None else ts)

    def cursor(self, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED, ts: int | None = None) -> Cursor:
        return Cursor(self, self.scan(lo, hi, ts))

    def num_active_cursors(self) -> int:
        """Cursors that have rows left and weren't closed."""
        return len(self.cursors)

    def get(self, key: str, ts: int | None = None) -> str | None:
        bound = Bound("included", key)
        row = self.scan(bound, bound, ts).first()
        return row.value if row else None

    def get_many(self, keys: DataFrame, ts: int | None = None) -> DataFrame:
        state = self.state
        return mvcc.multi_get(self._rows(state), keys, state.latest if ts is None else ts)

    # writes

    def write_batch(self, records: list[tuple[int, str, str | None]] | DataFrame, stream: str | None = None, number: int = 0) -> int:
        """All records (op, key, value), the last of a key winning, at one new timestamp; a DataFrame has (seq, op, user_key, value).

        Of a stream's numbered batches one that it had before adds nothing: its
        number stands in the same manifest record as the batch.
        """
        if not isinstance(records, DataFrame):
            records = self.spark.createDataFrame([(i, *r) for i, r in enumerate(records)], BATCH)
        with self.lock:
            if stream is not None and self.state.streams.get(stream, -1) >= number:
                return self.state.latest
            ts, new = self.state.latest + 1, self.state.next_id
            key = F.when(F.length("user_key") > 0, F.col("user_key")).otherwise(F.raise_error(F.lit("a key must not be empty")))
            rows = mvcc.last_write_wins(records).select(key.cast("string").alias("user_key"), F.lit(ts).cast("bigint").alias("ts"), "value")
            path = self.folder.path(f"batches/{new:010d}-{uuid.uuid4().hex}")
            rows.write.parquet(path)
            size = self._read([path]).agg(F.sum(mvcc.row_bytes())).first()[0] or 0
            self._publish({"kind": "batch", "id": new, "ts": ts, "bytes": size, "path": path, "stream": stream, "number": number}, self.options.enable_wal)
            if self.state.open_bytes >= self.options.target_run_bytes:
                self.freeze()
            return ts

    def put(self, key: str, value: str) -> int:
        return self._one(PUT, key, value)

    def delete(self, key: str) -> int:
        return self._one(DELETE, key, None)

    def _one(self, op: int, key: str, value: str | None) -> int:
        if not self.options.serializable:
            return self.write_batch([(op, key, value)])
        txn = self.new_txn()
        txn.write([(op, key, value)])
        if not txn.commit():
            raise Conflict(key)
        return self.state.latest

    def freeze(self) -> None:
        with self.lock:
            if self.state.open:
                self._publish({"kind": "freeze"}, self.options.enable_wal)

    # maintenance

    def _write_runs(self, rows: DataFrame) -> tuple[list[dict], dict[int, str]]:
        """Runs of sorted rows, of the target size or so, each with all versions of its keys; their metadata."""
        new, options = self.state.next_id, self.options
        path = self.folder.path(f"runs/{new:010d}-{uuid.uuid4().hex}")
        size, n_rows = rows.agg(F.coalesce(F.sum(mvcc.row_bytes()), F.lit(0)), F.count("*")).first()
        parts = max(1, -(-size // options.target_run_bytes))
        dealt = rows.repartitionByRange(parts, "user_key").withColumn("run", F.spark_partition_id()).sortWithinPartitions("run", "user_key", F.desc("ts"))
        writer = dealt.write.partitionBy("run").option("maxRecordsPerFile", options.file_rows).option("parquet.page.size", options.block_size).option("parquet.page.write-checksum.enabled", "true")
        writer = writer.option("parquet.writer.version", "v2").option("parquet.enable.dictionary#user_key", "false")  # keys as suffixes after the one before
        if options.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#user_key", "true").option("parquet.bloom.filter.expected.ndv#user_key", max(64, n_rows // parts))
        writer.parquet(path)
        if not n_rows:
            return [], {}
        zones = zone_map(self.spark.read.schema(SCHEMA + ", run int").parquet(path), "run").orderBy("first_key").collect()  # a row for each run
        runs = [Run(new + i, z.first_key, z.last_key, z.bytes, z.max_ts, z.n_rows) for i, z in enumerate(zones)]
        return [asdict(r) for r in runs], {new + i: f"{path}/run={z.run}" for i, z in enumerate(zones)}

    def flush(self) -> bool:
        """The oldest frozen run with all its versions, as runs of level 0 or a new tier."""
        with self.lock:
            if not self.state.frozen:
                return False
            oldest = [self.state.paths[b] for b in self.state.frozen[-1]]
            output, paths = self._write_runs(self._read(oldest))
            self._publish({"kind": "flush", "output": output, "paths": paths, "streams": self.state.streams if not self.state.open and len(self.state.frozen) == 1 else {}})
            return True

    def trigger_flush(self) -> bool:
        return len(self.state.frozen) + 1 >= self.options.num_memtable_limit and self.flush()

    def add_filter(self, prefix: str) -> None:
        """Drop keys of a prefix at or below the watermark in later compactions."""
        self.filters.append(prefix)

    def watermark(self) -> int:
        return min(self.readers, default=self.state.latest)

    def retained_snapshots(self) -> int:
        return len(set(self.readers))

    def compact(self, full: bool = False) -> bool:
        """One task of the policy, or a full one; the record is published before anything is removed."""
        with self.lock:
            state = self.state
            task = full_task(state.layout) if full else self.options.compaction.pick(state.layout, state.runs)
            if task is None or not (task.upper or task.lower):
                return False
            rows = self._read([state.paths[i] for i in (*task.upper, *task.lower)])
            rows = mvcc.collect_garbage(rows, self.watermark(), task.bottom)
            for prefix in self.filters:
                rows = rows.where((F.col("ts") > self.watermark()) | ~F.col("user_key").startswith(prefix))
            output, paths = self._write_runs(rows)
            self._publish({"kind": "compaction", "task": asdict(task), "output": output, "paths": paths})
            return True

    def vacuum(self, retention_s: float = 3600) -> list[str]:
        """Remove folders of runs and batches, and manifest records before the last checkpoint, that no state needs.

        Nothing while this process has readers, and nothing changed within the
        retention, for readers of others and for rows of scans not yet fetched.
        """
        with self.lock:
            if self.readers or self.cursors:
                return []
            state = self.state
            live = {"/".join(p.removeprefix(self.folder.root).split("/")[1:3]) for p in state.paths.values()}
            gone = [f"{kind}/{n}" for kind in ("runs", "batches") for n in self.folder.names(kind) if f"{kind}/{n}" not in live]
            saved = self.folder.names("checkpoints")
            if saved:
                gone += [f"manifest/{n}" for n in self.folder.names("manifest") if n <= saved[-1]] + [f"checkpoints/{n}" for n in saved[:-1]]
            gone = [name for name in gone if self.folder.age(name) >= retention_s]
            for name in gone:
                self.folder.remove(name)
            return gone

    def start_maintenance(self, every_s: float = 0.05) -> None:
        """Flush and compact on a clock, in a thread of its own, until ``stop_maintenance`` or ``close``; a failure ends it and stands in ``failure``."""
        if self._ticking is None:
            over = threading.Event()

            def tick() -> None:
                try:
                    while not over.wait(every_s):
                        self.trigger_flush() or self.compact()
                except Exception as error:
                    self.failure = error

            thread = threading.Thread(target=tick, daemon=True)
            self._ticking = over, thread
            thread.start()

    def stop_maintenance(self) -> None:
        if self._ticking is not None:
            over, thread = self._ticking
            over.set()
            thread.join()
            self._ticking = None

    # transactions

    def new_txn(self) -> Transaction:
        with self.lock:
            self.readers.append(self.state.latest)
            return Transaction(self, self.state)


class Transaction:
    """Reads of one snapshot with its own writes on top; commits by validating what it read."""

    def __init__(self, store: Store, state: State):
        self.store, self.state, self.read_ts = store, state, state.latest
        self.writes: dict[str, str | None] = {}
        self.read_keys: set[str] = set()
        self.read_sets: list[DataFrame] = []
        self.committed = self.over = False

    def _check(self) -> None:
        if self.committed:
            raise TransactionClosed("cannot operate on committed txn!")

    def put(self, key: str, value: str) -> None:
        self.write([(PUT, key, value)])

    def delete(self, key: str) -> None:
        self.write([(DELETE, key, None)])

    def write(self, records: list[tuple[int, str, str | None]]) -> None:
        self._check()
        self.writes |= {k: (v or None) if op else None for op, k, v in records}

    def _local(self) -> DataFrame:
        return self.store.spark.createDataFrame(list(self.writes.items()), "user_key string, value string")

    def get(self, key: str) -> str | None:
        self._check()
        self.read_keys.add(key)
        if key in self.writes:
            return self.writes[key]
        bound = Bound("included", key)
        row = mvcc.visible(self.store._rows(self.state, bound, bound), self.read_ts).first()
        return row.value if row else None

    def scan_out(self, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED) -> DataFrame:
        """(user_key, value) of its own writes in the range, in key order, deletions as null; no read of the store, so nothing joins the read set."""
        self._check()
        return self._local().where(within(F.col("user_key"), lo, hi)).orderBy("user_key")

    def scan(self, lo: Bound = UNBOUNDED, hi: Bound = UNBOUNDED) -> DataFrame:
        """(user_key, value) of the range; the keys it returns join the read set."""
        self._check()
        rows = overlay_scan(self._local(), self.store._rows(self.state, lo, hi), lo, hi, self.read_ts)
        self.read_sets.append(rows.select("user_key"))
        return rows

    def _conflicts(self) -> bool:
        store = self.store
        if store.state.latest == self.read_ts:
            return False
        changed = store._rows(store.state).where(F.col("ts") > self.read_ts).select("user_key")
        read = store.spark.createDataFrame([(k,) for k in self.read_keys], "user_key string")
        for keys in self.read_sets:
            read = read.unionByName(keys)
        return not changed.join(read, "user_key", "left_semi").isEmpty()

    def commit(self) -> bool:
        """False if a key it read has been written since; the transaction then can only fail again."""
        self._check()
        with self.store.lock:
            if self.store.options.serializable and self.writes and self._conflicts():
                return False
            self.store.write_batch([(DELETE if v is None else PUT, k, v) for k, v in sorted(self.writes.items())])
            self.committed = True
            self.rollback()
            return True

    def rollback(self) -> None:
        """Drop the writes and let the watermark go."""
        with self.store.lock:
            if not self.over:
                self.store.readers.remove(self.read_ts)
                self.over = True


def open_store(spark: SparkSession, path: str, compaction: str = "leveled", **fields: int) -> Store:
    return Store.open(spark, path, Options(compaction=policy(compaction, **fields)))
