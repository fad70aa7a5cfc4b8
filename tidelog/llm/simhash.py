"""Near-duplicates by SimHash over a hierarchical index in Gray order.

Fingerprints are made of the XXH64 of each word shingle. Equal ones are one
row from then on. Two fingerprints that differ in at most three bits agree in
at least one of four blocks (or in two of five, three of six, as their number
grows), so each is dealt to one group for each choice of blocks, by as many bits
of them as leave groups of ``MEAN`` members or more. In a group they are sorted
by Gray rank, where neighbours share most bits; runs of ``FAN`` become nodes that
hold the bits all their children share, and nodes of nodes likewise. A search
adds the differences from the root down and drops a whole group of fingerprints
once they exceed the limit.

A group of more than ``GROUP`` members is split into chunks, and every pair of
chunks becomes a group, so no link is lost and no task holds more. A task
unions what it links and emits at most one edge for each member.

Case handling: a null or wordless text has fingerprint zero and is linked like
any other; a text of fewer words than a shingle is one shingle; repeated rows
get the same component; a null doc_id keeps its row and never names a
component unless all its members are null; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, prepare, texts
from tidelog.llm.components import components

SEED = 42
#: Children of a node of the index.
FAN = 8
#: Members of a group, on average, and those that are searched at once at most.
MEAN, GROUP = 512, 4096
#: Rows a task gathers of whole groups, and pairs it holds at once.
ROWS, PAIRS = 100_000, 2_000_000


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.dtype("<u8"), n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = np.array([fingerprint(x, shingle) for x in texts(part.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp): a hash of the text, and the fingerprint, as signed longs."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return narrow.mapInArrow(_fingerprints(shingle), "doc_id long, text_key long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each word in the Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Levels of nodes over members sorted by group and Gray rank; each group has a root of its own."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.order = np.lexsort((gray_rank(fp), group))
        self.fp, group = fp[self.order], group[self.order]
        everything = np.full(len(fp), ~np.uint64(0))
        # of each level: pattern, mask, group, first child, end of children, last member
        level = [self.fp, everything, group, np.arange(len(fp)), np.arange(len(fp)), np.arange(len(fp))]
        self.levels = [level]
        while True:
            pattern, mask, group, _, _, last = level
            first_of_group = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[first_of_group, len(group)])
            if sizes.max(initial=1) == 1:
                break
            place = np.arange(len(group)) - np.repeat(first_of_group, sizes)
            first = np.flatnonzero(place % FAN == 0)
            end = np.r_[first[1:], len(group)]
            ones = np.bitwise_and.reduceat(pattern, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(np.bitwise_or.reduceat(pattern, first) ^ ones)
            level[1] = mask & ~np.repeat(shared, end - first)  # what the parent holds, the children needn't
            level = [ones & shared, shared, group[first], first, end, last[end - 1]]
            self.levels.append(level)
        self.root_of = np.repeat(np.arange(len(group)), np.diff(np.r_[-1, last]))
        self.asked = self.dropped = 0  # nodes that searches came to, and those they went no further from

    def links(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (a < b) whose members differ in at most ``most`` bits, in blocks."""
        last = self.levels[-1][5]
        sizes = np.diff(np.r_[-1, last])[self.root_of]
        block = np.cumsum(sizes) // PAIRS
        for at in np.split(np.arange(len(self.fp)), np.flatnonzero(np.diff(block)) + 1):
            query, node = at, self.root_of[at]
            pattern, mask = self.levels[-1][:2]
            apart = np.bitwise_count((self.fp[query] ^ pattern[node]) & mask[node]).astype(np.int16)
            for upper, lower in zip(self.levels[:0:-1], self.levels[-2::-1]):
                count = (upper[4] - upper[3])[node]
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                child = np.repeat(upper[3][node], count) + step
                query, apart = np.repeat(query, count), np.repeat(apart, count)
                apart = apart + np.bitwise_count((self.fp[query] ^ lower[0][child]) & lower[1][child]).astype(np.int16)
                keep = (apart <= most) & (lower[5][child] > query)
                self.asked, self.dropped = self.asked + len(keep), self.dropped + len(keep) - int(keep.sum())
                query, node, apart = query[keep], child[keep], apart[keep]
            if len(self.levels) == 1:
                return
            yield query, node


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parents, flat, after the links a-b."""
    while True:
        x, y = parent[a], parent[b]
        if not (apart := x != y).any():
            return parent
        a, b = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent] != parent).any():
            parent = np.where(up, parent[parent], parent)


def local_edges(group: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) that join what is linked within each group."""
    if not len(fp):
        return fp, fp
    index = GrayIndex(group, fp)
    parent = np.arange(len(fp))
    for a, b in index.links(most):
        parent = _union(parent, a, b)
    moved = parent != np.arange(len(fp))
    return index.fp[moved], index.fp[parent[moved]]


def _search(most: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def emit(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        keys = [whole.column(i).to_numpy() for i in range(3)]
        change = np.any([np.r_[False, k[1:] != k[:-1]] for k in keys], axis=0)
        u, v = local_edges(np.cumsum(change), whole.column(3).to_numpy().view(np.uint64), most)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; whole groups are searched together."""
        held: list[pa.RecordBatch] = []
        for part in parts:
            if sum(map(len, held)) >= ROWS:
                keys = np.stack([part.column(i).to_numpy() for i in range(3)])
                before = np.array([[held[-1].column(i)[-1].as_py()] for i in range(3)])
                change = np.flatnonzero((keys != np.hstack([before, keys[:, :-1]])).any(axis=0))
                if len(change):
                    yield emit([*held, part.slice(0, change[0])])
                    held, part = [], part.slice(change[0])
            if len(part):
                held.append(part)
        if held:
            yield emit(held)

    return run


def dealing(n: int, most: int) -> tuple[int, int]:
    """Blocks, and bits of a choice's key, so that a group of evenly spread fingerprints holds MEAN to twice as many, if there are as many bits."""
    wanted = max(0, (n // MEAN).bit_length() - 1)
    for blocks in range(most + 1, most + 4):
        bits = (blocks - most) * (64 // blocks)
        if wanted <= bits:
            return blocks, wanted
    return blocks, bits


def _block_keys(fp: Column, most: int, blocks: int, bits: int) -> Column:
    """An entry (choice, key) for each choice of blocks of which two linked fingerprints agree in one; the key is the first bits of its blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    places = ([k for i in chosen for k in reversed(range(edges[i], edges[i + 1]))][:bits] for chosen in combinations(range(blocks), blocks - most))
    choices = sorted({sum(1 << k for k in p) for p in places})
    signed = [m - (1 << 64) if m >> 63 else m for m in choices]
    return F.array(*(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)))


def linked_edges(distinct: DataFrame, most: int = 3, dealt_by: tuple[int, int] | None = None) -> DataFrame:
    """Edges (u, v) whose components are those of all links between the distinct fingerprints ``fp``; dealt_by: blocks and bits, as of ``dealing``."""
    blocks, bits = dealt_by or dealing(distinct.count(), most)
    dealt = distinct.select("fp", F.explode(_block_keys(F.col("fp"), most, blocks, bits)).alias("b")).select("fp", "b.choice", "b.key")
    large = dealt.groupBy("choice", "key").count().where(F.col("count") > GROUP)
    chunks = large.select("choice", "key", F.ceil(F.col("count") * 2 / GROUP).cast("int").alias("chunks"))
    sized = dealt.join(chunks, ["choice", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.expr("if(chunks is null, array(-1), filter(sequence(0, chunks - 1), x -> x <> own))"))
    tiled = sized.withColumn("own", own).withColumn("other", other)
    tile = F.when(F.col("other") < 0, F.lit(-1)).otherwise(F.least("own", "other") * F.lit(1 << 20) + F.greatest("own", "other")).cast("long")
    keyed = tiled.select(F.col("choice").cast("long").alias("choice"), "key", tile.alias("tile"), "fp")
    return keyed.repartition("choice", "key", "tile").sortWithinPartitions("choice", "key", "tile").mapInArrow(_search(most), "u long, v long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, text_key, fp, component_id, first), one row for each row.

    ``first``: the row is the component's least by doc_id, nulls last, then
    text_key; rows equal in both are first together.
    """
    made = cut(fingerprints(docs, id_col, text_col, shingle))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    distinct = made.groupBy("fp").agg(F.min(place).alias("least"))
    roots = components(linked_edges(distinct.select("fp"), most))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")), "root").select("fp", "first")
    return made.join(named, "fp").select("doc_id", "text_key", "fp", F.col("first.doc_id").alias("component_id"), (place == F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row: 16 hex digits, and the least doc_id reachable over links of at most ``most`` bits."""
    return grouped(docs, id_col, text_col, shingle, most).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
