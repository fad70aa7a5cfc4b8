"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A token is scored as `` word `` between spaces, letters lower-cased and all else
dropped; each character is predicted from at most four before it in the token.
Counts are gathered over every training row: tasks count tokens, then their
character n-grams, and a shuffle adds them up. The model keeps every n-gram of
every language; the shorter ones' continuation counts follow from the longest.
It is sorted arrays of 64-bit hashes with a row of log-probabilities by language,
and such arrays of contexts; a search goes from the longest order down and adds
the weights of the contexts it leaves. Spark computes and sorts these arrays,
tasks write them to the shared folder, in files by ranges of hashes, and Spark's
own distribution of files takes them to each executor once, a new one too.
Workers map them, so neither the driver's memory nor a worker's holds them.

A text's language is that of the lowest cross-entropy by character. It is
rejected if that exceeds the language's limit: with a margin, the ``QUANTILE``
of all training texts that were given the language, or of those of all
languages if none was. Cross-entropies are counted in steps of ``STEP`` for it,
rounded up, so that what an aggregate holds doesn't grow with the rows.

Case handling: null text and texts without letters are ``und`` with score 0 and
rejected; null languages teach nothing; without training rows all texts are
``und``; a null doc_id counts as the empty text for the fold; repeated rows each
get their row; ties go to the alphabetically first language; a very long token
is scored whole, and caches are emptied by size; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import prepare, stored, work_dir

ORDER = 5
#: Quantile of the training texts from which rejection limits are taken, the factor on it, and the step of its values.
QUANTILE, MARGIN, STEP = 0.999, 1.6, 1e-4
#: Characters of tokens a worker remembers, and distinct tokens or n-grams it counts before it passes them on.
CACHED, COUNTED = 1_500_000, (80_000, 150_000)
#: Ranges of hashes at least, and n-grams (counted by language) for each beyond; a task writes, and a worker maps, one file of a range at a time.
RANGES, PART = 16, 500_000
BASE, TOP = 0x9E3779B97F4A7C15, np.uint64(1 << 63)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def letters(token: str) -> str:
    return token.lower() if token.isalpha() and token.isascii() else "".join(filter(str.isalpha, token.lower()))


def _hashes(text: str) -> list[np.ndarray]:
    """Hashes of the 1, 2 ... ORDER characters that end at each place of a text; those of gram strings by ``_hash``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    found = [codes]
    for _ in range(ORDER - 1):
        found.append(np.r_[np.uint64(0), found[-1][:-1]] * np.uint64(BASE) + codes)
    return found


def _padded(words: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The words between spaces as one text, their lengths in it, and each character's place in its word."""
    lengths = np.array([len(w) + 2 if w else 0 for w in words], np.int64)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return "".join(f" {w} " for w in words if w), lengths, np.arange(len(start)) - start


def _grams(tokens: Counter) -> Counter:
    """Longest n-grams of the tokens: of each character after the first space, with up to four before it."""
    words: Counter = Counter()
    for token, n in tokens.items():
        words[letters(token)] += n
    text, lengths, place = _padded(list(words))
    if not text:
        return Counter()
    hashes, size = _hashes(text), np.minimum(place, ORDER - 1)
    ends = np.flatnonzero(place)
    keys = np.stack(hashes)[size[ends], ends]
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.bincount(which, np.repeat(np.fromiter(words.values(), np.int64), lengths)[ends]).astype(np.int64).tolist()
    return Counter({text[e - n : e + 1]: s for e, n, s in zip(ends[first].tolist(), size[ends[first]].tolist(), sums)})


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens: dict[str, Counter] = defaultdict(Counter)
    grams: dict[str, Counter] = defaultdict(Counter)

    def take() -> None:
        for lang, counted in tokens.items():
            grams[lang].update(_grams(counted))
        tokens.clear()

    def emit() -> pa.RecordBatch:
        rows = [(lang, gram, n) for lang, counted in grams.items() for gram, n in counted.items()]
        grams.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    for part in parts:
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            tokens[lang].update(text.split())
            if sum(map(len, tokens.values())) > COUNTED[0]:
                take()
        if sum(map(len, grams.values())) > COUNTED[1]:
            yield emit()
    take()
    yield emit()


def gram_counts(training: DataFrame) -> DataFrame:
    """(lang, gram, n) over every row (lang, text) of the training set."""
    counted = training.select("lang", "text").where("lang is not null and text is not null").mapInArrow(_count, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hash(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h * BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Model:
    """Interpolated Kneser-Ney models of several languages over one set of n-grams."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        by_order = [self._by_order(counts[lang]) for lang in self.langs]
        contexts = [[self._contexts(c) for c in orders] for orders in by_order]
        vocabulary = 2 + max((len(orders[0]) for orders in by_order), default=0)
        #: By order: sorted hashes and log-probabilities of n-grams; sorted hashes and log-weights of contexts.
        self.grams, self.weights = [], []
        lower: dict[str, np.ndarray] = {}
        for n in range(ORDER):
            every = sorted(set().union(*(orders[n] for orders in by_order)))
            heads = sorted(set().union(*(c[n] for c in contexts)))
            weight = {h: np.array([c[n][h][1] if h in c[n] else 1.0 for c in contexts]) for h in heads}
            here = {}
            for gram in every:
                head = gram[:-1]
                seen = np.array([max(0.0, orders[n].get(gram, 0) - c[n][head][2]) / c[n][head][0] if gram in orders[n] else 0.0 for orders, c in zip(by_order, contexts)])
                here[gram] = seen + weight[head] * (lower[gram[1:]] if n else 1 / vocabulary)
            lower = here
            self.grams.append(self._sorted(here))
            self.weights.append(self._sorted(weight))
        self.floor = -np.log(vocabulary)
        self.limits = np.full(len(self.langs), np.inf)

    @staticmethod
    def _by_order(longest: dict[str, int]) -> list[dict[str, int]]:
        """Counts by order: n-grams as they are where nothing stands before them, else the number of characters seen there."""
        orders: list[dict[str, int]] = [defaultdict(int) for _ in range(ORDER)]
        for gram, n in longest.items():
            orders[len(gram) - 1][gram] += n
        for n in range(ORDER - 1, 0, -1):
            for gram in orders[n]:
                orders[n - 1][gram[1:]] += 1
        return [dict(o) for o in orders]

    @staticmethod
    def _contexts(counts: dict[str, int]) -> dict[str, tuple[float, float, float]]:
        """Of each context: total, weight left to the next order, discount."""
        ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        total: Counter = Counter()
        kinds: Counter = Counter()
        for gram, n in counts.items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        return {h: (total[h], discount * kinds[h] / total[h], discount) for h in total}

    def _sorted(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([_hash(g) for g in rows], np.uint64)
        order = np.argsort(keys)
        values = np.log(np.array(list(rows.values())).reshape(len(rows), len(self.langs)))
        return keys[order], values[order].astype(np.float32)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log-probabilities (words x languages) and predicted characters of each word of letters."""
        text, lengths, place = _padded(words)
        total = np.zeros((len(words), len(self.langs)))
        if not text:
            return total, np.zeros(len(words), np.int64)
        hashes = _hashes(text)
        score = np.zeros((len(place), len(self.langs)), np.float32)
        left = np.flatnonzero(place > 0)
        for n in range(ORDER - 1, -1, -1):
            now = left[place[left] >= n]
            at, found = self._find(self.grams[n][0], hashes[n][now])
            score[now[found]] += self.grams[n][1][at[found]]
            lost = now[~found]
            heads = hashes[n - 1][lost - 1] if n else np.zeros(len(lost), np.uint64)
            at, found_head = self._find(self.weights[n][0], heads)
            score[lost[found_head]] += self.weights[n][1][at[found_head]]
            left = np.sort(np.r_[lost, left[place[left] < n]])
        score[left] += self.floor
        score[place == 0] = 0
        owner = np.repeat(np.arange(len(words)), lengths)
        for k in range(len(self.langs)):
            total[:, k] = np.bincount(owner, score[:, k], len(words))
        return total, np.maximum(lengths - 1, 0)


class Filed(Model):
    """A model whose arrays lie in files that Spark takes to each executor once; workers map them.

    A file holds the rows of one kind (n-grams or contexts) whose hashes lie in
    one of ``parts`` equal ranges: sorted hashes, then rows of 32-bit logarithms.
    """

    def __init__(self, names: dict[tuple[int, int], tuple[str, int]], parts: int, langs: list[str], vocabulary: int):
        self.names, self.parts, self.langs = names, parts, langs
        self.floor = -np.log(vocabulary)
        self.limits = np.full(len(langs), np.inf)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("grams", "weights")}

    @cached_property
    def grams(self) -> list[tuple]:
        return [self._mapped(0)] * ORDER

    @cached_property
    def weights(self) -> list[tuple]:
        return [self._mapped(1)] * ORDER

    def _mapped(self, kind: int) -> tuple[list[np.ndarray], Rows]:
        """Hashes by range, and rows of all ranges by their place."""
        hashes, rows = [], []
        for part in range(self.parts):
            name, n = self.names.get((kind, part), (None, 0))
            path = SparkFiles.get(name) if n else None
            hashes.append(np.asarray(np.memmap(path, np.uint64, "r", shape=(n,))) if n else np.zeros(0, np.uint64))
            rows.append(np.asarray(np.memmap(path, np.float32, "r", 8 * n, (n, len(self.langs)))) if n else np.zeros((0, len(self.langs)), np.float32))
        return hashes, Rows(rows)

    def _find(self, table: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.parts == 1:
            return super()._find(table[0], keys)
        at, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        part, before = part_of(keys, self.parts), 0
        for k, hashes in enumerate(table):
            if len(own := np.flatnonzero(part == k)):
                at[own], found[own] = super()._find(hashes, keys[own])
                at[own] += before
            before += len(hashes)
        return at, found


class Rows:
    """Rows of several matrices by their place in all of them."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts
        self.ends = np.cumsum([len(p) for p in parts])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        if len(self.parts) == 1:
            return self.parts[0][at]
        out, part = np.empty((len(at), self.parts[0].shape[1]), np.float32), np.searchsorted(self.ends, at, "right")
        for k, rows in enumerate(self.parts):
            if len(own := np.flatnonzero(part == k)):
                out[own] = rows[at[own] - (self.ends[k] - len(rows))]
        return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of equal ranges a hash lies in."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _hashed(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (kind, gram, values) with the range and hash of the gram, its top bit flipped to sort as a signed number, and logarithms."""
        for batch in batches:
            keys = np.array([_hash(g) for g in batch.column(1).to_pylist()], np.uint64)
            values = np.log(batch.column(2).flatten().to_numpy()).astype(np.float32)
            starts = np.linspace(0, len(values), len(keys) + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part_of(keys, parts)), pa.array((keys ^ TOP).view(np.int64)), pa.ListArray.from_arrays(starts, values)], ["kind", "part", "key", "logs"])

    return run


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A file for each kind and range of rows that come sorted; a range has ``PART`` rows at most, or so."""
        held: list[pa.RecordBatch] = []

        def emit() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            name = f"langid-{uuid.uuid4().hex}"
            system, path = fs.FileSystem.from_uri(f"{folder}/{name}")
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path, compression=None) as out:
                out.write((rows.column(2).to_numpy().view(np.uint64) ^ TOP).tobytes())
                for chunk in rows.column(3).chunks:
                    out.write(chunk.flatten().to_numpy().tobytes())
            kind, part = held[0].column(0)[:1], held[0].column(1)[:1]
            held.clear()
            return pa.RecordBatch.from_arrays([kind, part, pa.array([name]), pa.array([len(rows)], pa.int64())], ["kind", "part", "name", "n"])

        for batch in batches:
            kind, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = [0, *(np.flatnonzero((np.diff(kind) != 0) | (np.diff(part) != 0)) + 1).tolist()] if len(batch) else []
            for at, end in zip(starts, [*starts[1:], len(batch)]):
                if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (kind[at], part[at]):
                    yield emit()
                held.append(batch.slice(at, end - at))
        if held:
            yield emit()

    return run


def build(counts: DataFrame) -> Model:
    """The model of all rows (lang, gram, n), as ``Model`` makes it of dictionaries, by aggregates and joins.

    Only the languages, a few numbers for each of their orders and the names of
    the files come to the driver.
    """
    spark = counts.sparkSession
    # each longest n-gram stands for its ends too: seen once after the character before them, or n times where nothing stands before
    ends = F.expr("transform(sequence(1, length(gram)), k -> struct(right(gram, k) as gram, if(k < length(gram), substring(gram, length(gram) - k, 1), null) as before, if(k < length(gram), 0L, n) as n))")
    every = counts.select("lang", F.explode(ends).alias("x")).select("lang", "x.*")
    rows = stored(every.groupBy("lang", "gram").agg((F.count_distinct("before") + F.sum("n")).alias("n")), "orders")
    sizes: dict[str, dict[int, tuple[int, int, int]]] = defaultdict(dict)
    for r in rows.groupBy("lang", F.length("gram")).agg(F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect():
        sizes[r[0]][r[1]] = r[2], r[3], r[4]
    langs = sorted(sizes)
    if not langs:
        return Model({})
    vocabulary = 2 + max(of.get(1, (0,))[0] for of in sizes.values())
    parts = max(RANGES, sum(n for of in sizes.values() for n, _, _ in of.values()) // PART)
    discounts = [[ones / (ones + 2 * twos) if ones and twos else 0.5 for _, ones, twos in (sizes[lang].get(n + 1, (0, 0, 0)) for n in range(ORDER))] for lang in langs]
    by_order = [F.element_at(F.array(*map(F.lit, d)), F.length("gram") if what == "gram" else F.length("head") + 1) for what in ("gram", "head") for d in discounts]
    by_lang = lambda what: F.array(*[F.sum(F.when(F.col("lang") == lang, what).otherwise(F.lit(0))).cast("double") for lang in langs])
    heads = rows.groupBy(F.expr("left(gram, length(gram) - 1)").alias("head")).agg(by_lang(F.col("n")).alias("total"), by_lang(F.lit(1)).alias("kinds"))
    weight = F.array(*[F.when(F.col("total")[i] > 0, d * F.col("kinds")[i] / F.greatest(F.col("total")[i], F.lit(1.0))).otherwise(F.lit(1.0)) for i, d in enumerate(by_order[len(langs) :])])
    heads = stored(heads.select("head", "total", weight.alias("weight")), "heads")
    wide = rows.groupBy("gram").agg(by_lang(F.col("n")).alias("c")).withColumn("head", F.expr("left(gram, length(gram) - 1)")).join(heads, "head")
    seen = F.array(*[F.greatest(F.lit(0.0), F.col("c")[i] - d) / F.greatest(F.col("total")[i], F.lit(1.0)) for i, d in enumerate(by_order[: len(langs)])])
    own = stored(wide.select("gram", seen.alias("seen"), "weight"), "shares")
    # a share is interpolated from the shortest end of the n-gram up to itself
    wanted = own.select("gram", F.explode(F.expr("transform(sequence(1, length(gram)), k -> right(gram, k))")).alias("end"))
    chain = wanted.join(own.withColumnRenamed("gram", "end"), "end").groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(F.length("end").alias("k"), "seen", "weight"))).alias("chain"))
    share = F.expr(f"aggregate(chain, array_repeat(cast({1 / vocabulary!r} as double), {len(langs)}), (p, x) -> zip_with(x.seen, zip_with(x.weight, p, (w, q) -> w * q), (s, t) -> s + t))")
    tables = chain.select(F.lit(0).alias("kind"), "gram", share.alias("p")).unionByName(heads.select(F.lit(1).alias("kind"), F.col("head").alias("gram"), F.col("weight").alias("p")))
    folder = work_dir(spark, "langid")
    hashed = tables.mapInArrow(_hashed(parts), "kind int, part long, key long, logs array<float>")
    named = hashed.repartition("kind", "part").sortWithinPartitions("kind", "part", "key").mapInArrow(_write(folder), "kind int, part long, name string, n long").collect()
    for r in named:
        spark.sparkContext.addFile(f"{folder}/{r.name}")
    return Filed({(r.kind, r.part): (r.name, r.n) for r in named}, parts, langs, vocabulary)


class Scorer:
    """Scores texts with a model; remembers tokens it has scored."""

    def __init__(self, model: Model):
        self.model, self.known, self.words, self.held = model, {}, {}, 0
        self.rows = np.zeros((0, len(model.langs) + 1))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        split = [(t or "").split() for t in texts]
        if self.held > CACHED:
            self.known, self.words, self.rows, self.held = {}, {}, self.rows[:0], 0
        tokens = set().union(*split).difference(self.known)
        spelled = list(map(letters, tokens))
        new = list(dict.fromkeys(w for w in spelled if w not in self.words))
        sums, n = self.model.words(new)
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.known.update(zip(tokens, map(self.words.__getitem__, spelled)))
        self.rows = np.concatenate([self.rows, np.column_stack([sums, n])])
        self.held += sum(map(len, tokens))
        return [self._decide(np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))) for tokens in split]

    def _decide(self, at: np.ndarray) -> tuple[str, float, float | None, bool]:
        *sums, n = self.rows[at].sum(axis=0)
        if not n or not sums:
            return "und", 0.0, None, True
        entropy = -np.array(sums) / n
        best = int(entropy.argmin())
        score = 1 / np.exp(-0.5 * min(n, 60) * (entropy - entropy[best])).sum()
        return self.model.langs[best], float(score), float(entropy[best]), bool(entropy[best] > self.model.limits[best])


def _score(model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for part in parts:
            lang, score, entropy, rejected = zip(*scorer.texts(part.column(1).to_pylist())) if len(part) else ((),) * 4
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_()), part.column(2)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected", "learned"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", learned: Column | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected, learned) of each row; learned is passed through."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.lit(True) if learned is None else learned).alias("learned"))
    return narrow.mapInArrow(_score(shared), "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean, learned boolean")


def predict(text: Column, model: Model) -> Column:
    """A text's (lang_pred, score, cross_entropy, rejected) as a struct, for use in a select.

    Marked nondeterministic only so that a filter on it isn't pushed below the
    select, which would run the function twice for each row.
    """
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "cross_entropy": pa.float64(), "rejected": pa.bool_()}

    @F.arrow_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for column in columns:
            rows = list(zip(*scorer.texts(column.to_pylist()))) or [()] * 4
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds.values())], list(kinds))

    return found.asNondeterministic()(text)


def set_limits(model: Model, scored: DataFrame) -> Model:
    """Limits of rejection from (lang_pred, cross_entropy) of all training texts."""
    steps = scored.where("cross_entropy is not null").groupBy("lang_pred", F.ceil(F.col("cross_entropy") / STEP).alias("step")).count()
    found = {r[0]: r[1] * STEP for r in steps.rollup("lang_pred").agg(F.percentile("step", F.lit(QUANTILE), F.col("count"))).collect() if r[1] is not None}
    model.limits = MARGIN * np.array([found.get(lang, found.get(None, np.inf)) for lang in model.langs])
    return model


def beyond(model: Model, lang_pred: Column, cross_entropy: Column) -> Column:
    """Whether a scored text is rejected by the model's limits; one without a cross-entropy always is."""
    if not model.langs:
        return F.lit(True)
    limits = F.create_map(*[F.lit(x) for pair in zip(model.langs, model.limits.tolist()) for x in pair])
    return F.coalesce(cross_entropy > limits[lang_pred], F.lit(True))


def learned_from(doc_id: Column | str = "doc_id", lang: Column | str = "lang") -> Column:
    """Whether a row is one that the models learn from, if it has a text."""
    of = lambda x: F.col(x) if isinstance(x, str) else x
    return ~held_out(of(doc_id).cast("long")) & of(lang).isNotNull()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models of every language of the rows that aren't held out, without limits of rejection."""
    prepare(docs.sparkSession)
    rows = docs.where(learned_from(id_col, lang_col)).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    return build(gram_counts(rows))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models of every language of the rows that aren't held out, with limits of rejection, for which their texts are scored."""
    model = learn(docs, id_col, text_col, lang_col)
    scored = score(docs.where(learned_from(id_col, lang_col)), model, id_col, text_col)
    return set_limits(model, scored.select("lang_pred", "cross_entropy"))


def identify(docs: DataFrame) -> DataFrame:
    """Trains on the rows that aren't held out and scores all, once: doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    model = learn(docs)
    scored = stored(score(docs, model, learned=learned_from()), "scored")
    set_limits(model, scored.where("learned"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", beyond(model, F.col("lang_pred"), F.col("cross_entropy")).alias("rejected"))


def identified(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns of each row with ``found``: lang_pred, score, cross_entropy, rejected. Texts are scored once and stored with it."""
    model = learn(docs)
    scored = stored(docs.select(*columns, learned_from().alias("is_learned"), predict(F.col("text"), model).alias("found")), "scored")
    set_limits(model, scored.where("is_learned").select("found.lang_pred", "found.cross_entropy"))
    rejected = beyond(model, F.col("found.lang_pred"), F.col("found.cross_entropy"))
    return scored.select(*columns, F.col("found").withField("rejected", rejected).alias("found"))
