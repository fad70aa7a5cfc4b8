"""Quality rules: a decision list learned by sequential covering.

Each text's statistics are counted whole. From a bounded sample of labelled
rows, conjunctions of thresholds on ratios of the statistics are grown for the
class to be dropped, one condition at a time by information gain on two thirds
of the rows, then pruned from the end on the other third; a rule stays if it is
precise there, the rows it covers leave, and the next is grown. The list comes
out as one ordered ``CASE WHEN`` of Spark conditions, first match wins.

Case handling: null text counts as empty, with all statistics 0 and the base
rule failed (fewer than ten words); ratios divide by one at least; without
labels of both kinds the list is empty and only the base rule drops; repeated
rows each get their row; ties between conditions go to the first feature and
lowest threshold; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import prepare, texts

#: Labelled rows that the list is learned from at most (least hashes of doc_id).
SAMPLE = 10_000
#: Thresholds tried for a feature, conditions of a rule, rules of a list; least precision and rows covered on the pruning part.
CUTS, CONDITIONS, RULES, PRECISION, COVERED = 24, 3, 12, 0.95, 3
#: Words of a window that repeats; texts with more words than this count windows as numbers.
WINDOW, LONG = 5, 50_000
SPACE = b" \t\n\v\f\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct_words", "n_twin_words")
#: Features: a statistic and what it is divided by (1 at least).
FEATURES = (("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "word_chars"), ("n_marks", "n_words"), ("n_distinct_words", "n_words"), ("n_twin_words", "n_words"), ("word_chars", "n_words"))


def repeated_words(words: list[bytes]) -> int:
    """Words within windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if n > LONG:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        windows = ids[:n]
        for k in range(1, WINDOW):  # pairs of a rank and a word stay below the square of the words
            windows = np.unique(windows * len(number) + ids[k : n + k], return_inverse=True)[1]
        again = np.bincount(windows)[windows] > 1
    else:
        grams = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(grams)) == n:
            return 0
        counts = Counter(grams)
        again = np.fromiter((counts[g] > 1 for g in grams), bool, n)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[WINDOW:] -= again
    return int((edges.cumsum() > 0).sum())


def statistics(raw: bytes | None) -> tuple[int, ...]:
    """The numbers named in STATS."""
    raw = raw or b""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words), len(raw.translate(None, CONTINUATION + SPACE)), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), without(bytes(range(65, 91))), without(b"!?"), len(set(words)), sum(map(eq, words, words[1:])),
    )


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        found = np.array([statistics(x) for x in texts(part.column(1))], np.int64).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found.T)], ["doc_id", *STATS])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's text."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_count, "doc_id long, " + ", ".join(f"{s} long" for s in STATS))


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] >= self.cut if self.above else x[:, self.feature] < self.cut

    def column(self) -> Column:
        value, by = FEATURES[self.feature]
        ratio = F.col(value) / F.greatest(F.col(by), F.lit(1))
        return ratio >= self.cut if self.above else ratio < self.cut

    def __str__(self) -> str:
        value, by = FEATURES[self.feature]
        return f"{value}/{by} {'>=' if self.above else '<'} {self.cut:.6g}"


def matrix(stats: np.ndarray) -> np.ndarray:
    """Features of rows of STATS."""
    at = {s: i for i, s in enumerate(STATS)}
    return np.column_stack([stats[:, at[a]] / np.maximum(stats[:, at[b]], 1) for a, b in FEATURES])


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(len(x), bool)


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < CONDITIONS and not bad[inside].all():
        before = np.log2(bad[inside].mean())
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[inside & bad, f], np.linspace(0, 1, CUTS))):
                for above in (True, False):
                    held = inside & Condition(f, above, float(cut)).holds(x)
                    hit = bad[held].sum()
                    if hit and (now := hit * (np.log2(hit / held.sum()) - before)) > gain:
                        best, gain = Condition(f, above, float(cut)), now
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _worth(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> tuple[float, int]:
    held = _covers(rule, x)
    return (bad[held].mean() if held.any() else 0.0), int(bad[held].sum())


def learn(stats: np.ndarray, bad: np.ndarray) -> list[list[Condition]]:
    """Rules, in order, that pick out the bad rows."""
    x = matrix(stats)
    prune = np.arange(len(x)) % 3 == 2
    rules: list[list[Condition]] = []
    left = np.ones(len(x), bool)
    while len(rules) < RULES and (bad & left & ~prune).any() and (~bad & left & ~prune).any():
        rule = _grow(x[left & ~prune], bad[left & ~prune])
        test = (x[left & prune], bad[left & prune])
        while len(rule) > 1 and _worth(rule[:-1], *test) >= _worth(rule, *test):
            rule = rule[:-1]
        precision, covered = _worth(rule, *test)
        if not rule or precision < PRECISION or covered < COVERED:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def verdict(rules: list[list[Condition]]) -> tuple[Column, Column]:
    """Whether the list keeps a row, and the number of the rule that drops it (null if none)."""
    number = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        held = rules[i - 1][0].column()
        for c in rules[i - 1][1:]:
            held &= c.column()
        number = F.when(held, F.lit(i)).otherwise(number)
    return number.isNull(), number


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """Statistics and the label of at most ``most`` labelled rows, one for each doc_id and text."""
    spark = prepare(docs.sparkSession)
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = spark.createDataFrame(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect(), marked.schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    keys = rows.select("doc_id", F.xxhash64("text").alias("text_key")).distinct().orderBy(F.xxhash64("doc_id", "text_key"), "doc_id", "text_key").limit(most)
    keys = spark.createDataFrame(keys.collect(), keys.schema)  # most rows at most
    once = rows.withColumn("text_key", F.xxhash64("text")).join(F.broadcast(keys), ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    table = counted(once).join(F.broadcast(chosen), "doc_id").select(*STATS, "quality").toArrow()
    return np.column_stack([table.column(c).to_numpy() for c in (*STATS, "quality")]) if table.num_rows else np.zeros((0, len(STATS) + 1))


def learn_from(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[list[Condition]]:
    """The list learned from at most ``most`` labelled rows; a row labelled twice counts with its least label."""
    data = labelled(docs, labels, most)
    data = data[np.lexsort(data.T)]  # rows come in any order
    data = data[np.argsort(np.random.default_rng(3).random(len(data)), kind="stable")]
    return learn(data[:, :-1], data[:, -1] == 0)


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the rule that dropped it, one row for each document."""
    keeps, number = verdict(learn_from(docs, labels))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & keeps).withColumn("rule", number).select("doc_id", *STATS[:5], "base_failed", "kept", "rule")
