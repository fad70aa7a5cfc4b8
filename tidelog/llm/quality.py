"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled 1 outside the held-out fold; the unlabelled
set is web text, labels unseen. The class prior is estimated from two
classifiers of positives against unlabelled rows, each learned on one half of
the sample and asked about rows of the other half of all documents: the least
ratio, over thresholds, of the share of all documents above it to that of the
positives. A small network then minimises
``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])``, stepping back
along the bracket's gradient where it turns negative.

Inputs are hashed shares of byte trigrams and of words, A-Z lower-cased, and
statistics of any text: kinds of characters, repetition, sizes. Training sees at
most ``SAMPLE`` rows of either kind (least hashes of doc_id and text); the prior
counts, and scores are given to, every row. Labels, language, source and doc_id
are no inputs.

Case handling: null text counts as empty; an empty text has a score like any
other; without positives or unlabelled rows all scores are 0.5; null labels and
labels of unknown rows teach nothing, a row labelled 1 once or more is positive,
and rows of equal doc_id and text are one row of the sample; a null doc_id
counts as the empty text for the fold; ties in a sample's order are equal rows;
further columns are ignored, whatever their names; a text of any length is
scored whole; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import prepare, texts

#: Rows of trusted positives, and of unlabelled text, that training sees at most.
SAMPLE = 6000
#: Hashed inputs of trigrams, and of words; bytes of a text that are hashed at once.
BUCKETS, PIECE = 512, 1 << 20
#: Factor on the standardised hashed inputs, which are many, beside the statistics.
HASHED = np.float32(0.05)
HIDDEN, STEPS, RATE, DECAY, SLACK = 8, 200, 0.01, 0.05, 0.0
#: Thresholds tried for the prior: quantiles of the positives' outputs.
CUTS = np.linspace(0.01, 0.3, 60)
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
SYMBOLS = b"#*$%&|<>!+=~^@{}[]\\_"
STOPS = b".,;:?"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _without(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def trigrams(lowered: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams."""
    counts, codes = np.zeros(BUCKETS, np.int64), np.frombuffer(lowered, np.uint8)
    for at in range(0, max(0, len(codes) - 2), PIECE):
        c = codes[at : at + PIECE + 2].astype(np.uint32)
        mixed = (c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]) * np.uint32(0x9E3779B1)
        counts += np.bincount((mixed >> np.uint32(16)) % np.uint32(BUCKETS), minlength=BUCKETS)
    return counts


def features(raw: bytes | None) -> np.ndarray:
    """Roots of shares of hashed trigrams and words; shares of kinds of characters, repetition of words and lines, and sizes."""
    raw = raw or b""
    lowered = raw.lower()
    counted = Counter(lowered.split())
    words, lines = raw.split(), raw.split(b"\n")
    size, n = max(1, len(raw)), max(1, len(words))
    hashes = np.fromiter(map(zlib.crc32, counted), np.int64, len(counted)) % BUCKETS
    by_word = np.bincount(hashes, np.fromiter(counted.values(), np.int64, len(counted)), BUCKETS)
    by_gram = trigrams(lowered)
    distinct, pairs = len(set(words)), len(set(zip(words, words[1:])))
    rest = [
        _without(raw, UPPER) / size, _without(raw, DIGITS) / size, _without(raw, SYMBOLS) / size, _without(raw, STOPS) / size, size / n / 10,
        distinct / n, pairs / n, sum(map(eq, words, words[1:])) / n, (len(lines) - len(set(lines))) / len(lines), len(lines) / n,
        float(not words),
    ]
    return np.concatenate([np.sqrt(by_gram / max(1, by_gram.sum())), np.sqrt(by_word / n), rest]).astype(np.float32)


WIDTH = len(features(b""))


def matrix(column: pa.Array) -> np.ndarray:
    found = [features(x) for x in texts(column)]
    return np.stack(found) if found else np.zeros((0, WIDTH), np.float32)


class Network:
    """Standardised inputs (hashed ones times HASHED), one hidden layer, one output; all weights in one list."""

    def __init__(self, inputs: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = inputs.mean(axis=0, dtype=np.float64).astype(np.float32), inputs.std(axis=0) + np.float32(1e-3)
        wide = inputs.shape[1]
        made = rng.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)
        self.weights = [w.astype(np.float32) for w in made]

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.deviation, -8, 8)
        scaled[:, : 2 * BUCKETS] *= HASHED
        return scaled

    def output(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return (np.tanh(self._scaled(x) @ a + b) @ c + d).astype(np.float64)

    def gradients(self, x: np.ndarray, slope) -> list[np.ndarray]:
        """Of scaled inputs, by each weight; ``slope`` gives the risk's derivative by the outputs."""
        a, b, c, d = self.weights
        hidden = np.tanh(x @ a + b)
        out = slope((hidden @ c + d).astype(np.float64)).astype(np.float32)
        back = np.outer(out, c) * (1 - hidden**2)
        return [x.T @ back, back.sum(axis=0), hidden.T @ out, out.sum(keepdims=True)]

    def fit(self, x: np.ndarray, slope) -> None:
        """Adam on the gradient, with decay of the two layers."""
        x = self._scaled(x)
        first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        for step in range(1, STEPS + 1):
            for w, m, v, g, decay in zip(self.weights, first, second, self.gradients(x, slope), (DECAY, 0, DECAY, 0)):
                g = g + decay * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def risk(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of the outputs of positives and unlabelled rows, under the logistic loss."""
    return prior * np.logaddexp(0, -p).mean() + max(0.0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())


def risk_slope(g: np.ndarray, n: int, prior: float) -> np.ndarray:
    """Derivative of the risk by the outputs, the first n of which are the positives'; where the bracket is negative, that which raises it."""
    p, u = g[:n], g[n:]
    negative = np.r_[-prior * sigmoid(p) / n, sigmoid(u) / len(u)]
    if np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean() < -SLACK:
        return -negative
    return np.r_[prior * (sigmoid(p) - 1) / n, np.zeros(len(u))] + negative


def apart(positive: np.ndarray, unlabelled: np.ndarray) -> Network:
    """A classifier of positives against unlabelled rows, both kinds weighing the same."""
    x, truth = np.concatenate([positive, unlabelled]), np.arange(len(positive) + len(unlabelled)) < len(positive)
    share = np.where(truth, 0.5 / len(positive), 0.5 / len(unlabelled))
    network = Network(x)
    network.fit(x, lambda g: share * (sigmoid(g) - truth))
    return network


def least_ratio(above: np.ndarray, n: int, reach: np.ndarray) -> float:
    """Share of positives among n rows of which ``above`` reach each of some cuts, and of the positives the shares ``reach``."""
    return float(np.clip(min(k / max(1, n) / max(r, 1e-9) for k, r in zip(above, reach)), 0.05, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
    """A network whose output is above 0 where positive is likelier."""
    x = np.concatenate([positive, unlabelled])
    network = Network(x)
    network.fit(x, lambda g: risk_slope(g, len(positive), prior))
    return network


def _half(of: str = "row_key") -> Column:
    return F.pmod(F.col(of), F.lit(2)).cast("int")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and row_key, a hash of both."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.withColumn("row_key", F.xxhash64("doc_id", "text"))


def _features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        x = matrix(part.column(2))
        starts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(starts, pa.array(x.ravel()))], ["kind", "row_key", "x"])


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of rows, whether they are trusted positives (else unlabelled), and their half; ``most`` rows of either kind."""
    spark = prepare(docs.sparkSession)
    rows = _keyed(docs)
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    good = spark.createDataFrame(good, "doc_id long")  # most ids at most
    chosen = []
    for kind, keys in ((1, rows.join(F.broadcast(good), "doc_id", "left_semi")), (0, rows)):
        chosen += [(r[0], kind) for r in keys.select("row_key").distinct().orderBy(F.xxhash64(F.lit(kind), "row_key"), "row_key").limit(most).collect()]
    chosen = spark.createDataFrame(chosen, "row_key long, kind int")  # 2 * most rows at most
    taken = rows.join(F.broadcast(chosen), "row_key").select("kind", "row_key", "text").mapInArrow(_features, "kind int, row_key long, x array<float>")
    taken = taken.groupBy("kind", "row_key").agg(F.first("x").alias("x")).toArrow().sort_by([("kind", "ascending"), ("row_key", "ascending")])
    kind, half = taken.column("kind").to_numpy(), taken.column("row_key").to_numpy() % 2
    x = np.concatenate([c.flatten().to_numpy() for c in taken.column("x").chunks]).reshape(-1, WIDTH) if len(kind) else np.zeros((0, WIDTH), np.float32)
    return x, kind == 1, half


def _counted(networks: list[Network], cuts: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows there are, and how many reach each cut."""
        total = np.zeros(len(cuts) + 1, np.int64)
        for part in parts:
            half, x = part.column(0).to_numpy(), matrix(part.column(1))
            for k, network in enumerate(networks):
                out = network.output(x[half == k])
                total += np.r_[len(out), len(out) - np.searchsorted(np.sort(out), cuts[:, k])]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "n"])

    return run


def corpus_prior(docs: DataFrame, x: np.ndarray, positive: np.ndarray, half: np.ndarray) -> float:
    """The class prior over all documents, each asked of the classifier that learned from the other half."""
    networks, outputs = [], []
    for k in (0, 1):
        learn, ask = ([np.flatnonzero(positive & (half == h)), np.flatnonzero(~positive & (half == h))] for h in (1 - k, k))
        whole = [np.flatnonzero(positive), np.flatnonzero(~positive)]
        p, u = (own if len(own) else every for own, every in zip(learn, whole))
        networks.append(apart(x[p], x[u]))
        outputs.append(networks[k].output(x[ask[0] if len(ask[0]) else whole[0]]))
    cuts = np.column_stack([np.quantile(o, CUTS) for o in outputs])
    counted = _keyed(docs).select(_half().alias("half"), "text").mapInArrow(_counted(networks, cuts), "at long, n long")
    n, *above = (r[0] for r in counted.groupBy("at").agg(F.sum("n")).orderBy("at").select("sum(n)").collect())  # a row for each cut
    reach = np.column_stack([(o[:, None] >= cuts[:, k]).mean(axis=0) for k, o in enumerate(outputs)]).mean(axis=1)
    return least_ratio(above, n, reach)


def _score(network: Network | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            score = sigmoid(network.output(matrix(part.column(1)))) if network else np.full(len(part), 0.5)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[Network | None, float]:
    """The network, none without positives or documents, and the class prior."""
    x, positive, half = sample(docs, labels, most)
    if positive.all() or not positive.any():
        return None, 0.5
    prior = corpus_prior(docs, x, positive, half)
    return train(x[positive], x[~positive], prior), prior


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each document."""
    network, _ = learn(docs, labels)
    scored = _keyed(docs).select("doc_id", "text").mapInArrow(_score(network), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
