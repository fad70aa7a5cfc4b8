"""The risk against its definition, its gradient against differences, the prior, samples and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import quality

SF = "/root/testdata/sf0.01"


def test_risk():
    rng = np.random.default_rng(1)
    for prior, shift in ((0.3, 0.0), (0.8, 2.0), (0.9, -3.0)):
        p, u = rng.normal(shift, 1, 20), rng.normal(0, 1, 30)
        loss = lambda g: np.log(1 + np.exp(-g))
        bracket = sum(loss(-g) for g in u) / 30 - prior * sum(loss(-g) for g in p) / 20
        assert abs(quality.risk(p, u, prior) - (prior * sum(loss(g) for g in p) / 20 + max(0, bracket))) < 1e-9
        slope, step = quality.risk_slope(np.r_[p, u], 20, prior), 1e-6
        for k in range(50):
            up, down = (np.r_[p, u] + s * step * np.eye(50)[k] for s in (1, -1))
            of = (lambda g: quality.risk(g[:20], g[20:], prior)) if bracket > 0 else lambda g: prior * np.logaddexp(0, g[:20]).mean() - np.logaddexp(0, g[20:]).mean()  # noqa: B023
            assert abs((of(up) - of(down)) / (2 * step) - slope[k]) < 1e-6


def test_gradients():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (12, quality.WIDTH)).astype(np.float32)
    network = quality.Network(x)
    network.weights = [w.astype(np.float64) for w in network.weights]
    scaled = network._scaled(x).astype(np.float64)
    risk = lambda: quality.risk((g := np.tanh(scaled @ network.weights[0] + network.weights[1]) @ network.weights[2] + network.weights[3])[:5], g[5:], 0.4)
    found = network.gradients(scaled, lambda g: quality.risk_slope(g, 5, 0.4))
    for w, g in zip(network.weights, found):
        for at in random.Random(3).sample(range(w.size), min(w.size, 6)):
            flat, step = w.reshape(-1), 1e-5
            flat[at] += step
            up = risk()
            flat[at] -= 2 * step
            assert abs((up - risk()) / (2 * step) - g.reshape(-1)[at]) < 1e-4
            flat[at] += step


def test_inputs():
    x = quality.features(b"The the cat \xc3\xa9")
    assert abs((x[: quality.BUCKETS] ** 2).sum() - 1) < 1e-5 and abs((x[quality.BUCKETS : 2 * quality.BUCKETS] ** 2).sum() - 1) < 1e-5
    long = b"some words of a text " * 200_000
    assert (quality.trigrams(long) == sum(quality.trigrams(long[i * 1000 : i * 1000 + 1002]) for i in range(len(long) // 1000))).all()
    assert np.abs(quality.features(long)[: quality.BUCKETS] - quality.features(long[:4200])[: quality.BUCKETS]).max() < 0.01
    assert quality.features(None).shape == (quality.WIDTH,) and np.isfinite(quality.features(b"")).all()


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    network, prior = quality.learn(docs, labels)
    share = labels.agg(F.avg("quality")).first()[0]
    assert network and abs(prior - share) < 0.05
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    ranks, n = rows.score.rank(), rows.quality.sum()
    assert (ranks[rows.quality == 1].sum() - n * (n + 1) / 2) / (n * (len(rows) - n)) > 0.98
    assert (rows.predicted == rows.quality).mean() > 0.95 and ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def test_samples_are_bounded(spark):
    """A doc_id repeated often, with one text and with many, gives no more than the bound of rows to the driver."""
    rows = [(1, "same text")] * 300 + [(2, f"text {i}") for i in range(300)] + [(i, "junk ### ***") for i in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("row_key", F.lit(0))
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 0), (None, 1), (99, None)], "doc_id long, quality int")
    x, positive, half = quality.sample(docs, labels, 50)
    assert positive.sum() <= 50 and (~positive).sum() <= 50 and len(x) == len(half)
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)


@pytest.mark.parametrize("text", ["", None, "w " * 400_000, "x" * 1_000_000])
def test_any_text_has_a_score(spark, text):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([text, "good prose here", "bad ### ***", "more good prose"])], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (0, 1), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, labels).collect())
