"""Decontamination against brute force where letters, repeats and places are awkward."""

import random
import time

import pytest

from tidelog.llm import decontaminate

from test_llm import brute_contamination

SIGMAS = [f"{c}Σ" for c in "ΑΒΓΔΕΖΗΘΙΚΛΜΝ"]  # whose lower case would depend on what stands beside them
ITEMS = [
    (1, " ".join(SIGMAS)),
    (2, "word " * 300),
    (3, "İx Kelvin K å " * 5),
    (4, " ".join(random.Random(1).choice("abc") for _ in range(200))),
    (5, "q r s t u v w"),
    (6, "q r s t u v w x y z a b"),
    (7, "zz"),
    (7, "zz"),
]
DOCS = [
    (1, ".".join(SIGMAS)), (2, " ".join(SIGMAS)), (3, "word " * 500), (4, "İX Kelvin K å " * 7), (5, " ".join(random.Random(2).choice("abc") for _ in range(900))),
    (6, "a a q r s t u v w x y z a b"), (7, "zz"), (8, "zz q r s t u v"), (9, "a b c d e f g " * 100), (10, "x " * 11 + "word " * 13), (11, "word " * 12), (12, "word " * 13 + "x"),
    *((20 + i, " ".join(random.Random(i).choice("ab") for _ in range(5 * i))) for i in range(40)),
]


@pytest.mark.parametrize("items", [ITEMS, ITEMS[:4]])
def test_awkward_texts(spark, items):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: brute_contamination(t, items) for i, t in DOCS}


def test_random_places(spark):
    """Shared spans of 11 to 40 words at any place of either text, at their ends too."""
    rng = random.Random(9)
    some = lambda n: [rng.choice("abcdefghijklm") + rng.choice("nop") for _ in range(n)]
    items = [(i, " ".join(some(60))) for i in range(6)]
    docs = []
    for i in range(80):
        words = items[rng.randrange(6)][1].split()
        n, at = rng.choice([11, 12, 13, 14, 25, 40]), rng.randrange(20)
        docs.append((i, " ".join([*some(rng.choice([0, 1, 30])), *words[at : at + n], *some(rng.choice([0, 2, 30])), *words[-n:]])))
    got = {r[0]: tuple(r[1:]) for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: brute_contamination(t, items) for i, t in docs}


def test_long_repeats(spark):
    docs = [(1, "w " * 20_000), (2, "w x y " * 10_000)]
    items = [(1, "w " * 5000), (2, "y w x " * 4000)]
    began = time.time()
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got} == {(1, 20_000, 20_000, 1), (2, 30_000, 30_000, 1)}
    assert time.time() - began < 120


def test_clashing_names_and_plan(spark):
    names = "doc_id long, text string, hash long, words string, around string, items string, n_hit long, text_key string"
    docs = spark.createDataFrame([(1, " ".join(SIGMAS), 1, "a", "b", "c", 2, "d"), (None, None, None, None, None, None, None, None)], names)
    found = decontaminate.contamination(docs, docs, item_col="doc_id")
    assert sorted((r.n_words, r.n_hit) for r in found.collect()) == [(0, 0), (13, 13)]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
