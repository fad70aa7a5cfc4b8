"""The Gray-order index: what it finds and drops, how it is dealt, and components with hubs."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from tidelog.llm import components as stars
from tidelog.llm import oracles
from tidelog.llm import simhash
from tidelog.llm.components import components


def near(n, seed=1):
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 2**64, n, dtype=np.uint64)
    return np.unique(np.r_[fp, fp[: n // 5] ^ (np.uint64(7) << rng.integers(0, 61, n // 5).astype(np.uint64)), fp[: n // 5] ^ np.uint64(1)])


def test_sql_hash():
    rng = random.Random(1)
    texts = sorted({"".join(rng.choice("abé日 x") for _ in range(n)) for n in range(120) for _ in range(2)})
    con = duckdb.connect()
    con.execute("create table t(s varchar)")
    con.executemany("insert into t values (?)", [(x,) for x in texts])
    got = dict(con.sql(oracles.xxh64("SELECT s FROM t", 42)).fetchall())
    assert got == {x: xxhash.xxh64_intdigest(x.encode(), 42) for x in texts}


def test_ranks():
    ranks = np.arange(4096, dtype=np.uint64)
    gray = ranks ^ ranks >> np.uint64(1)
    assert (simhash.gray_rank(gray) == ranks).all()


@pytest.mark.parametrize("most", [0, 1, 3])
def test_links_and_pruning(most):
    fp = near(1200)
    group = (fp >> np.uint64(63)).astype(np.int64)
    index = simhash.GrayIndex(group, fp)
    found = {frozenset((int(index.fp[a]), int(index.fp[b]))) for x, y in index.links(most) for a, b in zip(x, y)}
    want = {frozenset((a, b)) for a, b in combinations(fp.tolist(), 2) if a >> 63 == b >> 63 and (a ^ b).bit_count() <= most}
    assert found == want and (want or not most)
    pairs = sum(n * (n - 1) / 2 for n in np.bincount(group))
    assert index.asked - index.dropped < pairs and index.dropped > 0.4 * index.asked
    if most <= 1:
        assert index.asked < 0.25 * pairs  # whole groups go without their members being asked


@pytest.mark.parametrize("n", [0, 1, 500, 5000, 10**6, 10**9, 10**12, 10**15])
def test_dealing(n):
    blocks, bits = simhash.dealing(n, 3)
    assert 4 <= blocks <= 6 and bits <= (blocks - 3) * 64 // blocks
    if 512 <= n <= 10**12:
        assert 512 <= n / 2**bits < 1024


@pytest.mark.parametrize("hub", [1, 500])
def test_hubs(spark, monkeypatch, hub):
    """One node with half of all edges, chains and a clique; joined by broadcast of hubs or by a shuffle alone."""
    monkeypatch.setattr(stars, "HUB", hub)
    monkeypatch.setattr(stars, "HUBS", 20)
    rng = random.Random(3)
    edges = [(5000, k) for k in rng.sample(range(1000, 4000), 1500)] + [(k, k + 1) for k in range(200)] + list(combinations(range(300, 330), 2)) + [(310, 150), (None, 1), (9, 9), (9, 9)]
    rng.shuffle(edges)
    want = {}
    for u, v in (e for e in edges if None not in e and e[0] != e[1]):
        want.setdefault(u, {u}).add(v)
        want.setdefault(v, {v}).add(u)
    root = {}
    for k in sorted(want):
        todo = [] if k in root else [k]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = k
                todo += want[x]
    df = spark.createDataFrame(edges, "u long, v long").selectExpr("u", "v", "1 as m", "2 as edges")
    got = [(r.node, r.root) for r in components(df).collect()]
    assert len(got) == len(root) and dict(got) == root
    assert components(df.limit(0)).count() == 0
