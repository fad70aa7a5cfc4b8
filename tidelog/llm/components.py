"""Connected components of an edge list by alternating large and small stars.

Each round joins every edge to the least neighbour of its end and regroups; the
stars' edges never outnumber the input's. Rounds grow with the logarithm of the
longest path. Least neighbours are pre-aggregated minima. Those of hubs, nodes
with more than ``HUB`` edges and more than one in ``HUBS`` of all, are broadcast,
so a hub's edges stay where they are; by the second condition there are at most
2 * HUBS hubs, whatever the edges. The other nodes' are joined by a shuffle.
Every round is checkpointed in the shared folder, so a lost executor costs no
more than the round.

Case handling: loops and repeated edges add nothing; rows with a null end are
ignored; no edges give no rows; the least node of a component is its root, so
there are no ties; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut

#: Edges of a hub at least, and hubs at most (half of them).
HUB, HUBS = 500, 10_000


def _with_least(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, m) of at most 2 * n edges, m the least of u and its neighbours, and (u, m) of each node."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("edges"))
    is_hub = F.col("edges") > max(HUB, n // HUBS)
    marked = edges.join(F.broadcast(least.where(is_hub).select("u", "m")), "u", "left")
    others = marked.where("m is null").drop("m").join(least.where(~is_hub).select("u", "m"), "u")
    return marked.where("m is not null").unionByName(others), least.select("u", "m")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, n)[0].where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    joined, least = _with_least(down, n)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v), longs: root is the least node reachable."""
    edges = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    state = _state(edges)
    while state[0]:
        edges = cut(_small_star(_large_star(edges, state[0]), state[0]))
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
