"""Connected components over an edge table, by alternating star contractions.

Every round is two aggregations and two joins over the edges, so no node's neighbourhood is ever collected:
minima combine map-side, and a hot node is only a hot join key, which adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parallelism, trimmed


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the trees of a[i] and b[i] for all i. ``labels`` is flat before and after; a root is its tree's minimum."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped


@trimmed
def _contract_locally(batches):
    """Replace a task's edges by (node, smallest node it reaches through this task's edges)."""
    held_u, held_v = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        u = np.concatenate([held_u, batch["u"].to_numpy(np.int64)])
        v = np.concatenate([held_v, batch["v"].to_numpy(np.int64)])
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        labels = unite(np.arange(len(nodes)), at[: len(u)], at[len(u) :])
        apart = labels != np.arange(len(nodes))
        held_u, held_v = nodes[apart], nodes[labels[apart]]
    yield pd.DataFrame({"u": held_u, "v": held_v})


def _toward_minimum(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. large: every node's larger neighbours are hung on its neighbourhood's minimum; small: its smaller ones."""
    if large:
        around = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = around.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = joined.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))))
    return moved.where(F.col("u") != F.col("v"))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest id reachable from every node that has an edge to another node.

    Nulls and self-edges are ignored; repeated edges count once; an empty table gives an empty result. Nodes
    without edges don't appear. Raises if the rounds don't converge (they are logarithmic in the longest path).
    """
    start = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u != v")
    # as many tasks as a shuffle has: what unions of small tables add contracts in one place
    current = cut(start.coalesce(parallelism(edges)).mapInPandas(_contract_locally, "u long, v long"))
    before = None
    for _ in range(max_rounds):
        # a round that changes nothing has left stars: every edge goes from a node to its root
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        if now == before or not now[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
        before = now
        current = cut(_toward_minimum(_toward_minimum(current, large=True), large=False).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
