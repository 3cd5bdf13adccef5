"""Approximate nearest neighbours from a forest of random-projection trees with a shared priority queue.

A tree halves the vectors at the median of their projection on a random direction, then the halves on the next one; all nodes of one depth share a direction, and the directions of a tree are
orthonormal. So the squared violations along a path (by how much a query lies on the other side of a split) add up to a lower bound of the squared distance to everything in the leaf. A query
walks all trees by one queue ordered by that sum: it pops the closest branch of any tree, descends to its leaf and queues the other sides. It ends when the next branch's bound exceeds a
share of the squared distance of its k-th neighbour so far, as found in the first leaves of one tree. The vectors of the leaves are then ranked by exact distance.

The splits are fitted on a bounded sample; every row is put into a leaf of every tree. Neighbouring leaves make a shelf; the rows of a shelf meet the queries that visit it in cells of bounded size.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, trimmed
from .embed_dedup import usable

#: Rows of a cell and queries of a block (what one group holds), queries in one product, and rows that a shelf is planned for.
CELL, BLOCK, TILE, SHELF = 8192, 2048, 256, 4096
#: Bytes of the fitting sample, as doubles.
SAMPLE_BYTES = 64 << 20
#: A leaf's share of the fitting sample is at least so many rows, so that medians mean something.
FITTED = 32


@dataclass
class Forest:
    """Directions (tree, depth, dimension) and split values (tree, node); node 1 is a root, 2i and 2i + 1 the sides of i. Its size is bounded by that of the sample."""

    directions: np.ndarray
    splits: np.ndarray

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tkd->tnk", x, self.directions, optimize=True)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(row, tree): the number of the leaf that holds each row."""
        p = self.project(x)
        node = np.ones(p.shape[:2], np.int64)
        for k in range(self.depth):
            node = 2 * node + (p[:, :, k] >= np.take_along_axis(self.splits, node, axis=1))
        return (node - (1 << self.depth)).T

    def visits(self, p: np.ndarray, trees: int, most: float, first: int | None = None):
        """(tree, leaf) of one query's projections p (tree, depth) in the order of the shared queue: while the bound is at most ``most``, or the ``first`` leaves."""
        queue = [(0.0, t, 1, 0) for t in range(trees)]
        left = first if first is not None else -1
        while queue and left:
            bound, t, node, k = heapq.heappop(queue)
            if bound > most:
                return
            while k < self.depth:
                margin = p[t, k] - self.splits[t, node]
                near = 2 * node + (margin >= 0)
                heapq.heappush(queue, (bound + margin * margin, t, near ^ 1, k + 1))
                node, k = near, k + 1
            yield t, node - (1 << self.depth)
            left -= 1


def _floats(packed: pd.Series, kind: str) -> np.ndarray:
    """Vectors packed as bytes, in doubles."""
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
    """Random orthonormal directions and, node by node, medians of the sample's projections. A node without sample rows takes 0."""
    rng = np.random.default_rng(seed)
    directions = np.stack([np.linalg.qr(rng.standard_normal((sample.shape[1], depth)))[0].T for _ in range(trees)])
    splits = np.zeros((trees, 1 << depth))
    projected = np.einsum("nd,tkd->tkn", sample, directions, optimize=True)
    for t in range(trees):
        node = np.ones(len(sample), np.int64)
        for k in range(depth):
            order = np.lexsort((projected[t, k], node))
            held = node[order]
            starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
            ends = np.r_[starts[1:], len(held)]
            splits[t, held[starts]] = projected[t, k][order[(starts + ends) // 2]]
            node = 2 * node + (projected[t, k] >= splits[t, node])
    return Forest(directions, splits)


@trimmed
def _packed(batches, kind: str):
    for batch in batches:
        yield pd.DataFrame({"vec_id": batch["vec_id"], "uid": batch["uid"], "v": [np.asarray(v, kind).tobytes() for v in batch["embedding"]]})


@trimmed
def _route(batches, forest: Forest, kind: str):
    for batch in batches:
        if len(batch):
            yield batch.assign(leaf=list(forest.leaves(_floats(batch["v"], kind)).astype(np.int32)))


@trimmed
def _visit(batches, forest: Forest, kind: str, trees: int, first: int | None, share: float, per: int):
    """The shelves that each query visits, with the leaves it visits there."""
    for batch in batches:
        if not len(batch):
            continue
        projected = forest.project(_floats(batch["v"], kind))
        for i, (rep, v, bound) in enumerate(zip(batch["rep"], batch["v"], batch["bound"])):
            on: dict[tuple[int, int], list[int]] = {}
            for t, leaf in forest.visits(projected[:, i], trees, bound * bound * share, first):
                on.setdefault((t, int(leaf) // per), []).append(int(leaf))
            yield pd.DataFrame({"tree": [t for t, _ in on], "shelf": [s for _, s in on], "rep": rep, "v": [v] * len(on), "leaf": list(on.values())})


def _nearest(rows: pd.DataFrame, kind: str, k: int) -> pd.DataFrame:
    """The k nearest rows of a cell to each query of a block, among the leaves that the query visits."""
    asks = (rows["side"] == 0).to_numpy()
    out = [pd.DataFrame({"rep": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "uid": np.empty(0, np.int64), "score": np.empty(0)})]
    if not asks.any() or asks.all():
        return out[0]
    q, v = _floats(rows["v"][asks], kind), _floats(rows["v"][~asks], kind)
    reps, ids, uids = rows["id"].to_numpy()[asks], rows["id"].to_numpy()[~asks], rows["uid"].to_numpy()[~asks]
    leaf = np.array([x[0] for x in rows["leaf"][~asks]])
    names, at = np.unique(leaf, return_inverse=True)
    visited = np.zeros((len(q), len(names)), bool)
    for i, wanted in enumerate(rows["leaf"][asks]):
        visited[i] = np.isin(names, wanted)
    squares = (v * v).sum(axis=1)
    for low in range(0, len(q), TILE):
        part = q[low : low + TILE]
        own = (part * part).sum(axis=1)
        near = own[:, None] + squares - 2 * part @ v.T
        near[~visited[low : low + TILE][:, at]] = np.inf
        for i in range(len(part)):
            among = np.flatnonzero(visited[low + i][at])
            if len(among) > k:
                kth = np.partition(near[i], k - 1)[k - 1]
                slack = 1e-12 * len(part[i]) * (own[i] + squares.max())  # products round; what could be among the k nearest is measured exactly
                among = np.flatnonzero(near[i] <= kth + slack)
            d = np.sqrt(((v[among] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((uids[among], ids[among], d))[:k]
            out.append(pd.DataFrame({"rep": reps[low + i], "vec_id": ids[among][best], "uid": uids[among][best], "score": d[best]}))
    return pd.concat(out, ignore_index=True)


def _at(values: np.ndarray, *place: Column) -> Column:
    """Element of a table of whole numbers (tree, shelf), by columns."""
    t, s = place
    return F.element_at(F.element_at(F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in values]), t + 1), s + 1)


def _per_shelf(df: DataFrame, trees: int, shelves: int) -> np.ndarray:
    """Rows of each (tree, shelf): a bounded table."""
    held = np.zeros((trees, shelves), np.int64)
    for r in df.groupBy("tree", "shelf").count().collect():
        held[r["tree"], r["shelf"]] = r["count"]
    return held


def _searched(queries: DataFrame, routed: DataFrame, forest: Forest, kind: str, k: int, trees: int, first: int | None, share: float, per: int) -> DataFrame:
    """rep, vec_id, uid, score: what cells found for the queries (rep, v, bound), k rows a cell and query at most."""
    visits = cut(queries.mapInPandas(partial(_visit, forest=forest, kind=kind, trees=trees, first=first, share=share, per=per), "tree int, shelf int, rep long, v binary, leaf array<int>"))
    placed = routed.select("vec_id", "uid", "v", F.posexplode(F.slice("leaf", 1, trees)).alias("tree", "at")).withColumn("shelf", F.expr(f"cast(at div {per} as int)"))
    shelves = -(-(1 << forest.depth) // per)
    cells = np.maximum(1, -(-_per_shelf(placed, trees, shelves) // CELL))
    blocks = -(-_per_shelf(visits, trees, shelves) // BLOCK)
    where = (F.col("tree"), F.col("shelf"))
    rows = placed.where(_at(blocks, *where) > 0).withColumn("cell", F.pmod(F.xxhash64("vec_id", "uid"), _at(cells, *where)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), (_at(blocks, *where) - 1).cast("int"))))
    asking = visits.withColumn("block", F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), _at(blocks, *where))).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), (_at(cells, *where) - 1).cast("int"))))
    key = ("tree", "shelf", "cell", "block")
    both = asking.select(*key, F.lit(0).alias("side"), F.col("rep").alias("id"), F.lit(0).cast("long").alias("uid"), "v", "leaf").union(rows.select(*key, F.lit(1), "vec_id", "uid", "v", F.array("at")))
    return both.groupBy(*key).applyInPandas(lambda part: _nearest(part, kind, k), "rep long, vec_id long, uid long, score double")


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = 4, leaf_rows: int = 128, share: float = 0.2, first: int = 4, sample_rows: int = 1 << 17, seed: int = 11) -> DataFrame:
    """The k rows of smallest Euclidean distance found for every query row of ``vectors`` (vec_id, embedding): query_id, rank (from 1), vec_id, score.

    Queries are rows that ``is_query`` (a condition on vec_id) selects; candidates are all rows but those of the query's own id. score is the distance in double precision, by the original
    vectors; ties go to the smaller vec_id. If there are fewer than k candidates, all found are returned.

    The search is approximate: ``trees`` trees with leaves of about ``leaf_rows`` rows; a query ends where the queue's bound exceeds ``share`` * depth / dimensions of the squared distance of its k-th
    neighbour within the ``first`` leaves of one tree (a neighbour's difference has about depth / dimensions of its square within a tree's directions). That rule doesn't depend on the table's size, and
    no number of candidates is fixed. Splits are fitted on a sample by hash of about ``sample_rows`` vectors (and ``SAMPLE_BYTES``) at most, which bounds the depth (``FITTED`` sample rows a leaf); beyond it leaves grow. All rows are indexed.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without vec_id. All vectors that take part must have one length; another raises. An
    empty table gives no rows; extra columns are ignored. Equal vectors are searched once, and of the rows of one vector those are kept as candidates that some answer can hold: k of the smallest
    vec_id and k of other ids. Rows that repeat a vec_id are candidates of their own, but not for that id's query (an id of more than k different vectors close to each other may leave its own
    query fewer than k); of several query rows of one id the smallest vector asks. Components beyond 1e150 overflow to infinite distances.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding")).where(usable("embedding") & F.col("vec_id").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("embedding"))
    # k rows of a vector's smallest id and k of its others; both ranks are cut before the exchange, so a vector of many rows is a few rows of each task
    same = Window.partitionBy("h", "embedding").orderBy("vec_id")
    least = rows.groupBy("h", "embedding").agg(F.min("vec_id").alias("least"))
    smallest = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k)
    others = rows.join(least, ["h", "embedding"]).where("vec_id > least").drop("least").withColumn("copy", F.row_number().over(same) + k).where(F.col("copy") <= 2 * k)
    kept = smallest.join(least, ["h", "embedding"]).where("vec_id = least").drop("least").unionByName(others)
    packed = kept.withColumn("uid", F.col("h").bitwiseXOR(F.col("copy").cast("long"))).select("vec_id", "uid", "embedding").mapInPandas(partial(_packed, kind=kind), "vec_id long, uid long, v binary")
    candidates = stored(packed)
    total, shortest, longest = candidates.agg(F.count("*"), F.min(F.length("v")), F.max(F.length("v"))).first()
    if not total:
        return empty
    if shortest != longest:
        raise ValueError(f"vectors of {shortest // np.dtype(kind).itemsize} and {longest // np.dtype(kind).itemsize} components")
    d = longest // np.dtype(kind).itemsize
    # the sample is a bounded number of rows, and of bytes, by hash
    rate = min(1.0, min(sample_rows, SAMPLE_BYTES // (8 * d)) / total)
    picked = candidates.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < int(rate * (1 << 30))).select("v").collect()
    sample = _floats(pd.Series([r["v"] for r in picked] or [candidates.first()["v"]]), kind)
    depth = int(np.clip(np.ceil(np.log2(max(1.0, total / leaf_rows))), 1, max(1, min(d, np.log2(max(2, len(sample) / FITTED)))))) if total > 1 else 1
    forest = fit_forest(sample, trees, depth, seed)
    per = max(1, int(SHELF / max(1.0, total / (1 << depth))))
    routed = stored(candidates.mapInPandas(partial(_route, forest=forest, kind=kind), "vec_id long, uid long, v binary, leaf array<int>"))
    # queries of one vector are one search, named by their smallest id
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("uid", F.xxhash64("embedding")).mapInPandas(partial(_packed, kind=kind), "vec_id long, uid long, v binary")
    asked = cut(asked.select(F.col("vec_id").alias("query_id"), "v"))
    searches = cut(asked.groupBy("v").agg(F.min("query_id").alias("rep")))
    started = searches.select("rep", "v", F.lit(float("inf")).alias("bound"))
    seeds = _searched(started, routed, forest, kind, 2 * k, 1, first, 1.0, per)
    reached = seeds.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec_id", "uid"))).where(F.col("r") <= k + 1).groupBy("rep").agg(F.max("score").alias("far"), F.count("*").alias("n")).where(F.col("n") == k + 1)
    bounded = searches.join(reached, "rep", "left").select("rep", "v", F.coalesce("far", F.lit(float("inf"))).alias("bound"))
    found = _searched(bounded, routed, forest, kind, 2 * k, trees, None, share * depth / d, per)
    order = Window.partitionBy("rep").orderBy("score", "vec_id", "uid")
    best = found.groupBy("rep", "vec_id", "uid").agg(F.min("score").alias("score")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * k)
    members = asked.join(searches, "v").select("query_id", "rep")
    named = members.join(best, "rep").where("vec_id != query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id", "uid")))
    return named.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
