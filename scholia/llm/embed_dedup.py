"""Embedding near-dedup: an exact metric range join on the unit sphere.

cosine >= c is Euclidean distance <= r = sqrt(2 - 2c) between unit vectors. Pivots partition the vectors into cells
(nearest pivot). By the triangle inequality a vector b can have a partner in cell p only if
d(b, p) <= d(b, home pivot) + 2r and d(b, p) <= radius(p) + r, so b is replicated to those cells (of each two cells, the lower-numbered does
the work) and every cell is joined on its own: its home vectors against all that were sent to it. Cells are cut into chunks, so a
cell that holds a third of all rows is many tasks. A chunk pair returns one count per home vector and a spanning forest of
its links; pairs never leave the task.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side, trimmed
from .graph import connected_components, unite

#: Bytes of vectors on either side of one chunk pair, and vectors in one matrix product inside it.
CHUNK_BYTES, TILE = 8 << 20, 1024


def usable_or_zero(vector: str) -> F.Column:
    """Vectors that are not null or empty and whose components are all finite."""
    return F.expr(f"coalesce(size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)")


def usable(vector: str) -> F.Column:
    """Of those, the vectors that have a direction."""
    return usable_or_zero(vector) & F.expr(f"exists({vector}, x -> x != 0)")


def _unit(rows) -> np.ndarray:
    x = np.array(list(rows), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrix(packed: pd.Series) -> np.ndarray:
    """Unit vectors packed as bytes of doubles."""
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


@trimmed
def _homes(batches, pivots: np.ndarray):
    for batch in batches:
        for low in range(0, len(batch), TILE):
            part = batch.iloc[low : low + TILE]
            x = _unit(part["embedding"])
            d = _distances(x, pivots)
            home = d.argmin(axis=1)
            yield pd.DataFrame({"class": part["class"].to_numpy(), "copies": part["copies"].to_numpy(), "unit": [row.tobytes() for row in x], "home": home, "away": d[np.arange(len(d)), home]})


def _in_reach(part: pd.DataFrame, pivots: np.ndarray, radii: np.ndarray, reach: float) -> np.ndarray:
    """Which cells each vector is sent to: its own, and of those numbered below it the ones where the triangle inequality allows a partner.

    A pair of two cells is found in the lower one alone, for both of its vectors.
    """
    home = part["home"].to_numpy(np.int64)
    d = _distances(_matrix(part["unit"]), pivots)
    eps = 1e-9
    sent = (d <= part["away"].to_numpy()[:, None] + 2 * reach + eps) & (d <= radii[None, :] + reach + eps) & (np.arange(len(pivots)) < home[:, None])
    sent[np.arange(len(part)), home] = True
    return sent


@trimmed
def _reach_counts(batches, pivots: np.ndarray, radii: np.ndarray, reach: float):
    """How many vectors each cell will be sent, summed per task."""
    total = np.zeros(len(pivots), np.int64)
    for batch in batches:
        for low in range(0, len(batch), TILE):
            total += _in_reach(batch.iloc[low : low + TILE], pivots, radii, reach).sum(axis=0)
    yield pd.DataFrame({"home": np.arange(len(pivots)), "sent": total})


@trimmed
def _replicas(batches, pivots: np.ndarray, radii: np.ndarray, chunks: np.ndarray, sent_chunks: np.ndarray, reach: float):
    """A row for each task that needs the vector. side 0: home vector of the cell; 1: sent from the cell itself; 2: sent from another cell."""
    for batch in batches:
        for low in range(0, len(batch), TILE):
            part = batch.iloc[low : low + TILE]
            ids, home = part["class"].to_numpy(np.int64), part["home"].to_numpy(np.int64)
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            row, task, side = [], [], []
            r, c = np.nonzero(_in_reach(part, pivots, radii, reach))
            e = (salt[r] % sent_chunks[c].astype(np.uint64)).astype(np.int64)
            for i in range(int(chunks[c].max(initial=1))):
                m = chunks[c] > i
                row.append(r[m]), task.append((c[m] << 40) + (i << 20) + e[m]), side.append(np.where(c[m] == home[r[m]], 1, 2))
            h = (salt % chunks[home].astype(np.uint64)).astype(np.int64)
            for i in range(int(sent_chunks[home].max(initial=1))):
                m = np.flatnonzero(sent_chunks[home] > i)
                row.append(m), task.append((home[m] << 40) + (h[m] << 20) + i), side.append(np.zeros(len(m), np.int64))
            out = part[["class", "copies", "unit"]].iloc[np.concatenate(row)].reset_index(drop=True)
            yield out.assign(task=np.concatenate(task), side=np.concatenate(side))


def _join_chunk(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of one chunk pair: (a, a, n) counts linked copies of vector a; (a, b, 0) is an edge of the spanning forest."""
    side = rows["side"].to_numpy()
    ids, copies, x = rows["class"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64), _matrix(rows["unit"])
    home, sent = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
    names, at = np.unique(ids, return_inverse=True)
    labels, n = np.arange(len(names)), np.zeros(len(names), np.int64)
    rough = x.astype(np.float32)  # single precision proposes, with room for its error; double precision decides
    for i in range(0, len(home), TILE):
        for j in range(0, len(sent), 4 * TILE):
            a, b = home[i : i + TILE], sent[j : j + 4 * TILE]
            p, q = np.nonzero(rough[a] @ rough[b].T >= np.float32(least - 1e-4))
            p, q = a[p], b[q]
            for k in range(0, len(p), 1 << 18):
                u, v = p[k : k + (1 << 18)], q[k : k + (1 << 18)]
                linked = np.einsum("ij,ij->i", x[u], x[v]) >= least
                u, v = u[linked], v[linked]
                n += np.bincount(at[u], weights=copies[v], minlength=len(names)).astype(np.int64)
                back = side[v] == 2  # the other vector is nobody's home vector here, so its count is made here too
                n += np.bincount(at[v[back]], weights=copies[u[back]], minlength=len(names)).astype(np.int64)
                labels = unite(labels, at[u], at[v])
    moved = np.flatnonzero(labels != np.arange(len(names)))
    some = np.flatnonzero(n)
    return pd.DataFrame({"a": np.concatenate([names[some], names[moved]]), "b": np.concatenate([names[some], names[labels[moved]]]), "n": np.concatenate([n[some], np.zeros(len(moved), np.int64)])})


def embedding_duplicates(embeddings: DataFrame, cosine: float = 0.9, vectors_per_cell: int = 8192, max_pivots: int = 1024, seed: str = "pivots") -> DataFrame:
    """Groups of ``embeddings`` (vec_id, embedding) linked by cosine similarity >= ``cosine`` in double precision.

    Returns one row per input row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id that links reach, itself
    included), kept (vec_id is its component's id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. All vectors that take part must have one
    length; another length raises. Equal vectors are one class, joined once and counted with its multiplicity. Rows that repeat a vec_id are vectors of
    their own, each with its own links. Rows with a null vec_id are returned with no links and kept. Extra columns are ignored.

    Pivots are the vectors of smallest hash, one for every ``vectors_per_cell`` classes and ``max_pivots`` at most: a documented bound on
    what the driver holds (max_pivots x dimension doubles). They only steer the partitioning; the join is exact with any pivots.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = cut(given.select("vec_id", F.when(usable("embedding") & F.col("vec_id").isNotNull(), F.col("embedding")).alias("embedding"), F.monotonically_increasing_id().alias("row")))
    good = rows.where("embedding is not null")
    # a class is known by one of its rows; only vectors of several rows need a join
    several = cut(good.groupBy("embedding").agg(F.min("row").alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    shape = good.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if shape[0] and shape[1] != shape[2]:
        raise ValueError(f"vectors of {shape[1]} and {shape[2]} components")
    joined_rows = good.join(small_side(several, 16 * (shape[1] or 1) + 64), "embedding", "left").withColumn("class", F.coalesce("first", "row"))
    members = cut(joined_rows.select("row", "vec_id", "class"))
    classes = joined_rows.where("class = row").select("class", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "embedding")
    total = members.where("class = row").count()
    wanted = int(min(max_pivots, max(1, total // vectors_per_cell)))
    chosen = classes.select("class", "embedding").orderBy(F.xxhash64("embedding", F.lit(seed)), "class").limit(wanted).collect()
    pivots = _unit(r["embedding"] for r in chosen) if chosen else np.zeros((1, 1))

    placed = cut(classes.mapInPandas(partial(_homes, pivots=pivots), "class long, copies long, unit binary, home int, away double"))
    radii, held = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("home").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():  # a row per pivot
        radii[r["home"]], held[r["home"]] = r["radius"], r["n"]
    radii[held == 0] = -math.inf
    sent = np.zeros(len(pivots), np.int64)
    for r in placed.mapInPandas(partial(_reach_counts, pivots=pivots, radii=radii, reach=reach), "home int, sent long").groupBy("home").agg(F.sum("sent").alias("sent")).collect():
        sent[r["home"]] = r["sent"]
    chunk = max(256, CHUNK_BYTES // (8 * pivots.shape[1]))
    chunks, sent_chunks = np.maximum(1, -(-held // chunk)), np.maximum(1, -(-sent // chunk))
    # chunk pairs are groups of bounded size inside as many partitions as the cluster has set
    tasks = placed.mapInPandas(partial(_replicas, pivots=pivots, radii=radii, chunks=chunks, sent_chunks=sent_chunks, reach=reach), "class long, copies long, unit binary, task long, side int")
    joined = cut(tasks.groupBy("task").applyInPandas(lambda part: _join_chunk(part, cosine), "a long, b long, n long"))
    counts = joined.where("n > 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    found = connected_components(joined.where("n = 0"), "a", "b").select(F.col("node").alias("class"), F.col("component").alias("root"))
    known = cut(members.join(counts, "class", "left").join(found, "class", "left").select("row", "vec_id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_links"), F.coalesce("root", "class").alias("root")))
    names = known.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = known.join(small_side(names, 64), "root").select("row", "n_links", "component_id")
    return (
        rows.select("row", "vec_id").join(linked, "row", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
