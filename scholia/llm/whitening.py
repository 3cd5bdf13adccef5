"""Embedding whitening: exact distributed covariance, eigenvectors refined from single precision.

Vectors become integers (a scale, a floor and an offset), so counts, sums and the scatter about the mean are exact at any number of rows: tasks multiply whole numbers, Spark adds them as
decimals. What reaches the driver is one row for each pair of dimensions. There, eigenvectors of the covariance are computed in float32 and corrected by the matrix-multiplication iteration
of Ogita and Aishima in extended precision, which doubles the right digits each time. Eigenvalues closer than the iteration can tell apart are a cluster: a sub-solve of the
covariance within the cluster's span rotates its vectors, and the iteration goes on.
"""

from __future__ import annotations

from fractions import Fraction
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .embed_dedup import usable_or_zero

#: Vectors in one product. Sums of products below EXACT are exact in doubles.
TILE, EXACT = 4096, float(1 << 53)
#: What the iteration works in: the widest float of the platform, on x86 with 64 bits of mantissa.
WIDE = np.longdouble
#: Off-diagonal entries (of a matrix whose largest is one) up to which a cluster needs no further sub-solve.
TOLD = 64 * np.finfo(np.float64).eps
#: Iterations at most; each doubles the number of right digits, so few are ever needed.
ROUNDS = 24


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    """Integer vectors of an Arrow list column."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(vectors), d)


def _gram(y: np.ndarray) -> np.ndarray:
    """y'y as whole numbers: by doubles where no partial sum can leave their exact range, else by Python integers."""
    top = float(np.abs(y).max(initial=0))
    if top * top * len(y) < EXACT:
        x = y.astype(np.float64)
        return (x.T @ x).astype(np.int64).astype(object)
    x = y.astype(object)
    return x.T @ x


@trimmed
def _scatter(batches, centre: np.ndarray):
    """A task's sums of y_i * y_j for i <= j, y = x - centre, as strings of whole numbers."""
    d = len(centre)
    total = np.zeros((d, d), object)
    for batch in batches:
        x = _matrix(batch.column("x"), d)
        for low in range(0, len(x), TILE):
            total = total + _gram(x[low : low + TILE] - centre)
    i, j = np.triu_indices(d)
    yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array([str(v) for v in total[i, j]], pa.string())})


def _exact_covariance(scatter: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """(scatter - rest rest' / n) / n without rounding but the last: n^2 V is a matrix of whole numbers."""
    whole = scatter * n - np.outer(rest, rest)
    shift = 1 << 80  # a whole quotient of 80 binary places keeps more than the mantissa holds
    scaled = np.vectorize(lambda v: (v * shift) // (n * n), otypes=[object])(whole)
    high = np.vectorize(lambda v: float(Fraction(v, shift)), otypes=[np.float64])(scaled)
    low = np.vectorize(lambda v, h: float(Fraction(v, shift) - Fraction(h)), otypes=[np.float64])(scaled, high)
    return high.astype(WIDE) + low.astype(WIDE)


def _norm(a: np.ndarray) -> np.ndarray:
    """A bound of the 2-norm: that of Frobenius."""
    return np.sqrt((a * a).sum())


def _clusters(order: np.ndarray, values: np.ndarray, gap) -> list[np.ndarray]:
    """Runs of eigenvalues (by falling value) whose neighbours are within gap of each other, two at least."""
    cuts = np.flatnonzero(values[order][:-1] - values[order][1:] > gap) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def refined_eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, and the iterations taken.

    The start is ``eigh`` of the matrix in float32, scaled so that its largest entry is one. A round takes R = I - X'X and S = X'VX, reads eigenvalues s_ii / (1 - r_ii), and adds X E with
    e_ij = (s_ij + l_j r_ij) / (l_j - l_i), or r_ij / 2 where the two values can't be told apart. Once rounds have made the spans of clusters right, each cluster's S is diagonalised in
    double precision on its own, about its mean, which tells apart what float32 could not.
    """
    scale = np.abs(v).max()
    if not len(v) or scale == 0:
        return np.zeros(len(v), WIDE), np.eye(len(v), dtype=WIDE), 0
    a = v.astype(WIDE) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    eye, least, before = np.eye(len(a), dtype=WIDE), len(a) * WIDE(np.finfo(WIDE).eps), None
    for rounds in range(1, ROUNDS + 1):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        s, r = (s + s.T) / 2, (r + r.T) / 2  # else rounding over a small gap takes vectors out of orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        near = 2 * (_norm(s - np.diag(values)) + _norm(a) * _norm(r))
        apart = np.abs(values[:, None] - values[None, :]) > near
        gaps = np.where(apart, values[None, :] - values[:, None], 1)
        x = x + x @ np.where(apart, (s + values[None, :] * r) / gaps, r / 2)
        for run in _clusters(np.argsort(-values), values, near):
            inside = x[:, run]
            part = inside.T @ (a @ inside)
            mean = np.trace(part) / len(run)
            if _norm(part - np.diag(np.diag(part))) <= TOLD:
                continue  # already as far apart as double precision tells; only orthogonality is left to mend
            turned = np.linalg.eigh((part - mean * np.eye(len(run), dtype=WIDE)).astype(np.float64))[1][:, ::-1]
            x[:, run] = inside @ turned.astype(WIDE)
        # what is left: departure from orthogonality and from a diagonal S
        left = max(_norm(r), _norm(off) / _norm(a))
        if left <= least or before is not None and left <= 1e-15 and left >= before / 2:
            break
        before = left
    x = x + x @ ((eye - x.T @ x) / 2)
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.diag(x.T @ (a @ x)) * scale
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order], rounds


def _deviations(t: np.ndarray, top: int) -> pa.Array:
    """Sums of squares of whole numbers of magnitude ``top`` at most, exact."""
    if t.shape[1] * top * top < 1 << 63:
        return pa.array((t * t).sum(axis=1)).cast(pa.decimal128(38, 0))
    return pa.array([sum(int(c) ** 2 for c in row) for row in t], pa.decimal128(38, 0))


def _centred(x: np.ndarray, n: int, sums: list[int], top: int) -> np.ndarray:
    """n x - S: 64-bit integers where they fit, else Python's."""
    kind = np.int64 if top < 1 << 62 and n < 1 << 31 else object
    floor = np.array([s // n for s in sums], np.int64)
    return (x - floor).astype(kind) * n - np.array([s - n * (s // n) for s in sums], kind)


@trimmed
def _whiten(batches, fit: dict, only_sums: bool):
    k = fit["basis"].shape[1]
    mean, scatter = np.zeros(k), np.zeros((k, k))
    for batch in batches:
        x = _matrix(batch.column("x"), len(fit["sums"]))
        for low in range(0, len(x), TILE):
            t = _centred(x[low : low + TILE], fit["n"], fit["sums"], fit["top"])
            w = (t.astype(np.float64) / fit["n"]) @ fit["basis"]
            if only_sums:
                mean, scatter = mean + w.sum(axis=0), scatter + w.T @ w
            else:
                flat = pa.array(w.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), flat)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id").slice(low, len(w)), "deviation": _deviations(t, fit["top"]), "w": lists})
    if only_sums:
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.r_[np.full(k, -1), i], pa.int32()), "j": pa.array(np.r_[np.arange(k), j], pa.int32()), "s": pa.array(np.r_[mean, scatter[i, j]])})


def whiten_embeddings(vectors: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Whitened coordinates of every usable vector of ``vectors`` (vec_id, embedding) on the leading components of all of them.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped. An entry c, as double, becomes x = floor(scale * c) + offset; the fit list is all remaining rows, repeated
    ones as often as they occur, and rows without vec_id too (their results have a null vec_id). Vectors that take part must have one length; another length raises, as does an
    entry whose x doesn't fit 64 bits. Extra columns are ignored; an empty table gives no rows.

    Returns, for each row and component (numbered from 1 by falling eigenvalue, ``components`` at most, no more than dimensions): vec_id, component, n (rows of the fit list), deviation (the exact
    sum over dimensions of (n x - S)^2, a decimal), whitened (x - S/n projected on the component, over the root of its eigenvalue), explained (eigenvalue over trace) and identity_error,
    which is one value for all rows: the largest absolute entry of the covariance of whitened values minus the identity, measured in a pass over them. A component without variance (vectors that
    lie in fewer dimensions) has explained 0 and whitened null, and no part in identity_error, which is null if no component has any.

    Three scans of the input: sums, scatter, and the measured covariance; then the result's own. Nothing is shuffled but a row for each task and pair of dimensions.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(offset).cast("long"))
    usable = vectors.where(usable_or_zero("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))
    by_dimension = usable.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high"))
    facts = by_dimension.orderBy("i").collect()  # a row for each dimension
    if not facts:
        return spark.createDataFrame([], schema)
    if len({r["n"] for r in facts}) > 1:
        raise ValueError(f"vectors of different lengths, up to {len(facts)} components")
    d, n, sums = len(facts), facts[0]["n"], [int(r["s"]) for r in facts]
    if any(int(r["high"]) - int(r["low"]) >= 1 << 62 for r in facts):
        raise ValueError("entries of a dimension lie 2^62 or more apart")
    centre = np.array([s // n for s in sums], np.int64)
    parts = usable.select("x").mapInArrow(partial(_scatter, centre=centre), "i int, j int, s string")
    scatter = np.zeros((d, d), object)
    for r in parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # a row for each pair of dimensions
        scatter[r["i"], r["j"]] = scatter[r["j"], r["i"]] = int(r["s"])
    covariance = _exact_covariance(scatter, np.array([s - n * (s // n) for s in sums], object), n)
    values, basis, _ = refined_eigenvectors(covariance)
    k, trace = min(components, d), np.trace(covariance)
    values = np.where(values > trace * d * np.finfo(np.float64).eps, values, 0)[:k]  # below that an eigenvalue is the rounding of zero
    roots = np.where(values > 0, np.sqrt(values), 1)
    fit = {"n": n, "sums": sums, "top": n * max(int(r["high"]) - int(r["low"]) for r in facts), "basis": np.where(values > 0, basis[:, :k] / roots, 0).astype(np.float64)}
    measured = np.zeros((k, k))
    mean = np.zeros(k)
    for r in usable.select("x").mapInArrow(partial(_whiten, fit=fit, only_sums=True), "i int, j int, s double").groupBy("i", "j").agg((F.sum("s") / F.lit(float(n))).alias("s")).collect():  # a row for each pair of components
        if r["i"] < 0:
            mean[r["j"]] = r["s"]
        else:
            measured[r["i"], r["j"]] = measured[r["j"], r["i"]] = r["s"]
    live = np.flatnonzero(values > 0)
    error = float(np.abs((measured - np.outer(mean, mean) - np.eye(k))[np.ix_(live, live)]).max()) if len(live) else None
    explained = [float(e / trace) if trace > 0 else 0.0 for e in values]
    found = usable.mapInArrow(partial(_whiten, fit=fit, only_sums=False), "vec_id long, deviation decimal(38,0), w array<double>")
    shares = F.array(*[F.struct(F.lit(c + 1).alias("component"), F.lit(bool(values[c] > 0)).alias("live"), F.lit(explained[c]).alias("explained")) for c in range(k)])
    each = found.select("vec_id", "deviation", F.explode(F.arrays_zip("w", shares.alias("c"))).alias("z"))
    return each.select("vec_id", F.col("z.c.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(F.col("z.c.live"), F.col("z.w")).alias("whitened"), F.col("z.c.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
