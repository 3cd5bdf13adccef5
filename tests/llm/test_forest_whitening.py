import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm.forest import fit_forest, nearest_neighbours
from scholia.llm.queries import op12_forest_neighbours, op13_embedding_whitening
from scholia.llm.whitening import WIDE, refined_eigenvectors, whiten_embeddings

SCHEMA = "vec_id long, embedding array<double>"


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        at = ids.index(q)
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        out[q] = sorted((d[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def test_recall_and_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    want, got = exact(ids, x, [i for i in ids if i % 100 == 0], 10), found(op12_forest_neighbours(spark, sf_dir))
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q in want}
    assert all(v == sorted(v) for v in got.values())
    at = {v: i for i, v in enumerate(ids)}
    assert all(abs(s - np.sqrt(((x[at[q]] - x[at[v]]) ** 2).sum())) < 1e-12 for q, hits in got.items() for s, v in hits)
    assert np.mean([len({v for _, v in want[q]} & {v for _, v in got[q]}) / 10 for q in want]) >= 0.9


def test_clustered_vectors_stop_early(spark):
    """In clusters the bound ends a search after few leaves, and its neighbours are all found."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((40, 16)) * 10, 60, axis=0) + rng.standard_normal((2400, 16)) * 0.1
    got = found(nearest_neighbours(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], SCHEMA), F.col("vec_id") % 97 == 0, k=5))
    want = exact(list(range(2400)), x, range(0, 2400, 97), 5)
    assert np.mean([len({v for _, v in want[q]} & {v for _, v in got[q]}) / 5 for q in want]) >= 0.95
    forest = fit_forest(x, 4, 5, 1)
    near = 0.2 * 5 / 16 * 1.0
    assert np.mean([len(list(forest.visits(forest.project(x[i : i + 1])[:, 0], 4, near))) for i in range(0, 2400, 97)]) < 40


def test_copies_ties_and_odd_rows(spark):
    """A vector of a third of all rows, null, zero and non-finite vectors, repeated ids, and extra columns."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((90, 4)).round(1)
    x[::3] = [1.0, 2.0, 0.5, -1.0]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * 4), (204, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (205, [])]
    df = spark.createDataFrame([(*r, "a", 5) for r in rows + odd], SCHEMA + ", tree string, rep int")
    got = found(nearest_neighbours(df, F.col("vec_id") % 10 == 0, k=6, share=100.0))
    assert got == exact(list(range(90)), x, range(0, 90, 10), 6)
    few = found(nearest_neighbours(df.where("vec_id < 4"), F.col("vec_id") == 0, k=10))
    assert [v for _, v in few[0]] == [v for _, v in exact([0, 1, 2, 3], x[:4], [0], 10)[0]]
    assert nearest_neighbours(df.where("vec_id = 1"), F.col("vec_id") == 1).count() == 0
    assert nearest_neighbours(df.where("vec_id >= 200"), F.col("vec_id") % 100 == 0).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], SCHEMA)
    assert found(nearest_neighbours(twice, F.col("vec_id") == 1, k=3)) == {1: [(0.0, 2), (0.0, 2), (2**0.5, 3)]}
    with pytest.raises(ValueError, match="components"):
        nearest_neighbours(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), F.col("vec_id") == 1)


def test_whitening_equals_plain_eigenvectors(spark, sf_dir):
    rows = sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in r["embedding"]] for r in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    v = centred.T @ centred / n
    values, basis = np.linalg.eigh(v)
    got = op13_embedding_whitening(spark, sf_dir).orderBy("vec_id", "component").collect()
    assert len(got) == n * 32 and {r["n"] for r in got} == {n}
    w = np.array([r["whitened"] for r in got]).reshape(n, 32)
    assert np.allclose(np.abs(w), np.abs((centred @ basis / np.sqrt(values))[:, ::-1][:, :32]), atol=1e-8)
    assert [r["deviation"] for r in got[::32]] == [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert np.allclose([r["explained"] for r in got[:32]], values[::-1][:32] / values.sum(), rtol=1e-9)
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and abs(error.pop() - np.abs(w.T @ w / n - np.outer(w.mean(0), w.mean(0)) - np.eye(32)).max()) < 1e-12


@pytest.mark.parametrize("spread", ["apart", "cluster", "equal", "deficient"])
def test_refinement_reaches_double_precision(spread):
    rng, d = np.random.default_rng(6), 32
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = {"apart": np.arange(1.0, d + 1), "cluster": np.r_[5 + 1e-9 * np.arange(16), np.arange(1.0, 17) / 20], "equal": np.repeat([4.0, 3.0, 2.0, 1.0], 8), "deficient": np.r_[np.arange(1.0, 9), np.zeros(24)]}[spread]
    v = (q * e) @ q.T
    v = ((v + v.T) / 2).astype(WIDE)
    values, x, _ = refined_eigenvectors(v)
    assert np.abs(x.T @ x - np.eye(d)).max() < 2e-15
    assert np.abs(v @ x - x * values).max() < 2e-15 * e.max()
    assert np.allclose(values.astype(float), np.sort(e)[::-1], atol=1e-13)
    if spread == "cluster":  # what one float32 solve can't tell apart is told apart
        assert np.all(np.diff(values[:16].astype(float)) < -5e-10)


def test_whitening_of_odd_rows(spark):
    """Dropped rows, repeated rows and ids, few dimensions, no variance, large whole numbers, extra columns, an empty table."""
    rows = [(1, [0.5, -1.0]), (1, [0.5, -1.0]), (2, [0.25, 3.0]), (None, [1.0, 1.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("-inf"), 1.0]), (8, [-2.0, 0.1])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", component string, w int")
    got = whiten_embeddings(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((i, c) for i in (1, 1, 2, 0, 8) for c in (1, 2)) and {r["n"] for r in got} == {5}
    assert got[0]["identity_error"] < 1e-12
    line = whiten_embeddings(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)], SCHEMA)).orderBy("vec_id", "component").collect()
    assert [r["whitened"] is None for r in line[:3]] == [False, True, True] and line[0]["explained"] == pytest.approx(1.0) and line[0]["identity_error"] < 1e-12
    one = whiten_embeddings(spark.createDataFrame([(1, [2.0])], SCHEMA)).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in one] == [(None, 0.0, None, 0)]
    far = whiten_embeddings(spark.createDataFrame([(i, [float(i % 3) * 2.0**40, float(i)]) for i in range(9)], SCHEMA)).collect()
    x = [[(i % 3) * 2**46, 64 * i] for i in range(9)]
    assert {(r["vec_id"], int(r["deviation"])) for r in far} == {(i, sum((9 * a - sum(c)) ** 2 for a, c in zip(x[i], zip(*x)))) for i in range(9)} and far[0]["identity_error"] < 1e-9
    assert whiten_embeddings(df.where("vec_id = 3")).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        whiten_embeddings(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))
