"""Exact top-k maximum inner product search over norm buckets.

Candidates are grouped by length (Euclidean norm), longest bucket first; the number of buckets is bounded, and a bucket of many vectors is cells of bounded size. A query's k-th score in the first
bucket is a lower bound for its answer. In a later bucket of greatest length M, a candidate can only enter the answer if its cosine with the query exceeds the local threshold
t = bound / (|q| M). t > 1 prunes the whole bucket for that query before anything is shuffled: queries with like reach share a block, and a bucket is sent to the blocks that reach it. Otherwise each
candidate is held to a bound, which each bucket chooses for each query: length pruning, for tight thresholds, keeps those with |q||v| >= bound; coordinate pruning keeps those whose product over the
bucket's heaviest coordinates plus the Cauchy bound of the rest can reach it. Only what is left is verified by the full product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .embed_dedup import usable_or_zero

#: Candidates in a cell and queries in a block (what one group holds), queries in one product, and norm buckets at most.
CELL, QUERIES, TILE, BUCKETS = 8192, 1024, 256, 256
#: Products up to this magnitude are exact in doubles.
EXACT = float(1 << 53)
#: Local cosine threshold from which length alone prunes.
TIGHT = 0.95


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: by doubles where no partial sum can leave their exact range, else by 64-bit integers."""
    if len(q) and len(v) and float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < EXACT:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries, ties to smaller ids."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= kth)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def _search(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """One query block against one cell."""
    is_query = rows["side"].to_numpy() == 0
    x = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), -1)
    ids = rows["vec_id"].to_numpy(np.int64)
    q, v, q_ids, v_ids = x[is_query], x[~is_query], ids[is_query], ids[~is_query]
    bound = rows["bound"].to_numpy()[is_query]
    out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})]
    if not len(q) or not len(v):
        return out[0]
    v_len, slack = _lengths(v), 1 + 1e-9
    # the coordinates that carry most of the cell's length
    focus = np.argsort(-(v.astype(np.float64) ** 2).sum(axis=0))[: max(1, x.shape[1] // 2)]
    rest = np.setdiff1d(np.arange(x.shape[1]), focus)
    v_rest = _lengths(v[:, rest])
    for low in range(0, len(q), TILE):
        part, least = q[low : low + TILE], bound[low : low + TILE]
        length = _lengths(part)
        local = np.where(np.isneginf(least), -np.inf, least / np.maximum(length * v_len.max(), 1e-300))
        tight = local > TIGHT
        keep = np.zeros((len(part), len(v)), bool)
        keep[tight] = (length[tight, None] * v_len * slack >= least[tight, None]) & (local[tight, None] <= slack)
        loose = np.flatnonzero(~tight)
        head = _products(part[loose][:, focus], v[:, focus])
        keep[loose] = head + _lengths(part[loose][:, rest])[:, None] * v_rest * slack + 1e-6 >= least[loose, None]
        keep &= v_ids != q_ids[low : low + TILE, None]
        row_of = dict(zip(loose.tolist(), range(len(loose))))
        for i in np.flatnonzero(keep.any(axis=1)).tolist():
            left = np.flatnonzero(keep[i])
            if i in row_of:
                scores = head[row_of[i], left] + (_products(part[i : i + 1, rest], v[left][:, rest])[0] if len(rest) else 0)
            else:
                scores = _products(part[i : i + 1], v[left])[0]
            best = _best(scores, v_ids[left], k)
            best = best[scores[best] >= least[i]]
            out.append(pd.DataFrame({"query_id": np.full(len(best), q_ids[low + i]), "vec_id": v_ids[left][best], "score": scores[best]}))
    return pd.concat(out, ignore_index=True)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of every query. The filter on the rank is pushed below the exchange, so each task sends k rows a query at most."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_inner_products(vectors: DataFrame, is_query: F.Column, k: int = 5, scale: int = 256) -> DataFrame:
    """The k candidates of largest integer inner product for every query row of ``vectors`` (vec_id, embedding).

    Components are floor(scale * x), x as double. Queries are the rows that ``is_query`` (a condition on vec_id) selects; candidates are all rows but
    the query's own. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; all candidates if there are fewer than k.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id; zero vectors do (score 0). All vectors that take part must
    have one length; another length raises. Rows that repeat a vec_id are candidates of their own, but never for a query with that id; of several query rows of one id the
    one of the smallest vector asks. An empty table gives no rows. Extra columns are ignored. Components must fit 31 bits after scaling.

    The driver holds a row for each bucket (``BUCKETS`` at most). The plan's size doesn't depend on the table's.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable_or_zero("embedding") & F.col("vec_id").isNotNull())
    scaled = cut(rows.select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale} * x) as long))").alias("v")).withColumn("norm", F.sqrt(F.expr("aggregate(v, 0D, (s, x) -> s + cast(x as double) * x)"))))
    total, shortest, longest = scaled.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if shortest != longest:
        raise ValueError(f"vectors of {shortest} and {longest} components")
    # boundaries from quantiles of the length; the accuracy only moves rows between neighbouring buckets
    wanted = min(BUCKETS, -(-total // CELL))
    edges = np.array(sorted(set(scaled.approxQuantile("norm", [i / wanted for i in range(1, wanted)], 0.001)), reverse=True) if wanted > 1 else [])

    @F.pandas_udf("int")
    def bucket_of(norm: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(-edges, -norm.to_numpy(), "left").astype(np.int32))

    sized = cut(scaled.withColumn("bucket", bucket_of("norm")))
    held, reach = np.zeros(len(edges) + 1, np.int64), np.full(len(edges) + 1, -np.inf)
    for r in sized.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect():
        held[r["bucket"]], reach[r["bucket"]] = r["n"], r["top"]
    # cells are numbered through all buckets; a vector's is chosen by its hash
    cells = np.maximum(1, -(-held // CELL))
    start = np.concatenate([[0], np.cumsum(cells)])

    def listed(values: np.ndarray, at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in values]), at + 1)

    placed = sized.withColumn("cell", (listed(start, F.col("bucket")) + F.pmod(F.xxhash64("vec_id"), listed(cells, F.col("bucket")))).cast("long"))
    queries = scaled.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("q")).select("vec_id", "q.v", "q.norm")

    def answered(asked: DataFrame, first: int) -> DataFrame:
        """asked has bound and last: each query meets the cells of buckets ``first`` to its last one."""
        sizes = np.zeros(len(cells) + 1, np.int64)
        for r in asked.groupBy("last").count().collect():  # a row for each bucket
            sizes[r["last"]] = r["count"]
        # blocks are numbered from the queries that reach furthest, so a bucket meets the first so many blocks
        blocks = -(-sizes // QUERIES)
        ahead = np.concatenate([np.cumsum(blocks[::-1])[::-1], [0]])
        at = listed(ahead[1:], F.col("last")) + F.pmod(F.xxhash64("vec_id", F.lit("q")), F.greatest(F.lit(1), listed(blocks, F.col("last"))))
        asking = asked.where(F.col("last") >= first).withColumn("block", at.cast("long")).withColumn("cell", F.explode(F.sequence(F.lit(int(start[first])), listed(start[1:], F.col("last")) - 1)))
        met = placed.where(F.col("bucket") >= first).withColumn("n", listed(ahead[:-1], F.col("bucket"))).where("n > 0")
        offered = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        both = asking.select(F.col("block").cast("long"), F.col("cell").cast("long"), F.lit(0).alias("side"), "vec_id", "v", "bound").union(
            offered.select(F.col("block").cast("long"), F.col("cell").cast("long"), F.lit(1).alias("side"), "vec_id", "v", F.lit(float("-inf")).alias("bound"))
        )
        return both.groupBy("block", "cell").applyInPandas(lambda part: _search(part, k), "query_id long, vec_id long, score long")

    # the first round asks the bucket of the longest vectors alone
    seeds = cut(answered(queries.withColumn("bound", F.lit(float("-inf"))).withColumn("last", F.lit(0)), 0))
    if len(cells) == 1:
        return _ranked(seeds, k)
    reached = _ranked(seeds, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))

    @F.pandas_udf("int")
    def last_bucket(norm: pd.Series, bound: pd.Series) -> pd.Series:
        # lengths fall from bucket to bucket, so those that can reach the bound come first
        needed = bound.to_numpy() / np.maximum(norm.to_numpy(), 1e-300) / (1 + 1e-9)
        return pd.Series((np.searchsorted(-reach, -needed, "right") - 1).clip(0, len(reach) - 1).astype(np.int32))

    bounded = queries.join(reached, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))).withColumn("last", last_bucket("norm", "bound"))
    return _ranked(seeds.union(answered(cut(bounded), 1)), k)
