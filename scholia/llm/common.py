"""Helpers that several corpus operators share: lineage cuts, size-checked broadcasts, prefix-sum windows."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its optimizer size is under this many bytes (measured on checkpointed data).
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark is local."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors never lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: what ``cut`` does, for wide rows of which later steps read few columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a materialised table, for the small side of a join: broadcast if its rows are counted to fit the bound, else left to a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def parallelism(df: DataFrame) -> int:
    """Shuffle width for explicit repartitions: the session's setting, so it follows the cluster."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Give freed memory back to the system. Python workers outlive their tasks, and what an idle one holds is missing elsewhere in its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable) -> Callable:
    """Let a function of batches release its worker's memory when a task's batches are done."""

    @functools.wraps(run)
    def wrapped(batches, *args, **kwargs):
        yield from run(batches, *args, **kwargs)
        release_memory()

    return wrapped


def likely_sampled(group: F.Column, totals: dict, each: int) -> F.Column:
    """Whether a row (by the hash of doc_id) can be among the ``each`` smallest hashes of its group; true for about twice as many, or for all of a small group.

    Taken before ranking, it keeps what is ranked bounded however large a group is.
    """
    if not totals:
        return F.lit(False)
    rates = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(min(1.0, (2 * each + 200) / max(1, n))))])
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    return share < F.element_at(rates, group)
