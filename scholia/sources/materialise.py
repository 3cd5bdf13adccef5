"""Cut the lineage of tables that a plan reads several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow tables of up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark is local."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or tempfile.mkdtemp(prefix="spark-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table for the small side of a join, broadcast if counting shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
