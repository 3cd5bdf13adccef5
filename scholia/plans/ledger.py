"""A ledger of generated answers: no request is paid for twice.

Answers are kept by a hash of the request and of what answers it. Before a model is called, requests that have an answer are taken out by an anti-join; those left are asked once each, however many rows
share them. A task writes each batch of answers to the ledger as soon as it has them, so a task that fails and is tried again, or a job that is started again, asks only what is still open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.plans.notes import USAGE, answers_of
from scholia.sources.tables import children

ANSWER = f"key string, text string, error string, usage {USAGE}, answered_at double"
#: Requests that are asked, and written down, together.
BATCH = 16


def request_key(request: F.Column, model: str = "") -> F.Column:
    return F.sha2(F.concat(F.lit(f"{model}\0"), F.coalesce(request, F.lit(""))), 256)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The best answer of every key: one without an error, else the last."""
    # the runs are named one by one: Spark takes two reads of one folder for the same table, even if one is older
    runs = children(spark, f"{path}/answers")
    if not runs:
        return spark.createDataFrame([], ANSWER)
    rows = spark.read.schema(ANSWER).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(runs)
    best = rows.groupBy("key").agg(F.max_by(F.struct("text", "error", "usage", "answered_at"), F.struct(F.col("error").isNull(), "answered_at")).alias("a"))
    return best.select("key", "a.*")


def _asked(batches: Iterator[pd.DataFrame], folder: str, fn: Callable[[list[str]], list[tuple[str, dict]]], size: int) -> Iterator[pd.DataFrame]:
    """Answer a task's requests, ``size`` at a time. What an earlier attempt of the same task has written counts as answered."""
    import time

    store, root = fs.FileSystem.from_uri(folder)
    part = f"{TaskContext.get().partitionId() if TaskContext.get() else 0:06d}"
    store.create_dir(f"{root}/{part}", recursive=True)
    known, written = set(), 0
    for info in store.get_file_info(fs.FileSelector(f"{root}/{part}")):
        if info.path.endswith(".json"):
            with store.open_input_stream(info.path) as f:
                known.update(row["key"] for row in map(json.loads, f.read().decode().splitlines()) if row["error"] is None)
            written += 1
    count = 0
    for batch in batches:
        todo = [(k, r) for k, r in zip(batch["key"], batch["request"]) if k not in known]
        for low in range(0, len(todo), size):
            some = todo[low : low + size]
            rows = [{"key": k, "text": text, "error": error, "usage": usage, "answered_at": time.time()} for (k, _), (text, error, usage) in zip(some, answers_of([r for _, r in some], fn))]
            name = f"{root}/{part}/{written:06d}-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{name}.part") as f:
                f.write("".join(json.dumps(row) + "\n" for row in rows).encode())
            store.move(f"{name}.part", f"{name}.json")  # a file is there whole or not at all
            written, count = written + 1, count + len(rows)
    yield pd.DataFrame({"asked": [count]})


def generate_once(df: DataFrame, request_col: str, fn: Callable[[list[str]], list[tuple[str, dict]]], path: str, model: str = "", batch: int = BATCH) -> DataFrame:
    """``df`` with ``generated`` struct<text, error, usage>, as ``notes.generate``, but through the ledger under ``path`` (a URI that Arrow can write and Spark can read).

    Requests whose answer was an error are asked again by the next call; all others never. Tasks must not run twice at a time (no speculation), else a batch may be paid for twice. Runs a job.
    """
    spark = df.sparkSession
    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
    keyed = df.withColumn("_key", request_key(F.col(request_col), model))
    done = answers(spark, uri).where("error is null").select(F.col("key").alias("_key"))
    open_ = keyed.select("_key", F.coalesce(request_col, F.lit("")).alias("request")).dropDuplicates(["_key"]).join(done, "_key", "left_anti").withColumnRenamed("_key", "key")
    folder = f"{uri}/answers/run={uuid.uuid4().hex}"
    # a fixed number of partitions by key: a task that is tried again gets the same requests
    dealt = open_.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    dealt.mapInPandas(lambda batches: _asked(batches, folder, fn, batch), "asked long").agg(F.sum("asked")).collect()
    found = answers(spark, uri).select(F.col("key").alias("_key"), F.struct("text", "error", "usage").alias("generated"))
    return keyed.join(found, "_key", "left").drop("_key")
