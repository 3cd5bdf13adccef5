"""Finished runs of a job stream become documents and search rows of a library, exactly once whatever is replayed.

A batch writes its documents and search rows to folders of its number, then its line to the ledger; only batches in the ledger are read. A batch that is replayed finds its line and does nothing, one that was
broken off writes its folders again. Rows carry when their run ended, and the latest run of a document counts, so it doesn't matter in which batch or order runs arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators.library import newest, replace_by_key, upsert_documents
from scholia.operators.results import note_search_rows
from scholia.sources.tables import children

LEDGER = "batch_id bigint, documents bigint, search_rows bigint"


def finished_runs(events: DataFrame) -> DataFrame:
    """(job_id, ended_at): runs that are done. Failed ones have no document."""
    return events.where(F.col("type") == "job:done").groupBy("job_id").agg(F.max("at").alias("ended_at"))


def recorded_batches(spark: SparkSession, path: str) -> DataFrame:
    lines = children(spark, f"{path}/ledger")  # named one by one: Spark takes two reads of one folder for the same table, even if one is older
    return spark.read.schema(LEDGER).parquet(*lines) if lines else spark.createDataFrame([], LEDGER)


def record_runs(path: str, runs: Callable[[SparkSession], DataFrame], sections: Callable[[SparkSession], DataFrame], courses: Callable[[SparkSession], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that records the runs that a batch finishes.

    ``runs`` gives job_id and the columns of documents (id, course_id, kind, is_public and so on), ``sections`` job_id, section_index, title, markdown and error, ``courses`` id; each is read when a batch comes.
    Runs without a course, or whose course is gone, leave no document.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if recorded_batches(spark, path).where(F.col("batch_id") == batch_id).limit(1).count():
            return
        done = finished_runs(batch).join(runs(spark), "job_id").join(courses(spark).select(F.col("id").alias("course_id")), "course_id", "left_semi")
        done.withColumn("run", F.struct("ended_at", "job_id")).drop("ended_at", "job_id").write.mode("overwrite").parquet(f"{path}/documents/batch={batch_id}")
        written = spark.read.parquet(f"{path}/documents/batch={batch_id}")
        named = written.select("run", F.col("run.job_id").alias("job_id"), F.col("id").alias("document_id"), "course_id")
        held = sections(spark).join(named, "job_id")
        rows = note_search_rows(held).join(named.select("document_id", "run"), "document_id")
        rows.write.mode("overwrite").parquet(f"{path}/search_rows/batch={batch_id}")
        counts = (batch_id, written.count(), spark.read.parquet(f"{path}/search_rows/batch={batch_id}").count())
        spark.createDataFrame([counts], LEDGER).write.mode("overwrite").parquet(f"{path}/ledger/line={batch_id}")

    return run


def recorded_library(spark: SparkSession, path: str, documents: DataFrame, doc_sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, search rows): a library's tables with all recorded runs applied. A document that was there keeps its public flag, and loses the search rows of its former run."""
    known = recorded_batches(spark, path).select(F.col("batch_id").alias("batch"))
    if known.isEmpty():
        return documents, doc_sections

    def recorded(name: str) -> DataFrame:
        # folders that no ledger line names are what a broken batch has left
        return spark.read.option("basePath", f"{path}/{name}").parquet(*children(spark, f"{path}/{name}")).withColumn("batch", F.col("batch").cast("long")).join(known, "batch", "left_semi").drop("batch")

    latest = newest(recorded("documents"), ["id"], "run")
    merged = upsert_documents(documents, latest.withColumnRenamed("run", "_run"), order="_run")
    current = latest.select(F.col("id").alias("document_id"), "run")
    rows = recorded("search_rows").join(current, ["document_id", "run"], "left_semi").drop("run").distinct()
    kept = doc_sections.join(current.select("document_id"), "document_id", "left_anti")
    return merged, replace_by_key(kept, rows, "document_id")
