"""The job event feed: history, live text, state, durations, progress; on streams and, with the same functions, on batches.

Events have job_id, seq, type, at, section_index, text, detail, error. On a stream pass them through ``deduplicated`` first: it bounds state by a watermark. These functions
keep a row of state for each job on an endless stream; those of ``scholia.streaming.live`` let go of jobs that have ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELTA = "section:delta"
EVENT_SCHEMA = "job_id string, seq bigint, type string, at timestamp, section_index int, text string, detail string, error string"


def deduplicated(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Each (job_id, seq) once; state older than the lateness is dropped."""
    return events.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["job_id", "seq"])


def event_history(events: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Events worth keeping: all but text deltas, and of known jobs alone if ``jobs`` is given."""
    kept = events.where(F.col("type") != DELTA)
    return kept if jobs is None else kept.join(jobs.select("job_id"), "job_id", "left_semi")


def live_text(events: DataFrame) -> DataFrame:
    """(job_id, section_index, text): deltas joined in order of seq. For batches; ``scholia.streaming.live.stream_live_text`` is the streaming twin."""
    deltas = events.where(F.col("type") == DELTA)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return deltas.groupBy("job_id", "section_index").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def apply_patches(patches: DataFrame, order: str) -> DataFrame:
    """(job_id, section_index, text) from stored patches in the order in which they came (column ``order``)."""
    listed = F.array_sort(F.collect_list(F.struct(order, "from_char", "text")))
    text = F.aggregate(listed, F.lit(""), lambda acc, p: F.concat(F.substring(acc, F.lit(1), p["from_char"].cast("int")), p["text"]))
    return patches.groupBy("job_id", "section_index").agg(text.alias("text"))


def job_state(events: DataFrame) -> DataFrame:
    """(job_id, status, error, ended): the latest of queued, running, done and failed; stream:end closes a job. One row of state for each job."""
    status = F.when(F.col("type").startswith("job:"), F.struct("seq", F.substring_index("type", ":", -1).alias("status")))
    return events.groupBy("job_id").agg(
        F.coalesce(F.max(status)["status"], F.lit("queued")).alias("status"), F.max(F.when(F.col("type") == "job:failed", F.col("error"))).alias("error"), F.max(F.col("type") == "stream:end").alias("ended"),
    )


def job_duration(events: DataFrame) -> DataFrame:
    """(job_id, started_at, ended_at, seconds): from running to done or failed; waiting in the queue doesn't count."""
    spans = events.groupBy("job_id").agg(F.min(F.when(F.col("type") == "job:running", F.col("at"))).alias("started_at"), F.max(F.when(F.col("type").isin("job:done", "job:failed"), F.col("at"))).alias("ended_at"))
    return spans.withColumn("seconds", F.coalesce((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6, F.lit(0.0)))


def job_progress(events: DataFrame) -> DataFrame:
    """(job_id, sections_started, sections_done, last_detail)."""
    return events.groupBy("job_id").agg(F.count_if(F.col("type") == "section:start").alias("sections_started"), F.count_if(F.col("type") == "section:done").alias("sections_done"), F.max(F.when(F.col("detail").isNotNull(), F.struct("seq", "detail")))["detail"].alias("last_detail"))


def job_board(events: DataFrame) -> DataFrame:
    """State, duration and progress of every job in one row. For batches; ``scholia.streaming.live.stream_job_board`` is the streaming twin."""
    return job_state(events).join(job_duration(events), "job_id").join(job_progress(events), "job_id")
