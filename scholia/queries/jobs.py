"""The job event feed over events: a user is a job, an event type an event of the feed. The batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.streaming import jobs as J

from .roles import table

_TYPES = {"signup": "job:running", "view": "section:delta", "click": "section:start", "purchase": "section:done", "error": "job:failed"}


def feed(events: DataFrame) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair]), F.col("event_type"))
    return events.where("user_id is not null").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3).cast("int").alias("section_index"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"), F.when(F.col("event_type") == "click", F.col("props")).alias("detail"), F.when(F.col("event_type") == "error", F.concat(F.lit("ValueError: "), F.col("value").cast("string"))).alias("error"),
    )


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(table(spark, sf_dir, "events"))


def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.event_history(_feed(spark, sf_dir)).select("job_id", "seq", "type")


def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_state(_feed(spark, sf_dir)).select("job_id", "status", "ended")


def job_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_duration(_feed(spark, sf_dir)).select("job_id", F.round("seconds", 3).alias("seconds"))


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_progress(_feed(spark, sf_dir))


def live_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.live_text(_feed(spark, sf_dir))


QUERIES = {"job_history": job_history, "job_state": job_state, "job_duration": job_duration, "job_progress": job_progress, "live_text": live_text}

ORACLE_SQL = {
    "job_history": "select cast(user_id as varchar) as job_id, event_id as seq, case event_type when 'signup' then 'job:running' when 'click' then 'section:start' when 'purchase' then 'section:done' when 'error' then 'job:failed' end as type from events where user_id is not null and event_type <> 'view'",
    "job_state": "select cast(user_id as varchar) as job_id, coalesce(arg_max(case event_type when 'signup' then 'running' else 'failed' end, event_id) filter (where event_type in ('signup', 'error')), 'queued') as status, false as ended from events where user_id is not null group by user_id",
    "job_duration": "select cast(user_id as varchar) as job_id, round(coalesce((epoch_us(max(case when event_type = 'error' then ts end)) - epoch_us(min(case when event_type = 'signup' then ts end))) / 1e6, 0.0), 3) as seconds from events where user_id is not null group by user_id",
    "job_progress": "select cast(user_id as varchar) as job_id, count(*) filter (where event_type = 'click') as sections_started, count(*) filter (where event_type = 'purchase') as sections_done, arg_max(props, event_id) filter (where event_type = 'click') as last_detail from events where user_id is not null group by user_id",
    "live_text": "select cast(user_id as varchar) as job_id, cast(event_id % 3 as integer) as section_index, string_agg('t' || cast(event_id as varchar), '' order by event_id) as text from events where user_id is not null and event_type = 'view' group by user_id, event_id % 3",
}
