"""Queries that run as streams: the events table arrives as JSON files, in several batches, some of it late."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.queries.inputs import _folder
from cuelake.queries.registry import query
from cuelake.queries.tracks import stage_rows
from cuelake.streaming import stage_events as E
from cuelake.streaming import task_states as S

#: Batches that the events arrive in, each a sixth of the time; the watermark is behind by 10 days of 30.
BATCHES, LATE = 6, "10 days"
#: Events in a file, about: a batch of the stream is as many files as a batch was written to, however many tasks the table is read by.
FILE_ROWS = 250_000
#: A task is stale after five hours of silence, and forgotten two days after its end.
STALE, KEEP = 5 * 3600, 2 * 86_400

#: Each 50th event comes a batch late, which the watermark allows; each 97th of the first sixth comes with the last batch, which it does not.
_ARRIVED = """sixths AS (SELECT *, event_id * 6 // (SELECT max(event_id) + 1 FROM events) AS sixth FROM events),
arrived AS (
  SELECT ts, user_id::VARCHAR AS task_id, event_id::VARCHAR AS run_id, event_type AS stage, value,
         CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'completed' ELSE 'running' END AS status
  FROM sixths WHERE NOT (event_id % 97 = 0 AND sixth = 0)),
mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 DAY AS mark FROM events)"""


def arriving(spark: SparkSession, d: str) -> tuple[str, int]:
    """A folder to which the events were written in batches, some of them late, and the files of a batch.

    Batches go by the events' time, whatever order their ids have. What is to be too late must come when the watermark has passed it, and its
    day, for sure: with the last batch, or two batches later, where ids and times are in another order. Spark takes as late what the batch before had passed."""
    rows = stage_rows(spark, d).where("event_id IS NOT NULL AND timestamp IS NOT NULL").withColumn("at", F.unix_micros(F.col("timestamp").cast("timestamp")))
    size = rows.agg(F.max("event_id").alias("last"), F.count("*").alias("n"), F.max("at").alias("end")).first()
    last, end, parts = size["last"] or 0, size["end"] or 0, size["n"] // (BATCHES * FILE_ROWS) + 1
    behind = int(pd.Timedelta(LATE).total_seconds()) * 1_000_000
    at, slow = F.col("at"), F.col("event_id") % 50 == 0
    too_late = F.expr(f"event_id % 97 = 0 AND event_id * {BATCHES} div {last + 1} = 0") & (at <= end // 1000 * 1000 - behind)
    found = rows.agg(F.percentile_approx(F.when(~too_late & ~slow, at), [k / BATCHES for k in range(1, BATCHES)]).alias("bounds"), F.max(F.when(too_late, at)).alias("latest")).first()
    bounds, latest = found["bounds"] or [], found["latest"]
    # the fourth bound is the time of an event of the first four batches, and so the fifth has its watermark; windows that end a day after a time before it are over
    passed = bounds[BATCHES - 3] // 1000 * 1000 - behind - 86_400_000_000 if bounds else 0
    more = latest is not None and latest > passed
    sixth = sum(((at > b).cast("int") for b in bounds), F.lit(0))
    slowly = F.when(at < end, sixth + 1).otherwise(sixth) if more else F.least(sixth + 1, F.lit(BATCHES - 1))
    batch = F.when(too_late, F.when(at <= passed, BATCHES - 1).otherwise(BATCHES + 1)).when(slow, slowly).otherwise(sixth)
    rows = rows.select(
        F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("event_id").cast("string").alias("run_id"), "task_id", "stage", F.lit("stage").alias("event"), "status", "duration_seconds",
        F.lit("ok").alias("summary"), batch.alias("batch"),
    )
    path = _folder(spark, "events")
    for k in range(BATCHES + 2 * more):
        E.write_events(rows.where(F.col("batch") == k).drop("batch").repartition(parts), path)
    return path, parts


def _ran(spark: SparkSession, made: DataFrame, schema: str) -> DataFrame:
    path = _folder(spark, "stream")
    S.write_once(made, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return S.read_written(spark, f"{path}/rows", schema)


@query("r01_r02_r03_r04_transitions", f"""WITH {_ARRIVED},
o AS (
  SELECT arrived.*, mark, lag(ts) OVER w AS before, lag(status) OVER w AS was, lag(stage) OVER w AS left_stage, lead(ts) OVER w AS next
  FROM arrived, mark WHERE ts <= mark WINDOW w AS (PARTITION BY task_id ORDER BY ts, run_id)),
f AS (SELECT *, was IN ('completed', 'failed') AND ts > before + INTERVAL 2 DAY AS forgotten, was = 'running' AND ts > before + INTERVAL 5 HOUR AS stale FROM o),
t AS (
  SELECT task_id, CASE WHEN NOT forgotten THEN left_stage END AS from_stage, stage, status, ts AS at FROM f WHERE before IS NULL OR forgotten OR stale OR stage <> left_stage
  UNION ALL SELECT task_id, stage, stage, 'stale', ts + INTERVAL 5 HOUR FROM f WHERE status = 'running' AND coalesce(next, mark) > ts + INTERVAL 5 HOUR)
SELECT *, CASE status WHEN 'failed' THEN 'retry' WHEN 'stale' THEN 'resume' WHEN 'completed' THEN 'none' ELSE 'wait' END AS recovery FROM t""")
def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Stages that tasks enter, and when they fall silent, with what to do."""
    path, parts = arriving(spark, d)
    events = E.read_events(spark, path, LATE, parts)
    return _ran(spark, S.task_transitions(events, STALE, KEEP), "task_id string, from_stage string, stage string, status string, at timestamp, recovery string")


@query("r01_k11_stream_counts", f"WITH {_ARRIVED} SELECT date_trunc('day', ts) AS window_start, stage, status, count(*) AS n, sum(value) AS seconds FROM arrived, mark WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY ALL")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events and seconds of the days that the watermark has passed."""
    path, parts = arriving(spark, d)
    events = E.read_events(spark, path, LATE, parts)
    return _ran(spark, E.stage_counts(events, "1 day"), "window_start timestamp, stage string, status string, n long, seconds double")
