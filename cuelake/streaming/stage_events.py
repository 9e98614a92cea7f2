"""Stage events as a stream: sink, source, windowed counts, latest state and liveness."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelake.functions.text import redact

SCHEMA = "timestamp timestamp, run_id string, task_id string, stage string, event string, status string, duration_seconds double, summary string"
#: Times of JSON lines, to the microsecond.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
#: Stages in order; fixed values.
STAGES = ("pending", "extracting", "transcribing", "translating", "checking", "completed", "failed")


def write_events(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines, free text masked."""
    events.withColumn("summary", redact(F.col("summary"))).write.mode("append").json(path, timestampFormat=TIME_FORMAT)


def read_events(spark: SparkSession, path: str, late: str = "1 hour", files_at_once: int = 1000) -> DataFrame:
    """The stream of events in a folder of JSON lines, so many files a batch, the oldest first."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).json(path, timestampFormat=TIME_FORMAT)
    return rows.withWatermark("timestamp", late)


def stage_counts(events: DataFrame, every: str = "1 hour") -> DataFrame:
    """Events and seconds by time window, stage and status; batch or stream."""
    out = events.groupBy(F.window("timestamp", every), "stage", "status").agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("seconds"))
    return out.select(F.col("window.start").alias("window_start"), "stage", "status", "n", "seconds")


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each task, in a batch: its stage, status and time."""
    last = F.max(F.struct("timestamp", "stage", "status"))
    return events.groupBy("task_id").agg(last.alias("l"), F.count("*").alias("n")).select("task_id", "l.stage", "l.status", F.col("l.timestamp").alias("updated"), "n")


def recovery(status: Column) -> Column:
    """What a task's status asks for."""
    return F.when(status == "failed", "retry").when(status.isin("stale", "worker_lost"), "resume").when(status == "completed", "none").otherwise("wait")


def progress(states: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """states (task_id, stage, status, updated) with effective_status (stale if
    running and silent for too long) and recovery."""
    silent = now.cast("timestamp").cast("double") - F.col("updated").cast("timestamp").cast("double") > stale_seconds
    effective = F.when(~F.col("status").isin("completed", "failed") & silent, "stale").otherwise(F.col("status"))
    return states.withColumn("effective_status", effective).withColumn("recovery", recovery(F.col("effective_status")))


def stage_from_log(lines: Column, keywords: dict[str, str], last: int = 10) -> Column:
    """The stage of the last line, among the last ``last``, that has a keyword."""
    recent = F.reverse(F.slice(lines, F.greatest(F.size(lines) - last + 1, F.lit(1)), F.lit(last)))

    def stage(line: Column) -> Column:
        out = F.when(F.lit(False), "")
        for word, name in keywords.items():
            out = out.when(F.contains(F.lower(line), F.lit(word)), name)
        return out

    return F.get(F.filter(F.transform(recent, stage), lambda s: s.isNotNull()), F.lit(0))


def last_error(lines: Column, last: int = 20) -> Column:
    """The last line that looks like an error among the last ``last``."""
    recent = F.slice(lines, F.greatest(F.size(lines) - last + 1, F.lit(1)), F.lit(last))
    return F.try_element_at(F.filter(recent, lambda x: x.rlike(r"(?i)error|failed|exception|traceback")), F.lit(-1))


def track_tasks(events: DataFrame, stale: str = "10 minutes") -> DataFrame:
    """The stream's tasks as a state each: a row whenever a task changes its
    stage, and one ("stale") when it is silent for longer than ``stale``."""
    silence = int(pd.Timedelta(stale).total_seconds() * 1000)

    def step(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            stage, n = state.get
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "stage": [stage], "status": ["stale"], "n": [n]})
            return
        stage, n = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(batches)).sort_values("timestamp")
        n += len(pdf)
        new = pdf["stage"].iloc[-1]
        if pdf["status"].iloc[-1] in ("completed", "failed") and state.exists:
            state.remove()
        elif pdf["status"].iloc[-1] not in ("completed", "failed"):
            state.update((new, n))
            state.setTimeoutDuration(silence)
        if new != stage:
            yield pd.DataFrame({"task_id": [key[0]], "stage": [new], "status": [pdf["status"].iloc[-1]], "n": [n]})

    return events.groupBy("task_id").applyInPandasWithState(step, "task_id string, stage string, status string, n long", "stage string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
