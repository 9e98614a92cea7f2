"""What the findings of round 4 found wrong."""

from __future__ import annotations

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from cuelake.queries import streams
from cuelake.queries.registry import SQL
from cuelake.streaming import stage_events as E
from cuelake.streaming import task_states as T
from tests.oracle import compare

START = datetime.datetime(2024, 1, 1)
OUT = "task_id string, from_stage string, stage string, status string, at timestamp, recovery string"


def test_f1_the_state_store_has_a_value_for_a_shard_not_for_a_task(spark, tmp_path):
    rows = [(START + datetime.timedelta(minutes=7 * k), f"{k:04}", f"t{k % 200}", "asr" if k % 3 else "mt", "e", "running" if k % 5 else "failed", 1.0, "x") for k in range(1200)]
    for part in (rows[:600], rows[600:]):
        E.write_events(spark.createDataFrame(part, E.SCHEMA).coalesce(1), str(tmp_path / "in"))
    got = {}
    for shards in (4, 1000):
        out = str(tmp_path / f"{shards}")
        made = T.task_transitions(E.read_events(spark, str(tmp_path / "in"), "2 hours", 1), 600, 3600, shards)
        q = T.write_once(made, f"{out}/rows", f"{out}/check")
        q.awaitTermination()
        assert 0 < max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= min(shards, 200)
        got[shards] = sorted((r.task_id, r.at, r.from_stage or "", r.stage, r.status) for r in T.read_written(spark, f"{out}/rows", OUT).collect())
    assert got[4] == got[1000] and len({r[0] for r in got[4]}) == 200


def ids_in_order(spark):
    return spark.range(900).selectExpr("id AS event_id", "id AS t")


def copies(spark):
    """Three copies of the same times, with ids one after the other, that begin in the middle of a round."""
    return spark.range(900).selectExpr("id AS event_id", "(id + 53) % 300 * 3 AS t")


def copies_on_the_day(spark):
    """As before; one that is too late lies on the day that the last batch's watermark has reached."""
    return spark.range(900).selectExpr("id AS event_id", "(id + 2) % 300 * 3 AS t")


def ids_backward(spark):
    return spark.range(900).selectExpr("id AS event_id", "899 - id AS t")


def a_late_one_alone(spark):
    """The first id lies in the middle of the time, and no event comes slowly in the last sixth."""
    return spark.range(60).selectExpr("id AS event_id", "CASE id WHEN 0 THEN 30 WHEN 30 THEN 0 ELSE id END * 15 AS t")


@pytest.mark.parametrize("made, files", [(ids_in_order, 6), (copies, 8), (copies_on_the_day, 8), (ids_backward, 6), (a_late_one_alone, 8)])
def test_f1_streams_are_whole_whatever_order_the_ids_have(spark, tmp_path, made, files):
    path = tmp_path / "events.parquet"
    kind = F.element_at(F.array(*[F.lit(x) for x in ("view", "click", "error")]), (F.col("event_id") * 7 % 3 + 1).cast("int"))
    made(spark).select(
        "event_id", F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_interval(0, 0, 0, 0, 0, t * 48, 0.25)").alias("ts"), (F.col("event_id") % 11).alias("user_id"), kind.alias("event_type"),
        (F.col("event_id") % 8).cast("double").alias("value"), F.lit("{}").alias("props"),
    ).write.parquet(str(path))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    arrived = streams.arriving(spark, str(tmp_path))[0]
    assert spark.read.format("binaryFile").load(arrived).count() == files
    for name in ("r01_r02_r03_r04_transitions", "r01_k11_stream_counts"):
        assert con.execute(SQL[name]).fetchall() and compare(spark, str(tmp_path), name, con) == ""
