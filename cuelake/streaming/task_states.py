"""Tasks as a stream of state transitions, and a sink that holds each batch once.

Events of a task are taken in the order of their own time, whatever order they arrive in: they wait until the
watermark has passed them. So the transitions do not depend on how the stream was cut in
batches, as long as no event is later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelake.streaming.stage_events import recovery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "tasks binary, waiting binary"
_OUT = "task_id string, from_stage string, stage string, status string, at long"
FINAL = ("completed", "failed")
#: Tasks are dealt to so many shards by their id. The state store has one value for a shard, since one for each task would be a call of Python for each task and batch.
SHARDS = 2048
#: That value, as Arrow: what is known of the shard's tasks, and their events that wait.
_TASKS = pa.schema([("task_id", pa.string()), ("stage", pa.string()), ("status", pa.string()), ("last", pa.int64()), ("stale", pa.bool_())])
_WAITING = pa.schema([("task_id", pa.string()), ("at", pa.int64()), ("run_id", pa.string()), ("stage", pa.string()), ("status", pa.string())])


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def _silent(now: tuple, until: int, stale: int, keep: int) -> tuple[tuple | None, tuple | None]:
    """What becomes of a task of which nothing is heard until then, and the transition, if it falls silent."""
    stage, status, last, silent = now
    if status in FINAL:
        return (None if last + keep < until else now), None
    if not silent and last + stale < until:
        return (stage, status, last, True), (stage, stage, "stale", last + stale)
    return now, None


def task_states(stale: int, keep: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The state machines of a shard's tasks, for applyInPandasWithState. Times are microseconds.

    A task enters a stage with an event of another stage than before, or of any
    stage after it was silent for longer than ``stale`` (then it was stale from that time on). A
    task that completed or failed is forgotten after ``keep``. Both times are the events' own: the timeout waits for the watermark."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs() * 1000
        kept = [pa.ipc.open_stream(x).read_all() for x in state.get] if state.exists else [t.empty_table() for t in (_TASKS, _WAITING)]
        rows = pa.concat_tables([kept[1], *(pa.Table.from_pandas(pdf, _WAITING, preserve_index=False) for pdf in batches if len(pdf))])
        due = pc.less_equal(rows["at"], watermark)
        ready, later = rows.filter(due), rows.filter(pc.invert(due))
        ready = ready.take(pc.sort_indices(ready, sort_keys=[(c, "ascending") for c in ("at", "run_id", "stage", "status")], null_placement="at_start"))
        task_ids, *current = (c.to_pylist() for c in kept[0].columns)
        tasks = dict(zip(task_ids, zip(*current, strict=True), strict=True))
        out: list[tuple] = []
        for task, at, stage, status in zip(*(ready[c].to_pylist() for c in ("task_id", "at", "stage", "status")), strict=True):
            now = tasks.get(task)
            if now:
                now, fell = _silent(now, at, stale, keep)
                if fell:
                    out.append((task, *fell))
            if now is None or now[3] or now[0] != stage:
                out.append((task, now and now[0], stage, status, at))
            tasks[task] = stage, status, at, False
        # one timeout: the next event that waits, or the end of the first silence, in the millisecond before the watermark shows it
        ends = [-(-pc.min(later["at"]).as_py() // 1000) - 1] if len(later) else []
        left = []
        for task, now in tasks.items():
            now, fell = _silent(now, watermark, stale, keep)
            if fell:
                out.append((task, *fell))
            if now:
                left.append((task, *now))
                if not now[3]:
                    ends.append((now[2] + (keep if now[1] in FINAL else stale)) // 1000)
        if left or len(later):
            columns = zip(*left, strict=True) if left else [[]] * len(_TASKS)
            state.update((_packed(pa.table([pa.array(c, f.type) for c, f in zip(columns, _TASKS, strict=True)], schema=_TASKS)), _packed(later)))
            if ends:
                state.setTimeoutTimestamp(max(min(ends), 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["task_id", "from_stage", "stage", "status", "at"])

    return step


def task_transitions(events: DataFrame, stale_seconds: int, keep_seconds: int, shards: int = SHARDS) -> DataFrame:
    """A stream of events (timestamp with a watermark, run_id, task_id, stage, status) to task_id, from_stage, stage, status, at, recovery."""
    rows = events.where("task_id IS NOT NULL").select(
        F.pmod(F.xxhash64("task_id"), F.lit(shards)).alias("shard"), "task_id", "timestamp", F.unix_micros("timestamp").alias("at"), "run_id", "stage", "status"
    )
    made = rows.groupBy("shard").applyInPandasWithState(task_states(stale_seconds * 1_000_000, keep_seconds * 1_000_000), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select("task_id", "from_stage", "stage", "status", F.timestamp_micros("at").alias("at"), recovery(F.col("status")).alias("recovery"))


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, so that it need not fit the executors' heap."""
    was = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was)


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts writing all that is there as Parquet. A batch has a folder by its number: one that is run
    again after a failure replaces what it left, so that each row is there once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_in_rocksdb(stream.sparkSession):
        return stream.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_once wrote."""
    return spark.read.schema(schema).parquet(path).drop("batch")
