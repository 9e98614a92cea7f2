"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key list that may be broadcast; longer lists are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Rows that a Python worker gets at once.
BATCH = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Unset: a
    temporary one in local mode, as in tests; on a cluster that is an error."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cuelake-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands rows to Python at most BATCH at a time, so that
    neither side holds tens of MB of long texts; the session's setting comes back after."""
    was = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH if int(was) <= 0 else min(BATCH, int(was))))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, was)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and
    survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_task(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """f for mapInArrow. As a task ends, what it freed goes back to the system: Spark keeps its Python
    workers, and an idle one should not hold what another stage may need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def _sheltered_names(docs: DataFrame, used: tuple[str, ...]) -> list[str]:
    return [c if c in used else f"in_{c}" for c in docs.columns]


def sheltered(docs: DataFrame, *used: str) -> DataFrame:
    """docs with all columns but the used ones renamed, so that none clashes
    with a name that an operator adds (those never begin with in_)."""
    return docs.toDF(*_sheltered_names(docs, used))


def restored(rows: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """rows, made from sheltered docs, with the columns of docs alone."""
    return rows.select(*["`" + n.replace("`", "``") + "`" for n in _sheltered_names(docs, used)]).toDF(*docs.columns)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable.

    Minimum-label propagation with pointer jumping; a round takes the least
    label among a node's links, then follows the label's own label, so that
    chains shorten by half or more a round. Aggregations combine on the map
    side, and no node's links ever meet in one row.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "links")
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("was"), F.least("component", "m").alias("component")
        )
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("of"))
        step = materialize(
            step.join(up, step["component"] == up["up"], "left").select(
                "node", "was", F.least("component", F.coalesce("of", "component")).alias("component")
            ),
            "labels",
        )
        labels = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return labels
