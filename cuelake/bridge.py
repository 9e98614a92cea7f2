"""Timed cues, tracks and events made from general tables, so that the operators have input.

Integer arithmetic only, so that any SQL engine makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Gap before a cue in ms, by (conversation * 31 + turn * 17) mod 7; fixed values.
GAPS = (-400, 0, 20, 250, 2000, 31000, 500)

#: The same as `cues`, for an SQL engine.
CUES_SQL = """cues AS (
  SELECT media_id, pos, turn, role, text, start_ms, start_ms + dur_ms AS end_ms,
         -((media_id * 389 + pos * 613) % 1200) AS logprob_milli, 800 + (media_id * 577 + pos * 811) % 2200 AS compression_milli, (media_id * 211 + pos * 347) % 1000 AS silence_milli
  FROM (
    SELECT *, CAST(sum(dur_ms + gap_ms) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - dur_ms AS start_ms
    FROM (
      SELECT *, 300 + (40 * length(text)) % 7000 AS dur_ms,
             CASE WHEN pos = 1 THEN 0 ELSE CASE (media_id * 31 + turn * 17) % 7 WHEN 0 THEN -400 WHEN 1 THEN 0 WHEN 2 THEN 20 WHEN 3 THEN 250 WHEN 4 THEN 2000 WHEN 5 THEN 31000 ELSE 500 END END AS gap_ms
      FROM (SELECT conv_id AS media_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations))))"""

#: A second track: every cue but each eleventh, later by 0 to 600 ms.
OTHER_SQL = "other AS (SELECT media_id, pos, role, text, start_ms + (media_id % 5) * 150 AS start_ms, end_ms + (media_id % 5) * 150 AS end_ms FROM cues WHERE (media_id + pos) % 11 <> 0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, pos, turn, role, text, start_ms, end_ms and confidences in thousandths."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "media_id")
    in_order = Window.partitionBy("media_id").orderBy("pos")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("media_id").orderBy("turn", "role", "text")).cast("long"))
    gap = F.element_at(F.array(*[F.lit(g) for g in GAPS]), ((F.col("media_id") * 31 + F.col("turn") * 17) % 7 + 1).cast("int"))
    rows = rows.withColumns({"dur_ms": 300 + (40 * F.length("text").cast("long")) % 7000, "gap_ms": F.when(F.col("pos") == 1, 0).otherwise(gap)})
    rows = rows.withColumn("start_ms", F.sum(F.col("dur_ms") + F.col("gap_ms")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("dur_ms"))
    m, p = F.col("media_id"), F.col("pos")
    return rows.select(
        "media_id", "pos", "turn", "role", "text", "start_ms", (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"),
        (-((m * 389 + p * 613) % 1200)).alias("logprob_milli"), (800 + (m * 577 + p * 811) % 2200).alias("compression_milli"), ((m * 211 + p * 347) % 1000).alias("silence_milli"),
    )


def other_track(rows: DataFrame) -> DataFrame:
    late = (F.col("media_id") % 5) * 150
    kept = rows.where((F.col("media_id") + F.col("pos")) % 11 != 0)
    return kept.select("media_id", "pos", "role", "text", (F.col("start_ms") + late).alias("start_ms"), (F.col("end_ms") + late).alias("end_ms"))
