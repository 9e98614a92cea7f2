"""Queries over samples: bundles of clips, campaigns and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.bridge import CUES_SQL, cues
from cuelake.operators import review as V
from cuelake.queries.registry import query

#: Cues as clips of 2.6 s to 18 s.
_CLIPS = "clips AS (SELECT media_id % 40 AS meeting, media_id % 7 AS track, media_id * 1000 + pos AS clip_id, start_ms + media_id AS start_ms, 2600 + (end_ms - start_ms) * 2 AS duration_ms, length(text) * 1000::DOUBLE / (end_ms - start_ms) AS rate, silence_milli / 1000::DOUBLE AS rms FROM cues)"


def clips(spark: SparkSession, d: str) -> DataFrame:
    rows, m, ms = cues(spark, d), F.col("media_id"), F.col("end_ms") - F.col("start_ms")
    return rows.select(
        (m % 40).alias("meeting"), (m % 7).alias("track"), (m * 1000 + F.col("pos")).alias("clip_id"), (F.col("start_ms") + m).alias("start_ms"), (2600 + ms * 2).alias("duration_ms"),
        (F.length("text") * 1000 / ms).alias("rate"), (F.col("silence_milli") / 1000).alias("rms"),
    )


#: A bundle a clip at a time, by the rule of skips, which clips of these lengths never need.
_FILL = """able AS (SELECT *, row_number() OVER (PARTITION BY meeting, track ORDER BY start_ms, duration_ms) AS k FROM clips WHERE duration_ms BETWEEN 3000 AND 15000),
greedy AS (SELECT meeting, track, clip_id, k, true AS taken, duration_ms AS total FROM able WHERE k = 1
  UNION ALL SELECT a.meeting, a.track, a.clip_id, a.k, g.total < 45000 AND g.total + a.duration_ms + 250 <= 75000, CASE WHEN g.total < 45000 AND g.total + a.duration_ms + 250 <= 75000 THEN g.total + a.duration_ms + 250 ELSE g.total END
  FROM greedy g JOIN able a ON a.meeting = g.meeting AND a.track = g.track AND a.k = g.k + 1 WHERE g.total < 45000),
bundles AS (SELECT * FROM greedy WHERE taken AND (meeting, track) IN (SELECT (meeting, track) FROM greedy WHERE total >= 45000))"""


@query("l08_filled", f"WITH RECURSIVE {CUES_SQL}, {_CLIPS}, {_FILL} SELECT meeting, track, clip_id, k AS place, total AS at_ms FROM bundles")
def filled(spark: SparkSession, d: str) -> DataFrame:
    return V.filled(clips(spark, d), [F.col("start_ms"), F.col("duration_ms")], ["meeting", "track"]).select("meeting", "track", "clip_id", "place", "at_ms")


@query("l09_prepared", f"""WITH RECURSIVE {CUES_SQL}, {_CLIPS}, {_FILL}, t AS (SELECT meeting, track, row_number() OVER (PARTITION BY meeting ORDER BY track) AS n FROM (SELECT DISTINCT meeting, track FROM bundles)),
m AS (SELECT meeting FROM t WHERE n = 2 ORDER BY meeting LIMIT 3) SELECT meeting, track, clip_id, k AS place FROM bundles JOIN t USING (meeting, track) WHERE n <= 2 AND meeting IN (SELECT meeting FROM m)""")
def prepared(spark: SparkSession, d: str) -> DataFrame:
    """Three meetings of two tracks: the sample's size is the operator's. At the smallest tables fewer meetings have two."""
    return V.prepared(clips(spark, d)).select("meeting", "track", "clip_id", "place")


@query("l07_select_bundles")
def select_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Six bundles; each choice depends on those before, which a test follows by brute force."""
    return V.select_bundles(clips(spark, d).withColumn("source_group", F.col("track") % 3), "stage")
