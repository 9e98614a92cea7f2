"""Queries over evaluation campaigns, and over captions that are cleaned."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.bridge import CUES_SQL, OTHER_SQL, cues, other_track
from cuelake.operators import campaign as C
from cuelake.plans import cleaning as L
from cuelake.queries.evidence import _WORD
from cuelake.queries.registry import query

#: Profiles of the stand-in for recognition: words longer than this are wrong, and those with this end are not in the reference.
_PROFILES = [("speed", 7, "s"), ("balanced", 8, "es"), ("quality", 9, "e"), ("large", 9, "ées")]
_PAIRS = [("speed", "balanced"), ("balanced", "quality"), ("speed", "large"), ("large", "speed"), ("balanced", "large")]
_CLIPS = rf"""words AS (SELECT 's' || media_id % 12 AS sample, 'g' || media_id % 3 AS source_group, media_id * 100000 + pos AS clip, start_ms, end_ms, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM cues),
profiles(profile, longest, ending) AS (VALUES {', '.join(str(p) for p in _PROFILES)}),
clips AS (
  SELECT sample, source_group, profile, clip, len(list_filter(w, lambda x: length(x) > longest)) AS substitutions, len(list_filter(w, lambda x: ends_with(x, ending))) AS insertions, len(w) AS words, clip % 31 = longest AS empty
  FROM words, profiles),
runs AS (SELECT sample, profile, sum(end_ms - start_ms) / 1000::DOUBLE / longest AS seconds, 1000 * longest AS memory_mib FROM words, profiles GROUP BY sample, profile, longest),
marked AS (SELECT *, substitutions + insertions AS errors, insertions >= 3 AND insertions::DOUBLE / greatest(words, 1) >= 0.2 AS hallucinated FROM clips)"""


def campaign(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(clips, runs): cues as clips of twelve samples, under four profiles."""
    profiles = F.broadcast(spark.createDataFrame(_PROFILES, "profile string, longest int, ending string"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    m = F.col("media_id")
    rows = cues(spark, d).select(F.concat(F.lit("s"), (m % 12).cast("string")).alias("sample"), F.concat(F.lit("g"), (m % 3).cast("string")).alias("source_group"), (m * 100_000 + F.col("pos")).alias("clip"), "start_ms", "end_ms", words.alias("w"))
    rows = rows.crossJoin(profiles)  # four rows
    clips = rows.select(
        "sample", "source_group", "profile", "clip", F.size(F.filter("w", lambda x: F.length(x) > F.col("longest"))).alias("substitutions"), F.size(F.filter("w", lambda x: F.endswith(x, F.col("ending")))).alias("insertions"),
        F.lit(0).alias("deletions"), F.size("w").alias("words"), (F.col("clip") % 31 == F.col("longest")).alias("empty"),
    )
    runs = rows.groupBy("sample", "profile", "longest").agg((F.sum(F.col("end_ms") - F.col("start_ms")) / 1000 / F.col("longest")).alias("seconds"), (F.col("longest") * 1000).alias("memory_mib"))
    return clips, runs.drop("longest")


_NAMES = ("wer", "errors", "words", "insertions", "hallucinations", "empty", "clips", "seconds", "memory_mib")


@query("j14_campaign_metrics", f"""WITH {CUES_SQL}, {_CLIPS},
f AS (SELECT profile, source_group, sample, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words, sum(insertions)::BIGINT AS insertions, count(*) FILTER (WHERE hallucinated) AS hallucinations, count(*) FILTER (WHERE empty) AS empty, count(*) AS clips FROM marked GROUP BY ALL),
g AS (SELECT * FROM f LEFT JOIN runs USING (sample, profile)),
r AS (SELECT CASE grouping(source_group) + grouping(sample) WHEN 0 THEN 'sample' WHEN 1 THEN 'group' ELSE 'corpus' END AS level, source_group, sample, profile, round(sum(errors)::DOUBLE / greatest(sum(words), 1), 8) AS wer,
  {', '.join(f'sum({n})::DOUBLE AS {n}' for n in _NAMES[1:7])}, round(sum(seconds), 6)::DOUBLE AS seconds, max(memory_mib)::DOUBLE AS memory_mib FROM g GROUP BY GROUPING SETS ((profile, source_group, sample), (profile, source_group), (profile)))
{' UNION ALL '.join(f"SELECT level, source_group, sample, profile, '{n}' AS metric, {n} AS value FROM r" for n in _NAMES)}""")
def campaign_metrics(spark: SparkSession, d: str) -> DataFrame:
    return C.metrics(*campaign(spark, d))


@query("j14_promotion", f"""WITH {CUES_SQL}, {_CLIPS}, pairs("left", "right") AS (VALUES {', '.join(str(p) for p in _PAIRS)}),
s AS (SELECT profile, sample, sum(errors) AS errors, sum(words) AS words, sum(insertions) AS insertions, count(*) FILTER (WHERE hallucinated) AS hallucinations, count(*) FILTER (WHERE empty) AS empty, round(sum(errors)::DOUBLE / greatest(sum(words), 1), 8) AS wer FROM marked GROUP BY ALL),
t AS (
  SELECT "left", "right", round(sum(a.errors)::DOUBLE / greatest(sum(a.words), 1), 8) AS left_wer, round(sum(b.errors)::DOUBLE / greatest(sum(b.words), 1), 8) AS right_wer, count(*) FILTER (WHERE b.wer <= a.wer) AS non_inferior, bool_or(b.wer - a.wer > 0.05) AS severe,
         sum(b.insertions) > sum(a.insertions) AS i, sum(b.hallucinations) > sum(a.hallucinations) AS h, sum(b.empty) > sum(a.empty) AS e
  FROM pairs JOIN s a ON a.profile = "left" JOIN s b ON b.profile = "right" AND a.sample = b.sample GROUP BY ALL),
r AS (SELECT *, round((left_wer - right_wer) / greatest(left_wer, 1e-12), 8) AS gain FROM t),
x AS (SELECT *, array_to_string(list_filter([CASE WHEN right_wer >= left_wer THEN 'interval' END, CASE WHEN gain < 0.05 THEN 'gain' END, CASE WHEN non_inferior < 4 THEN 'samples' END, CASE WHEN severe THEN 'severe' END, CASE WHEN i THEN 'insertions' END, CASE WHEN h THEN 'hallucinations' END, CASE WHEN e THEN 'empty' END], lambda v: v IS NOT NULL), ',') AS reasons FROM r)
SELECT "left", "right", left_wer, right_wer, gain, non_inferior, severe, CASE WHEN reasons = '' THEN 'promote' ELSE 'keep' END AS decision, reasons FROM x""")
def promotion(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of profiles, by the rates and the bootstrap's interval. Rates are far enough apart here that the interval excludes zero, as the SQL takes it."""
    clips, _ = campaign(spark, d)
    pairs = spark.createDataFrame(_PAIRS, "left string, right string")
    return C.promotion(clips, pairs, C.intervals(clips, pairs, "campaign", 1000))


_CAPTIONS = rf"""captions AS (
  SELECT media_id, pos, start_ms, end_ms, CASE WHEN pos % 8 = 0 THEN '' ELSE trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) END AS source, CASE WHEN pos % 10 = 0 THEN '' ELSE 'T ' || role || pos // 3 END AS target FROM cues),
said AS (SELECT c.media_id, c.pos, string_agg(o.role || '-' || o.pos, ' ' ORDER BY o.start_ms, o.pos) AS said FROM cues c JOIN other o ON c.media_id = o.media_id AND least(c.end_ms, o.end_ms) - greatest(c.start_ms, o.start_ms) > 50 GROUP BY ALL),
asked AS (SELECT *, min(pos) OVER (PARTITION BY media_id, batch) % 5 <> 0 AS ok FROM (SELECT media_id, pos, (row_number() OVER (PARTITION BY media_id ORDER BY pos) - 1) // 12 AS batch FROM captions WHERE pos % 9 <> 0)),
j AS (SELECT c.*, coalesce(said, '') AS said, coalesce(ok, false) AS ok FROM captions c LEFT JOIN said USING (media_id, pos) LEFT JOIN asked USING (media_id, pos)),
t AS (
  SELECT media_id, pos, start_ms, end_ms, CASE WHEN pos % 9 = 0 THEN 'saved ' || pos WHEN ok THEN '*' || CASE WHEN source <> '' THEN source WHEN said <> '' THEN said ELSE '?' END WHEN source <> '' THEN source ELSE said END AS source,
         CASE WHEN pos % 9 = 0 THEN 'kept' WHEN ok THEN '*' || CASE WHEN target <> '' THEN target ELSE '?' END ELSE target END AS target, ok FROM j),
cleaned AS (SELECT media_id, pos, start_ms, end_ms, source, target, CASE WHEN pos % 9 = 0 THEN 'saved' WHEN ok THEN 'model' WHEN source <> '' AND target <> '' THEN 'ocr' ELSE 'incomplete' END AS origin FROM t)"""


def cleaner() -> Callable[[str, dict], str]:
    """A stand-in for the model: what was read, else what is heard; none for batches that begin with a multiple of five."""

    def say(stage: str, q: dict) -> str:
        if q["items"][0]["id"] % 5 == 0:
            raise ValueError("no answer")
        if len(q["context_before"]) > 2 or len(q["context_after"]) > 2:
            return "too much context"
        return json.dumps({"items": [{"id": x["id"], "translation": f"*{x['ocr_source'] or x['heard'] or '?'}\n*{x['ocr_target'] or '?'}"} for x in q["items"]]})

    return say


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    p = F.col("pos")
    source = F.when(p % 8 == 0, "").otherwise(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    target = F.when(p % 10 == 0, "").otherwise(F.concat(F.lit("T "), "role", F.floor(p / 3).cast("string")))
    captions = rows.select("media_id", "pos", "start_ms", "end_ms", F.concat(source, F.lit("\n"), target).alias("text"))
    heard = other_track(rows).withColumn("text", F.concat("role", F.lit("-"), p.cast("string")))
    done = rows.where(p % 9 == 0).select("media_id", "pos", F.concat(F.lit("saved "), p.cast("string"), F.lit("\nkept")).alias("text"))
    return L.cleaned(captions, heard, cleaner, done)


@query("u17_cleaned", f"WITH {CUES_SQL}, {OTHER_SQL}, {_CAPTIONS} SELECT * FROM cleaned")
def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d)


@query("u17_summary", rf"""WITH {CUES_SQL}, {OTHER_SQL}, {_CAPTIONS},
m AS (SELECT *, {_WORD.format('source')} AS a, {_WORD.format('target')} AS b FROM cleaned),
n AS (SELECT *, lag(b) OVER w AS was, a || b IS DISTINCT FROM lag(a || b) OVER w AS new,
  CASE WHEN trim(target) = '' THEN 1 ELSE 0 END + CASE WHEN a = b AND length(a) >= 4 THEN 1 ELSE 0 END AS codes FROM m WINDOW w AS (PARTITION BY media_id ORDER BY pos))
SELECT media_id, count(*) AS source_cues, count(*) FILTER (WHERE new) AS cues, count(*) FILTER (WHERE NOT new) AS n_merged, count(*) FILTER (WHERE origin IN ('saved', 'model')) AS n_model, count(*) FILTER (WHERE origin = 'ocr') AS n_ocr,
  count(*) FILTER (WHERE origin = 'incomplete') AS n_incomplete, sum(codes)::BIGINT AS n_blocking, count(*) FILTER (WHERE was <> '' AND b = was) AS n_repeated FROM n GROUP BY media_id""")
def cleaning_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.summary(_cleaned(spark, d), {"han": r"[\x{4e00}-\x{9fff}]"})


@query("k25_burned_captions")
def burned_captions(spark: SparkSession, d: str) -> DataFrame:
    """Three frames of each cue, as they might be read: whole texts, with a letter wrong in one of three, and the role below; no target in each fifth frame, nothing at all in each eleventh."""
    from cuelake.plans import burned

    rows = cues(spark, d).where("end_ms > start_ms")
    k = F.col("k")
    frames = rows.select("media_id", F.col("pos").alias("cue"), "start_ms", "end_ms", "text", "role", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    frame = F.col("cue") * 3 + k
    read = F.when(frame % 11 == 0, "").when(k == 1, F.concat(F.lit("~q"), F.substring("text", 3, 1_000_000_000))).otherwise(F.col("text"))
    box = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("left", 1), ("top", 2), ("width", 30), ("height", 4))])
    frames = frames.select(
        "media_id", "cue", frame.alias("frame"), (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * (2 * k + 1) / 6)).cast("long").alias("at_ms"), read.alias("source"),
        F.when((frame % 5 != 0) & (frame % 11 != 0), F.concat("role", F.lit(" "), (F.col("cue") % 4).cast("string"))).alias("target"), F.when(frame % 7 != 0, box).alias("source_box"), box.alias("target_box"),
    )
    return burned.extracted(rows.select("media_id", "pos", "start_ms", "end_ms"), frames)
