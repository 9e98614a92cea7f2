"""Burned-in captions after recognition: what was read in frames becomes captions with times, agreed texts and a stability.

cues: group, pos, start_ms, end_ms (the times that frames were sampled in). frames: group, cue (pos of a cue), frame, at_ms, source and target (lines read,
null or empty: nothing), source_box and target_box (struct left, top, width, height; may be null)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.similarity import alike
from cuelake.operators import evidence as E
from cuelake.operators.metrics import consensus, plain_caption
from cuelake.sources.files import kept

#: The least likeness of two readings of one caption; the least time between two frames of one text change, in ms.
LIKE, APART_MS = 0.78, 250


def pieces(cues: DataFrame, frames: DataFrame, group: str = "media_id") -> DataFrame:
    """frames with start_ms and end_ms: each lasts from halfway to the frame before, or its cue's start, to halfway to the next, or its cue's end. Those without any time go."""
    of_cue = Window.partitionBy(group, "cue").orderBy("at_ms", "frame")
    half = lambda other: F.floor((F.col("at_ms") + other) / 2).cast("long")
    rows = frames.join(cues.select(group, F.col("pos").alias("cue"), F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to")), [group, "cue"])
    rows = rows.withColumns({"start_ms": F.coalesce(half(F.lag("at_ms").over(of_cue)), "_from"), "end_ms": F.coalesce(half(F.lead("at_ms").over(of_cue)), "_to")})
    return rows.where("end_ms > start_ms").drop("_from", "_to")


def _alike(a: str, b: str) -> bool:
    return bool(a) and bool(b) and alike(a, b, LIKE)


def captions_of(rows: DataFrame, group: str = "media_id") -> DataFrame:
    """pieces with caption (0, 1, ...): a piece goes on with the caption before it if both lines are equal to that one's first piece's, or both like them. Pieces that say nothing are left out.

    Only the first piece of the caption at hand is held, whatever the length of a recording."""
    said = rows.withColumns({"_s": plain_caption(F.coalesce("source", F.lit(""))), "_t": plain_caption(F.coalesce("target", F.lit("")))}).where("_s <> '' or _t <> ''")
    order = [group, "start_ms", "end_ms", "frame"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, source, target, caption = object(), "", "", 0
        for pdf in batches:
            out = []
            for g, s, t in pdf[[group, "_s", "_t"]].itertuples(index=False):
                if g != now:
                    now, source, target, caption = g, s, t, 0
                elif (s, t) != (source, target) and not (_alike(target, t) and _alike(source, s)):
                    source, target, caption = s, t, caption + 1
                out.append(caption)
            yield pdf.drop(columns=["_s", "_t"]).assign(caption=out)

    kind = said.drop("_s", "_t").withColumn("caption", F.lit(0).cast("long")).schema
    return said.repartition(group).sortWithinPartitions(*order).mapInPandas(run, kind)


def agreed(rows: DataFrame, group: str = "media_id") -> DataFrame:
    """group, caption, start_ms, end_ms, n (frames), source, target (of each the reading most like all others), source_stability and target_stability (over time: likeness of
    neighbours, presence, boxes, longest run; null where nothing is said) of pieces with caption."""
    rows = kept(rows)
    by = [group, "caption"]
    out = rows.groupBy(*by).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))
    for side in ("source", "target"):
        seen = rows.select(*by, F.col("frame").alias("pos"), F.col(side).alias("text"), F.col(f"{side}_box").alias("box"))
        most = consensus(seen, by).select(*by, F.col("text").alias(side))
        out = out.join(most, by, "left")
        expected = seen.join(most, by, "left").withColumnRenamed(side, "expected")
        out = out.join(E.temporal_stability(expected, by, LIKE).withColumnRenamed("score", f"{side}_stability"), by, "left")
    return out.withColumns({s: F.coalesce(s, F.lit("")) for s in ("source", "target")})


def refinements(rows: DataFrame, apart_ms: int = APART_MS, group: str = "media_id") -> DataFrame:
    """group, cue, at_ms: times halfway between two frames of a cue whose texts differ, where another frame would show which text was on longer; frames
    closer than twice ``apart_ms`` have none."""
    of_cue = Window.partitionBy(group, "cue").orderBy("at_ms", "frame")
    text = F.concat_ws("\n", plain_caption(F.coalesce("source", F.lit(""))), plain_caption(F.coalesce("target", F.lit(""))))
    marked = rows.select(group, "cue", "at_ms", "frame", text.alias("_x"))
    marked = marked.withColumns({"_was": F.lag("_x").over(of_cue), "_before": F.lag("at_ms").over(of_cue)})
    changed = marked.where((F.col("_x") != F.col("_was")) & (F.col("at_ms") - F.col("_before") >= 2 * apart_ms))
    return changed.select(group, "cue", F.floor((F.col("at_ms") + F.col("_before")) / 2).cast("long").alias("at_ms"))


def extracted(cues: DataFrame, frames: DataFrame, group: str = "media_id") -> DataFrame:
    """The captions of frames, numbered from 1 (pos) in order."""
    made = agreed(captions_of(pieces(cues, frames, group), group), group)
    return made.withColumn("pos", F.col("caption") + 1).drop("caption")
