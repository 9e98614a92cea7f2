"""Evaluation campaigns: runs of several profiles over the same samples, compared, and whether one may take another's place.

clips: sample, source_group, profile, clip, substitutions, insertions, deletions, words (of the reference), empty (nothing was
recognized). Any number of profiles and samples; a clip is a row. runs: sample, profile, seconds, memory_mib."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators import bootstrap as B
from cuelake.sources.files import kept

#: A hallucination has so many insertions and so many for each word; what a candidate must gain relative to the present
#: profile; by how much no sample may lose; samples on which it must be no worse.
INSERTED, INSERTED_RATE, LEAST_GAIN, SEVERE, LEAST_SAMPLES = 3, 0.2, 0.05, 0.05, 4


def _rate(errors: Column, words: Column) -> Column:
    return F.round(errors / F.greatest(words, F.lit(1)), 8)


def marked(clips: DataFrame) -> DataFrame:
    """clips with errors and hallucinated."""
    inserted = (F.col("insertions") >= INSERTED) & (F.col("insertions") / F.greatest("words", F.lit(1)) >= INSERTED_RATE)
    return clips.withColumns({"errors": (F.col("substitutions") + F.col("insertions") + F.col("deletions")).cast("long"), "hallucinated": inserted})


def _sums() -> list[Column]:
    long = lambda c: F.sum(c).cast("long")
    return [
        long("errors").alias("errors"), long("words").alias("words"), long("insertions").alias("insertions"), F.count_if("hallucinated").alias("hallucinations"),
        F.count_if("empty").alias("empty"), F.count("*").alias("clips"),
    ]


def metrics(clips: DataFrame, runs: DataFrame) -> DataFrame:
    """level (sample, group or corpus), source_group, sample, profile, metric, value: rates and counts by rollup, a row for each metric. seconds add up, memory is the most."""
    keys = ["source_group", "sample"]
    level = F.when(F.grouping_id() == 0, "sample").when(F.grouping_id() == 1, "group").otherwise("corpus").alias("level")
    groups = clips.select(*keys).distinct()
    used = runs.join(groups, "sample")
    figures = marked(clips).groupBy("profile", *keys).agg(*_sums()).join(used.groupBy("profile", *keys).agg(F.sum("seconds").alias("seconds"), F.max("memory_mib").alias("memory_mib")), ["profile", *keys], "left")
    names = ["errors", "words", "insertions", "hallucinations", "empty", "clips"]
    sums = [F.sum(n).alias(n) for n in names] + [F.round(F.sum("seconds"), 6).alias("seconds"), F.max("memory_mib").alias("memory_mib")]
    # all levels of a profile from one aggregation
    rolled = figures.groupingSets([["profile", "source_group", "sample"], ["profile", "source_group"], ["profile"]], "profile", *keys).agg(level, *sums)
    rolled = rolled.withColumn("wer", _rate(F.col("errors"), F.col("words")))
    values = [F.col(n).cast("double").alias(n) for n in ("wer", *names, "seconds", "memory_mib")]
    return rolled.select("level", *keys, "profile", *values).unpivot(["level", *keys, "profile"], [n for n in ("wer", *names, "seconds", "memory_mib")], "metric", "value").where("value is not null")


def compared(clips: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right (profiles of pairs), sample, left_wer, right_wer, delta (left less right), and the pair's totals over all samples that both have."""
    by = marked(clips).groupBy("profile", "sample").agg(*_sums())
    side = lambda s: by.select(F.col("profile").alias(s), "sample", *[F.col(c).alias(f"{s}_{c}") for c in ("errors", "words", "insertions", "hallucinations", "empty")])
    rows = pairs.select("left", "right").distinct().join(side("left"), "left").join(side("right"), ["right", "sample"])
    left, right = (_rate(F.col(f"{s}_errors"), F.col(f"{s}_words")) for s in ("left", "right"))
    return rows.withColumns({"left_wer": left, "right_wer": right}).withColumn("delta", F.round(F.col("left_wer") - F.col("right_wer"), 8))


def intervals(clips: DataFrame, pairs: DataFrame, seed: str, resamples: int = 10_000) -> DataFrame:
    """left, right, mean_delta, low, high, right_won, left_won, ties, n: the paired bootstrap of each of a few pairs."""
    # clips are made once for all pairs, and units once for the counts and draws of each
    figures = clips.select("profile", "sample", "clip", "substitutions", "insertions", "deletions", "words")
    rows, out = kept(figures), None
    for p in pairs.select("left", "right").distinct().collect():  # pairs of profiles, a few
        of = lambda name: rows.where(F.col("profile") == name)
        units = kept(B.paired_units(of(p["left"]), of(p["right"]), ["sample", "clip"]))
        made = B.paired_bootstrap(units, f"{seed}:{p['left']}:{p['right']}", resamples).select(F.lit(p["left"]).alias("left"), F.lit(p["right"]).alias("right"), "mean_delta", "low", "high", "right_won", "left_won", "ties", "n")
        out = made if out is None else out.unionByName(made)
    return out


def promotion(clips: DataFrame, pairs: DataFrame, spread: DataFrame, least_samples: int = LEAST_SAMPLES) -> DataFrame:
    """left, right, left_wer, right_wer, gain (relative), non_inferior (samples), severe, decision (promote or keep) and reasons: what speaks
    against the right profile in the left one's place, in order. spread: left, right, low of an interval of the difference; without one it is not promoted."""
    samples = compared(clips, pairs)
    total = lambda c: F.sum(c).cast("long").alias(c)
    sums = samples.groupBy("left", "right").agg(
        *[total(f"{s}_{c}") for s in ("left", "right") for c in ("errors", "words", "insertions", "hallucinations", "empty")],
        F.count_if(F.col("right_wer") <= F.col("left_wer")).alias("non_inferior"), F.bool_or(F.col("right_wer") - F.col("left_wer") > SEVERE).alias("severe"),
    )
    left, right = (_rate(F.col(f"{s}_errors"), F.col(f"{s}_words")) for s in ("left", "right"))
    rows = sums.withColumns({"left_wer": left, "right_wer": right}).withColumn("gain", F.round((F.col("left_wer") - F.col("right_wer")) / F.greatest("left_wer", F.lit(1e-12)), 8))
    rows = rows.join(spread.select("left", "right", "low"), ["left", "right"], "left")
    c = F.col
    against = {
        "interval": ~F.coalesce(c("low") > 0, F.lit(False)), "gain": c("gain") < LEAST_GAIN, "samples": c("non_inferior") < least_samples, "severe": c("severe"), "insertions": c("right_insertions") > c("left_insertions"),
        "hallucinations": c("right_hallucinations") > c("left_hallucinations"), "empty": c("right_empty") > c("left_empty"),
    }
    reasons = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in against.items()]))
    rows = rows.withColumn("reasons", F.array_join(reasons, ","))
    return rows.select("left", "right", "left_wer", "right_wer", "gain", "non_inferior", "severe", F.when(F.col("reasons") == "", "promote").otherwise("keep").alias("decision"), "reasons")


def preserved(left: DataFrame, right: DataFrame) -> DataFrame:
    """sample, text_preserved, and decision (keep for review, or reject if any sample's text differs) of two tracks (sample, pos, plain)."""

    def prints(rows: DataFrame, name: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("pos", "plain")))
        return rows.groupBy("sample").agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["plain"]), ""), 256).alias(name))

    rows = prints(left, "a").join(prints(right, "b"), "sample", "full").select("sample", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("text_preserved"))
    whole = rows.agg(F.bool_and("text_preserved").alias("all"))
    return rows.crossJoin(F.broadcast(whole)).select("sample", "text_preserved", F.when(F.col("all"), "keep").otherwise("reject").alias("decision"))  # one row


def retry_decision(windows: DataFrame) -> DataFrame:
    """One row of windows (planned, executed, accepted: true or not): their counts, and whether retries stay dry runs."""
    counts = windows.agg(*[F.count_if(c).alias(c) for c in ("planned", "executed", "accepted")])
    return counts.withColumn("decision", F.when(F.col("accepted") == 0, "dry_run").otherwise("confirm"))
