"""Retries of doubtful stretches: windows that are decoded again, what speaks against a candidate, and what comes of it.

Windows have a group, a ``pos`` and times; a recording has at most MOST_WINDOWS that are tried, so that what is done for each
window over its recording's cues stays a small multiple of the cues. Recordings without cues give no rows; null texts are empty."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import intervals as J
from cuelake.operators import review as V
from cuelake.operators import rules as R
from cuelake.sources.files import kept

#: Padding, joining and length of windows in ms, how many are tried, of which share of the recording, and the least gain.
PAD_MS, MERGE_MS, MOST_MS, MOST_WINDOWS, SHARE, LEAST_GAIN = 1250, 250, 30_000, 20, 0.1, 0.2

#: Codes against a candidate, in order.
CODES = (
    "empty_candidate", "invalid_candidate_timeline", "compression_hard_limit", "no_speech_regressed", "duplicate_regressed", "coverage_out_of_range",
    "text_length_out_of_range", "candidate_artifact_invalid", "adjacent_duplicate_regressed", "control_text_detected",
)
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def quality(cues: DataFrame, windows: DataFrame, group: str = "media_id") -> DataFrame:
    """For each window: n (cues that overlap it), covered_ms, mean_logprob, most_compression, n_conflict (text in silence), n_again
    (like the cue before in the window), n_suspicious, letters, first_ms, last_ms, n_control. Windows without cues have zeros and nulls."""
    held = cues.select(group, "pos", "start_ms", "end_ms", "text", T.letters_only(F.coalesce("text", F.lit(""))).alias("plain"), R.doubtful().alias("doubtful"), R.text_in_silence().alias("conflict"), "logprob_milli", "compression_milli")
    pairs = J.overlap_pairs(windows.select(group, "pos", "start_ms", "end_ms"), held, 0, group)
    inside = Window.partitionBy(group, "l_pos").orderBy("r_pos")
    again = F.coalesce((F.col("r_plain") == F.lag("r_plain").over(inside)) & (F.col("r_plain") != ""), F.lit(False))
    found = pairs.withColumn("again", again).groupBy(group, F.col("l_pos").alias("pos")).agg(
        F.count("*").alias("n"), F.sum("overlap_ms").alias("covered_ms"), F.avg("r_logprob_milli").alias("mean_logprob"), F.max("r_compression_milli").alias("most_compression"),
        F.count_if("r_conflict").alias("n_conflict"), F.count_if("again").alias("n_again"), F.count_if(F.col("r_doubtful") | F.col("again")).alias("n_suspicious"),
        F.sum(F.length("r_plain")).alias("letters"), F.min("r_start_ms").alias("first_ms"), F.max("r_end_ms").alias("last_ms"), F.count_if(F.col("r_text").rlike(CONTROL)).alias("n_control"),
    )
    return windows.select(group, "pos", F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms")).join(found, [group, "pos"], "left").fillna(0, ["n", "covered_ms", "n_conflict", "n_again", "n_suspicious", "letters", "n_control"])


def plan_windows(cues: DataFrame, pad_ms: int = PAD_MS, merge_ms: int = MERGE_MS, most_ms: int = MOST_MS, most_windows: int = MOST_WINDOWS, share: float = SHARE, group: str = "media_id") -> DataFrame:
    """group, pos, start_ms, end_ms, n_suspicious, taken: suspicious cues padded, merged where they come within ``merge_ms``, and cut to
    ``most_ms`` about their middle. Those with the most suspicious cues, then the first, are taken while their number and their share of
    the recording allow; later, shorter ones may fit where one did not. Without a duration there is no such share."""
    flagged = R.suspicious(cues, group).where("suspicious")
    wide = flagged.select(group, F.greatest(F.lit(0).cast("long"), F.col("start_ms") - pad_ms).alias("start_ms"), (F.col("end_ms") + pad_ms).alias("end_ms"))
    merged = J.islands(wide, merge_ms, group).withColumn("mid", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
    long, half = F.col("end_ms") - F.col("start_ms") > most_ms, most_ms // 2
    cut = merged.select(
        group, F.col("island").alias("pos"), F.when(long, F.greatest(F.lit(0).cast("long"), F.col("mid") - half)).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(long, F.col("mid") + half).otherwise(F.col("end_ms")).alias("end_ms"),
    )
    counted = quality(cues, cut, group).select(group, "pos", F.col("from_ms").alias("start_ms"), F.col("to_ms").alias("end_ms"), "n_suspicious")
    lasts = cues.groupBy(group).agg(F.floor(F.max_by("end_ms", "pos") * share).cast("long").alias("_budget"))
    rows = counted.withColumn("_cost", F.col("end_ms") - F.col("start_ms")).join(lasts, group)
    return V.greedy_budget(rows, "_cost", [F.desc("n_suspicious"), F.col("start_ms")], most_windows, F.col("_budget"), group).drop("_cost", "_budget")


def after_replace(baseline: DataFrame, candidate: DataFrame, windows: DataFrame, slack_ms: int = 250, group: str = "media_id") -> DataFrame:
    """group, pos, n_again, n_invalid of each window, were its cues the candidate's: neighbours in the merged track that read
    alike and start within ``slack_ms`` of the end before, and cues that break the track."""
    w = windows.select(group, F.col("pos").alias("_w"), F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"))
    columns = [group, "_w", "start_ms", "end_ms", "text"]
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    kept = baseline.join(w, group).where(~mid.between(F.col("_from"), F.col("_to"))).select(columns)
    put = candidate.join(w, group).where((F.col("start_ms") < F.col("_to")) & (F.col("end_ms") > F.col("_from"))).select(columns)
    order = Window.partitionBy(group, "_w").orderBy("start_ms", "end_ms", "text")
    rows = kept.unionByName(put).withColumn("plain", T.letters_only(F.coalesce("text", F.lit(""))))
    rows = rows.withColumns({"was": F.lag("plain").over(order), "before": F.lag("end_ms").over(order)})
    again = (F.col("plain") != "") & (F.col("plain") == F.col("was")) & (F.col("start_ms") <= F.col("before") + slack_ms)
    broken = (F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")) | F.coalesce(F.col("start_ms") < F.col("before"), F.lit(False)) | F.coalesce(F.col("text").rlike(CONTROL), F.lit(False))
    found = rows.groupBy(group, F.col("_w").alias("pos")).agg(F.count_if(again).alias("n_again"), F.count_if(broken).alias("n_invalid"))
    return windows.select(group, "pos").join(found, [group, "pos"], "left").fillna(0, ["n_again", "n_invalid"])


def rejections(b: dict[str, Column], c: dict[str, Column], track_invalid: Column, again: Column) -> Column:
    """The CODES that hold of a candidate window (c) against the baseline's (b)."""
    within = lambda part, whole, low, high: (whole > 0) & ~(part / whole).between(low, high)
    holds = (
        (c["n"] == 0) & (b["n"] > 0), c["first_ms"].isNull() | (c["last_ms"] <= c["first_ms"]), c["most_compression"] > 2800, c["n_conflict"] > b["n_conflict"], c["n_again"] > b["n_again"],
        within(c["covered_ms"], b["covered_ms"], 0.75, 1.25), within(c["letters"], b["letters"], 0.5, 1.8), track_invalid, again, c["n_control"] > 0,
    )
    return F.array_compact(F.array(*[F.when(h, code) for h, code in zip(holds, CODES, strict=True)]))


def improvement(b: dict[str, Column], c: dict[str, Column]) -> Column:
    """Weighted gains: confidence 1, compression, repeats and text in silence a half, suspicious cues a quarter; losses count nothing."""
    gain = lambda x: F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))
    return F.round(
        gain(c["mean_logprob"] - b["mean_logprob"]) / 1000 + gain(b["most_compression"] - c["most_compression"]) / 1000 * 0.5 + gain(b["n_again"] - c["n_again"]) * 0.5
        + gain(b["n_conflict"] - c["n_conflict"]) * 0.5 + gain(b["n_suspicious"] - c["n_suspicious"]) * 0.25, 6,
    )


def decide(baseline: DataFrame, candidate: DataFrame, windows: DataFrame, least_gain: float = LEAST_GAIN, group: str = "media_id") -> DataFrame:
    """group, pos, accepted, reasons, score of each window: accepted if nothing speaks against it, something is mended and the gain is enough."""
    measures = ("n", "covered_ms", "mean_logprob", "most_compression", "n_conflict", "n_again", "n_suspicious", "letters", "first_ms", "last_ms", "n_control")
    side = lambda cues, p: quality(cues, windows, group).select(group, "pos", *[F.col(m).alias(f"{p}_{m}") for m in measures])
    rows = side(baseline, "b").join(side(candidate, "c"), [group, "pos"])
    rows = rows.join(after_replace(baseline, candidate, windows, group=group).select(group, "pos", ((F.col("n_again") > 0) | (F.col("n_invalid") > 0)).alias("_again")), [group, "pos"])
    broken = R.invalid_strict(candidate, group).select(group).distinct().withColumn("_broken", F.lit(True))
    rows = rows.join(broken, group, "left").withColumn("_broken", F.coalesce("_broken", F.lit(False)))
    b, c = ({m: F.col(f"{p}_{m}") for m in measures} for p in ("b", "c"))
    rows = rows.withColumns({"codes": rejections(b, c, F.col("_broken"), F.col("_again")), "score": improvement(b, c)})
    mended = (c["n_suspicious"] < b["n_suspicious"]) | (c["n_again"] < b["n_again"]) | (c["n_conflict"] < b["n_conflict"]) | F.coalesce(c["most_compression"] < b["most_compression"], F.lit(False))
    accepted = (F.size("codes") == 0) & mended & (F.col("score") >= least_gain)
    reasons = F.when(accepted, "accepted").when(F.size("codes") == 0, "no_clear_improvement").otherwise(F.array_join("codes", ","))
    return rows.select(group, "pos", accepted.alias("accepted"), reasons.alias("reasons"), "score")


def report(planned: DataFrame, decided: DataFrame, group: str = "media_id") -> DataFrame:
    """group, n_planned, n_executed, n_accepted, n_rejected, n_skipped: windows planned (taken or not), and what was decided of those taken."""
    rows = planned.join(decided.select(group, "pos", "accepted"), [group, "pos"], "left").withColumn("ok", F.coalesce("accepted", F.lit(False)) & F.col("taken"))
    return rows.groupBy(group).agg(
        F.count("*").alias("n_planned"), F.count_if("taken").alias("n_executed"), F.count_if("ok").alias("n_accepted"), F.count_if(F.col("taken") & ~F.col("ok")).alias("n_rejected"), F.count_if(~F.col("taken")).alias("n_skipped"),
    )


CANDIDATE = "start_ms long, end_ms long, text string, logprob_milli long, compression_milli long, silence_milli long"


def redecoded(windows: DataFrame, decode: Callable[[], Callable[[dict], list[dict]]], group: str = "media_id") -> DataFrame:
    """group, pos, and CANDIDATE: cues of windows (group, pos, start_ms, end_ms, and what else decode is given) that were decoded again.

    decode makes the model once for each task; it gives cues (dicts of CANDIDATE) for a window (a dict), or raises ValueError, which leaves the window without any. Times that
    count from the window's start are moved there; cues that do not touch the window go. pos numbers a recording's new cues in order of time."""
    names = [c.split()[0] for c in CANDIDATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        say = decode()
        for pdf in batches:
            out = []
            for window in pdf.to_dict("records"):
                low, high = int(window["start_ms"]), int(window["end_ms"])
                try:
                    found = say(window)
                except ValueError:
                    found = []
                if found:
                    local = max(c["end_ms"] for c in found) <= high - low + 2000 and min(c["start_ms"] for c in found) < max(500, low - 100)
                    for c in found:
                        moved = c["start_ms"] + (low if local else 0)
                        start, end = max(0, moved), max(moved + 1, c["end_ms"] + (low if local else 0))
                        if start < high and end > low:
                            out.append((window[group], *[(c | {"start_ms": start, "end_ms": end}).get(n) for n in names]))
            yield pd.DataFrame(out, columns=[group, *names]).astype({n: "Int64" for n in names if n != "text"})

    made = windows.mapInPandas(run, f"`{group}` {windows.schema[group].dataType.simpleString()}, {CANDIDATE}")
    return made.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy("start_ms", "end_ms", "text")).cast("long"))


def controlled(baseline: DataFrame, decode: Callable[[], Callable[[dict], list[dict]]], mode: str = "dry_run", group: str = "media_id") -> tuple[DataFrame, DataFrame]:
    """(windows, cues) of a controlled retry of baseline. windows: group, pos, start_ms, end_ms, n_suspicious, taken, accepted, reasons, score; only ``apply`` accepts any, other modes say
    dry_run beside the reasons; windows that the budget left out are skipped; ``off`` plans none. cues: what was decoded."""
    planned = kept(plan_windows(baseline, group=group).where(F.lit(mode != "off")))
    windows = planned.where("taken").select(group, "pos", "start_ms", "end_ms")
    made = kept(redecoded(windows, decode, group))
    rows = planned.join(decide(baseline, made, windows, group=group), [group, "pos"], "left")
    dry = F.lit(mode != "apply")
    reasons = F.when(~F.col("taken"), "skipped").when(dry, F.concat("reasons", F.lit(",dry_run"))).otherwise(F.col("reasons"))
    accepted = F.coalesce("accepted", F.lit(False)) & F.col("taken") & ~dry
    return rows.select(group, "pos", "start_ms", "end_ms", "n_suspicious", "taken", accepted.alias("accepted"), reasons.alias("reasons"), "score"), made
