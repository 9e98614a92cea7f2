"""Evidence of burned-in captions against recognition and translation, and what a person or a judge should look at.

Captions are cues with ``stability`` (0 to 1, null: unknown); null texts are empty. What is told of a recording is a row of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import similarity as S
from cuelake.functions import text as T
from cuelake.operators import intervals as J
from cuelake.operators.terms import count_terms
from cuelake.sources.files import kept

#: Captions so stable count; ratios of lengths outside these are odd; a disagreement to look at; a run's least likeness.
STABLE, RATIOS, DOUBT, LIKE = 0.75, (0.2, 4.0), 0.45, 0.78


def parts(left: DataFrame, right: DataFrame, tolerance_ms: int, group: str = "media_id") -> DataFrame:
    """group, side (l or r), pos, part: rows of both tracks that overlap, directly or by others, share a part. A left row without
    any goes to the part of the nearest right row within the tolerance; clock shifts are mended that way, and
    neighbours are not chained."""
    keep = lambda df, s: df.select(group, F.lit(s).alias("side"), "pos", "start_ms", "end_ms")
    both = keep(left, "l").unionByName(keep(right, "r"))
    order = Window.partitionBy(group).orderBy("start_ms", "end_ms", "side", "pos")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_new", F.when(before.isNull() | (F.col("start_ms") >= before), 1).otherwise(0))
    both = both.withColumn("part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_right", F.count_if(F.col("side") == "r").over(Window.partitionBy(group, "part")))
    alone = left.join(both.where("side = 'l' and _right = 0").select(group, "pos"), [group, "pos"], "left_semi")
    near = J.nearest_within(alone, right, tolerance_ms, group).select(group, "pos", F.col("other_pos"))
    theirs = both.where("side = 'r'").select(group, F.col("pos").alias("other_pos"), F.col("part").alias("_to"))
    moved = near.join(theirs, [group, "other_pos"]).select(group, "pos", F.lit("l").alias("side"), "_to")
    return both.join(moved, [group, "side", "pos"], "left").select(group, "side", "pos", F.coalesce("_to", "part").alias("part"))


def _union_ms(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
    """by, name: length of the union of intervals. The keys are packed as islands take one."""
    packed = rows.select(F.struct(*by).alias("k"), "start_ms", "end_ms")
    return J.union_length(packed, "k").select("k.*", F.col("covered_ms").alias(name))


def _texts(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
    """by, name: plain texts in order, one after the other."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "plain")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["plain"]), "").alias(name))


def recognition_signals(captions: DataFrame, heard: DataFrame, latin: str, tolerance_ms: int = 500, stable: float = STABLE, group: str = "media_id") -> DataFrame:
    """group, coverage (of all captions' time that stable ones have), disagreement (edits of what is heard to stable captions, a
    character), missing (of stable captions' time, without anything heard), extra (of heard time, without captions), repeated (cues like the one before),
    anomalous (heard texts without a letter of ``latin``), reference_characters."""
    at = parts(captions, heard, tolerance_ms, group)
    plain = T.word_characters(F.coalesce("text", F.lit("")))
    left = captions.withColumn("plain", plain).join(at.where("side = 'l'").drop("side"), [group, "pos"])
    right = heard.withColumn("plain", plain).join(at.where("side = 'r'").drop("side"), [group, "pos"])
    steady = left.where((F.col("stability") >= stable) & (F.col("plain") != ""))
    by = [group, "part"]
    each = _texts(steady, "said", by).join(_texts(right, "heard", by), by, "left").join(_union_ms(steady, "ms", by), by, "left").withColumn("heard", F.coalesce("heard", F.lit("")))
    each = each.withColumn("edits", S.edit_distance(F.col("said"), F.col("heard")))
    sums = each.groupBy(group).agg(
        F.sum("ms").alias("stable_ms"), F.sum("edits").alias("edits"), F.sum(F.length("said")).alias("reference_characters"), F.sum(F.when(F.col("heard") == "", F.col("ms")).otherwise(0)).alias("missing_ms"),
    )
    lone = right.where("plain <> ''").join(left.select(*by).distinct(), by, "left_anti")
    order = Window.partitionBy(group).orderBy("pos")
    marked = right.withColumn("again", (F.col("plain") != "") & (F.col("plain") == F.lag("plain").over(order)))
    tracks = marked.groupBy(group).agg(
        S.safe_rate(F.count_if("again"), F.count("*")).alias("repeated"), S.safe_rate(F.count_if((F.col("plain") != "") & ~F.col("text").rlike(latin)), F.count_if(F.col("plain") != "")).alias("anomalous"),
    )
    out = captions.select(group).distinct()
    for side in (sums, tracks, _union_ms(left.where("plain <> ''"), "caption_ms", [group]), _union_ms(lone, "lone_ms", [group]), _union_ms(right, "heard_ms", [group])):
        out = out.join(side, group, "left")
    rate = lambda a, b: S.safe_rate(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))
    return out.select(
        group, rate("stable_ms", "caption_ms").alias("coverage"), F.when(F.col("reference_characters") > 0, rate("edits", "reference_characters")).alias("disagreement"), rate("missing_ms", "stable_ms").alias("missing"),
        rate("lone_ms", "heard_ms").alias("extra"), F.coalesce("repeated", F.lit(0.0)).alias("repeated"), F.coalesce("anomalous", F.lit(0.0)).alias("anomalous"), F.coalesce("reference_characters", F.lit(0)).alias("reference_characters"),
    )


def translation_rows(captions: DataFrame, source: DataFrame, translation: DataFrame, blocking: Callable[[Column, Column], Column], tolerance_ms: int = 500, group: str = "media_id") -> DataFrame:
    """A row for each caption (``target``: its burned-in translation): source and translation aligned with it, issues (comma-joined), disagreement of the
    translation with the target (null without a target) and needs_review."""

    def aligned(track: DataFrame, name: str) -> DataFrame:
        at = parts(captions, track, tolerance_ms, group)
        listed = F.array_sort(F.collect_list(F.struct("pos", "text")))
        texts = track.select(group, "pos", "text").join(at.where("side = 'r'").drop("side"), [group, "pos"]).groupBy(group, "part").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias(name))
        return at.where("side = 'l'").drop("side").join(texts, [group, "part"], "left").select(group, "pos", F.coalesce(name, F.lit("")).alias(name))

    rows = captions.select(group, "pos", "start_ms", "end_ms", F.coalesce("target", F.lit("")).alias("target")).join(aligned(source, "source"), [group, "pos"]).join(aligned(translation, "translation"), [group, "pos"])
    a, b, c = (F.length(T.word_characters(F.col(x))) for x in ("source", "translation", "target"))
    odd = (a > 0) & (b > 0) & ~(b / a).between(*RATIOS)
    issues = F.concat(blocking(F.col("source"), F.col("translation")), F.array_compact(F.array(F.when((F.col("target") != "") & (b == 0), "ocr_target_without_translation"), F.when(odd, "abnormal_length_ratio"))))
    edits = F.col("_edits")
    rows = rows.withColumn("_edits", S.edit_distance(T.word_characters(F.col("target")), T.word_characters(F.col("translation"))))
    rows = rows.withColumns({"issues": F.array_join(F.array_distinct(issues), ","), "disagreement": F.when(c > 0, S.safe_rate(edits, c)), "edits": F.when(c > 0, edits), "characters": F.when(c > 0, c)}).drop("_edits")
    return rows.withColumn("needs_review", (F.col("issues") != "") | F.coalesce(F.col("disagreement") >= DOUBT, F.lit(False)))


def translation_signals(rows: DataFrame, group: str = "media_id") -> DataFrame:
    """group, disagreement (edits a character of all targets), n_issues, n_abnormal, n_comparable, n_review of translation_rows."""
    n_issues = F.when(F.col("issues") == "", 0).otherwise(F.size(F.split("issues", ",")))
    out = rows.groupBy(group).agg(
        F.sum("edits").alias("e"), F.sum("characters").alias("c"), F.sum(n_issues).alias("n_issues"), F.count_if(F.contains("issues", F.lit("abnormal_length_ratio"))).alias("n_abnormal"), F.count("disagreement").alias("n_comparable"),
        F.count_if("needs_review").alias("n_review"),
    )
    return out.select(group, F.when(F.col("c") > 0, S.safe_rate(F.col("e"), F.col("c"))).alias("disagreement"), "n_issues", "n_abnormal", "n_comparable", "n_review")


def review_items(details: DataFrame, candidates: DataFrame, most: int = 20, group: str = "media_id") -> DataFrame:
    """group, place, pos, lines: of each recording the ``most`` rows of translation_rows that need a review, in order, with the candidates' (name, pos, text) translations of the same caption."""
    place = F.row_number().over(Window.partitionBy(group).orderBy("pos"))
    rows = details.where("needs_review").withColumn("place", place).where(F.col("place") <= most)
    theirs = candidates.groupBy(group, "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "text"))), lambda x: F.concat_ws(": ", x["name"], x["text"])).alias("c"))
    first = F.array(F.concat(F.lit("source: "), "source"), F.concat(F.lit("burned: "), "target"), F.concat(F.lit("baseline: "), "translation"))
    return rows.join(theirs, [group, "pos"], "left").select(group, "place", "pos", F.array_join(F.concat(first, F.coalesce("c", F.array().cast("array<string>"))), "\n").alias("lines"))


def temporal_stability(observations: DataFrame, by: list[str], like: float = LIKE) -> DataFrame:
    """by, score of groups of observations (pos, text, expected, box): 0.4 of the likeness of neighbours, 0.3 of the share that says something,
    0.2 of the overlap of neighbouring boxes, and 0.1 of the longest run like what is expected, full from three on. Null where nothing is said."""
    order = Window.partitionBy(*by).orderBy("pos")
    rows = observations.withColumns({"plain": T.word_characters(F.coalesce("text", F.lit(""))), "want": T.word_characters(F.coalesce("expected", F.lit("")))})
    rows = rows.withColumn("was", F.lag("plain").over(order))
    rows = rows.withColumns({"near": F.when((F.col("plain") != "") & (F.col("was") != ""), S.matching_ratio("was", "plain")), "hit": F.when(F.col("plain") != "", S.matching_ratio("want", "plain"))})
    rows = rows.withColumn("hit", F.coalesce(F.col("hit") >= like, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    boxed = observations.where("box is not null").withColumn("_before", F.lag("box").over(order)).where("_before is not null")
    boxes = boxed.groupBy(*by).agg(F.avg(S.box_iou(F.col("_before"), F.col("box"))).alias("iou"))
    runs = rows.where("hit").groupBy(*by, "run").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("longest"))
    out = rows.groupBy(*by).agg(F.avg("near").alias("near"), F.avg((F.col("plain") != "").cast("int")).alias("present"), F.max("want").alias("want"))
    out = out.join(boxes, by, "left").join(runs, by, "left")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    score = 0.4 * none("near") + 0.3 * F.col("present") + 0.2 * none("iou") + 0.1 * F.least(F.lit(1.0), none(F.col("longest") / 3))
    return out.select(*by, F.when((F.col("present") > 0) & (F.col("want") != ""), F.round(score, 6)).alias("score"))


def terms_near(cues: DataFrame, windows: DataFrame, glossary: DataFrame, around: int = 2, most: int = 32, group: str = "media_id") -> DataFrame:
    """group, pos (of the window), terms: sources and aliases of glossary rows (source, aliases) of which the cues of the window, or ``around`` before and
    after it, hold one, in the glossary's order (``place``), each once whatever its case, at most ``most``. Each text is passed once for all
    names, whatever the number of windows."""
    order = Window.partitionBy(group).orderBy("pos")
    numbered = cues.select(group, "pos", F.lower("text").alias("said")).withColumn("k", F.row_number().over(order).cast("long"))
    inside = J.overlap_pairs(windows.select(group, "pos", "start_ms", "end_ms"), cues.select(group, "pos", "start_ms", "end_ms"), 0, group)
    wide = inside.select(group, F.col("l_pos").alias("w"), F.col("r_pos").alias("pos")).join(numbered.select(group, "pos", "k"), [group, "pos"])
    wide = wide.select(group, "w", F.explode(F.sequence(F.col("k") - around, F.col("k") + around)).alias("k")).distinct()
    names = glossary.select("place", F.posexplode(F.array_compact(F.concat(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("k2", "name"))
    names = names.withColumn("name", F.trim("name")).where("name <> ''").withColumn("low", F.lower("name"))
    held = count_terms(numbered, [group, "k"], "said", names.select("low")).join(names.select("place", "low"), "low").select(group, "k", "place").distinct()
    hits = wide.join(held, [group, "k"]).select(group, "w", "place").distinct().join(names, "place")
    first = hits.groupBy(group, "w", "low").agg(F.min(F.struct("place", "k2", "name")).alias("b"))
    ordered = F.transform(F.array_sort(F.collect_list("b")), lambda x: x["name"])
    return first.groupBy(group, F.col("w").alias("pos")).agg(F.array_join(F.slice(ordered, 1, most), ", ").alias("terms"))


def judged(questions: DataFrame, cache: DataFrame, judge: Callable[[], Callable[[str, str], str]], most: int) -> DataFrame:
    """questions (key, a, b, place) with preference and origin: the cache's (key, preference), else for the first ``most`` others by place the judge's, which sees the
    sides as the key's last digit has them; the rest is over budget. ``judge`` makes the model once for each task."""
    known = kept(questions.join(cache.select("key", F.col("preference").alias("_p")), "key", "left"))  # read for the first ``most``, for the judge and for the result
    open_ = known.where("_p is null")
    asked = open_.orderBy("place", "key").limit(most).select("key").withColumn("_ask", F.lit(True))
    rows = known.join(asked, "key", "left").withColumn("_swap", F.conv(F.right("key", F.lit(1)), 16, 10).cast("int") % 2 == 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = judge()
        for pdf in batches:
            said = [ask(b, a) if swap else ask(a, b) for a, b, swap in zip(pdf["a"], pdf["b"], pdf["_swap"], strict=True)]
            back = {"A": "B", "B": "A"}
            yield pd.DataFrame({"key": pdf["key"], "said": [back.get(s, s) if swap else s for s, swap in zip(said, pdf["_swap"], strict=True)]})

    made = rows.where("_ask").select("key", "a", "b", "_swap").mapInPandas(run, "key string, said string")
    out = rows.join(made, "key", "left")
    origin = F.when(F.col("_p").isNotNull(), "cache").when(F.col("_ask"), "judge").otherwise("over budget")
    return out.select("key", F.coalesce("_p", "said").alias("preference"), origin.alias("origin"))
