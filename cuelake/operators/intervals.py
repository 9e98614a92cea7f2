"""Operators over intervals: rows with a group, start_ms and end_ms.

Range conditions always come with an equality: on the group, and, where two
tracks meet, on time bins, so that joins are hash or sort-merge joins and a
long recording is spread over its bins. Three overlap rules are named apart:
``overlaps`` is strict, ``midpoint_inside`` half-open, ``midpoint_within`` closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bin; a pair of intervals meets in the first bin of both.
BIN_MS = 30_000


def islands(rows: DataFrame, gap_ms: int = 0, group: str = "media_id") -> DataFrame:
    """group, island (1, 2, ...), start_ms, end_ms, n: intervals merged where a
    start is at most ``gap_ms`` after the running end. Starts below 0 are 0; empty intervals go."""
    rows = rows.withColumn("start_ms", F.greatest("start_ms", F.lit(0).cast("long"))).where("end_ms > start_ms")
    order = Window.partitionBy(group).orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start_ms") > before + gap_ms), 1).otherwise(0)
    rows = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(group, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


def gaps(rows: DataFrame, least_ms: int = 0, group: str = "media_id") -> DataFrame:
    """The stretches between islands that last longer than ``least_ms``."""
    merged = islands(rows, 0, group)
    following = F.lead("start_ms").over(Window.partitionBy(group).orderBy("start_ms"))
    return merged.select(group, F.col("end_ms").alias("start_ms"), following.alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") > least_ms)


def binned(rows: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """A row for each time bin an interval touches (``_bin``)."""
    last = F.greatest(F.floor(F.col("start_ms") / bin_ms), F.floor((F.col("end_ms") - 1) / bin_ms))
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_ms") / bin_ms), last)))


def overlap_pairs(left: DataFrame, right: DataFrame, least_ms: int = 0, group: str = "media_id", bin_ms: int = BIN_MS) -> DataFrame:
    """Pairs that overlap by more than ``least_ms``: columns of left as l_*, of
    right as r_*, and overlap_ms. Each pair comes once."""
    a, b = binned(left, bin_ms), binned(right, bin_ms)
    a = a.select([F.col(c).alias(c if c in (group, "_bin") else f"l_{c}") for c in a.columns])
    b = b.select([F.col(c).alias(c if c in (group, "_bin") else f"r_{c}") for c in b.columns])
    first_of_both = F.floor(F.greatest("l_start_ms", "r_start_ms") / bin_ms)
    overlap = F.least("l_end_ms", "r_end_ms") - F.greatest("l_start_ms", "r_start_ms")
    return a.join(b, [group, "_bin"]).where((F.col("_bin") == first_of_both) & (overlap > least_ms)).withColumn("overlap_ms", overlap).drop("_bin")


def best_overlap(left: DataFrame, right: DataFrame, least_ms: int = 300, group: str = "media_id") -> DataFrame:
    """Each left row with the right row it overlaps most, if by more than
    ``least_ms``; the first of equals. A right row may serve many left rows."""
    pairs = overlap_pairs(left, right, least_ms, group)
    best = F.min(F.struct((-F.col("overlap_ms")).alias("minus"), F.col("r_pos").alias("r_pos"), F.col("r_text").alias("r_text")))
    out = pairs.groupBy(group, "l_pos", "l_text").agg(best.alias("b"))
    return out.select(group, F.col("l_pos").alias("pos"), F.col("l_text").alias("text"), F.col("b.r_pos").alias("other_pos"), F.col("b.r_text").alias("other_text"), (-F.col("b.minus")).alias("overlap_ms"))


def nearest_within(left: DataFrame, right: DataFrame, tolerance_ms: int, group: str = "media_id") -> DataFrame:
    """For each left row, the right row at the least distance (0 where they
    overlap) within the tolerance; then the least difference of starts, then the first."""
    wide = left.withColumns({"_s": F.col("start_ms"), "_e": F.col("end_ms"), "start_ms": F.col("start_ms") - tolerance_ms - 1, "end_ms": F.col("end_ms") + tolerance_ms + 1})
    pairs = overlap_pairs(wide, right, 0, group)
    distance = F.greatest(F.lit(0).cast("long"), F.col("r_start_ms") - F.col("l__e"), F.col("l__s") - F.col("r_end_ms"))
    best = F.min(F.struct(distance.alias("d"), F.abs(F.col("r_start_ms") - F.col("l__s")).alias("s"), F.col("r_pos").alias("p")))
    out = pairs.where(distance <= tolerance_ms).groupBy(group, "l_pos").agg(best.alias("b"))
    return out.select(group, F.col("l_pos").alias("pos"), F.col("b.p").alias("other_pos"), F.col("b.d").alias("distance_ms"))


def aligned_groups(left: DataFrame, right: DataFrame, tolerance_ms: int = 0, group: str = "media_id") -> DataFrame:
    """Both tracks cut into groups that nothing overlaps across: group,
    part, n_left, n_right, start_ms, end_ms. Rows that stand alone are groups of their own.

    Overlaps of intervals are connected exactly where their union is, so that
    connected components are islands of the union of both tracks: touching is
    no overlap, and ``tolerance_ms`` closes gaps of up to that between them.
    """
    both = left.select(group, "start_ms", "end_ms", F.lit(1).alias("l")).unionByName(right.select(group, "start_ms", "end_ms", F.lit(0).alias("l")))
    order = Window.partitionBy(group).orderBy("start_ms", "end_ms", "l")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start_ms") >= before + tolerance_ms + (1 if tolerance_ms else 0)), 1).otherwise(0)
    both = both.withColumn("_new", new).withColumn("part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return both.groupBy(group, "part").agg(F.sum("l").alias("n_left"), F.sum(1 - F.col("l")).alias("n_right"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def bucket_alignment(left: DataFrame, right: DataFrame, window_ms: int = 15_000, group: str = "media_id") -> DataFrame:
    """Texts of both tracks by the bucket that a cue's midpoint is in, counted
    from the group's first start; full outer, buckets of neither are left out."""
    both = left.select(group, "pos", "text", "start_ms", "end_ms", F.lit("left").alias("side")).unionByName(right.select(group, "pos", "text", "start_ms", "end_ms", F.lit("right").alias("side")))
    span = both.groupBy(group).agg(F.min("start_ms").alias("t0"), F.max("end_ms").alias("t1"))
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0") - 1) / window_ms))
    bucket = F.least(last, F.floor((F.floor((F.col("start_ms") + F.col("end_ms")) / 2) - F.col("t0")) / window_ms))
    rows = both.join(span, group).withColumn("bucket", bucket)
    text = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "text")))), lambda x: x["text"]), " ")
    out = rows.groupBy(group, "bucket", "t0", "t1").agg(text("left").alias("left_text"), text("right").alias("right_text"), F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right"))
    start = F.col("t0") + F.col("bucket") * window_ms
    return out.select(group, "bucket", start.alias("start_ms"), F.least(start + window_ms, F.col("t1")).alias("end_ms"), "n_left", "n_right", "left_text", "right_text")


def midpoint_texts(clips: DataFrame, cues: DataFrame, group: str = "media_id") -> DataFrame:
    """For each clip (pos, start_ms, end_ms), the texts of cues whose midpoint is inside, the end excluded; empty if none."""
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    points = cues.select(group, F.col("pos").alias("c_pos"), F.col("text").alias("c_text"), mid.alias("mid")).withColumn("_bin", F.floor(F.col("mid") / BIN_MS))
    found = binned(clips).join(points, [group, "_bin"]).where("mid >= start_ms and mid < end_ms")
    texts = found.groupBy(group, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mid", "c_pos", "c_text"))), lambda x: x["c_text"]), " ").alias("heard"))
    return clips.select(group, "pos").join(texts, [group, "pos"], "left").select(group, "pos", F.coalesce("heard", F.lit("")).alias("heard"))


def touching(rows: DataFrame, windows: DataFrame, group: str = "media_id") -> DataFrame:
    """Rows that overlap a window (semi-join)."""
    pairs = overlap_pairs(rows.select(group, "pos", "start_ms", "end_ms"), windows.select(group, "start_ms", "end_ms"), 0, group)
    return rows.join(pairs.select(group, F.col("l_pos").alias("pos")).distinct(), [group, "pos"], "left_semi")


def replace_windows(base: DataFrame, candidate: DataFrame, windows: DataFrame, group: str = "media_id") -> DataFrame:
    """base without rows whose midpoint is within a window (both ends
    included), and the candidate's rows that overlap one; with ``origin``."""
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    points = base.withColumn("_mid", mid).withColumn("_bin", F.floor(mid / BIN_MS))
    wide = binned(windows.select(group, F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"), "start_ms", (F.col("end_ms") + 1).alias("end_ms"))).drop("start_ms", "end_ms")
    out = points.join(wide, (points[group] == wide[group]) & (points["_bin"] == wide["_bin"]) & (points["_mid"] >= wide["w_start"]) & (points["_mid"] <= wide["w_end"]), "left_anti")
    kept = out.drop("_mid", "_bin").withColumn("origin", F.lit("base"))
    return kept.unionByName(touching(candidate, windows, group).withColumn("origin", F.lit("candidate")), allowMissingColumns=True)


def difference(speech: DataFrame, cues: DataFrame, padding_ms: int = 250, least_ms: int = 1000, merge_ms: int = 500, group: str = "media_id") -> DataFrame:
    """Merged speech without the padded cues; what is shorter than ``least_ms`` goes, the rest is merged again."""
    covered = islands(cues.select(group, (F.col("start_ms") - padding_ms).alias("start_ms"), (F.col("end_ms") + padding_ms).alias("end_ms")), 0, group)
    spoken = islands(speech.select(group, "start_ms", "end_ms"), merge_ms, group)
    # between any two borders, a stretch is spoken or not, and covered or not
    ends = lambda df, s, c: df.select(group, F.col("start_ms").alias("at"), F.lit(s).alias("s"), F.lit(c).alias("c")).unionByName(df.select(group, F.col("end_ms").alias("at"), F.lit(-s).alias("s"), F.lit(-c).alias("c")))
    borders = ends(spoken, 1, 0).unionByName(ends(covered, 0, 1)).groupBy(group, "at").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    order = Window.partitionBy(group).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    stretches = borders.select(group, F.col("at").alias("start_ms"), F.lead("at").over(order).alias("end_ms"), F.sum("s").over(upto).alias("s"), F.sum("c").over(upto).alias("c"))
    left = stretches.where(f"s > 0 and c = 0 and end_ms - start_ms >= {least_ms}")
    return islands(left, merge_ms, group).select(group, "island", "start_ms", "end_ms")


def union_length(rows: DataFrame, group: str = "media_id") -> DataFrame:
    return islands(rows, 0, group).groupBy(group).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"))


def joined_texts(cues: DataFrame, other: DataFrame, least_ms: int = 50, group: str = "media_id") -> DataFrame:
    """Each cue with the distinct texts of the other track that overlap it by more than ``least_ms``, in order."""
    pairs = overlap_pairs(cues.select(group, "pos", "start_ms", "end_ms"), other.select(group, "pos", "text", "start_ms", "end_ms"), least_ms, group)
    first = pairs.groupBy(group, "l_pos", "r_text").agg(F.min(F.struct("r_start_ms", "r_pos")).alias("k"))
    return first.groupBy(group, F.col("l_pos").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "r_text"))), lambda x: x["r_text"]), " ").alias("heard"))


def clipped(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Length of an interval inside another."""
    return F.greatest(F.lit(0).cast("long"), F.least(end, high) - F.greatest(start, low))
