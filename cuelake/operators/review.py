"""Blind reviews, samples and budgets."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.similarity import hash_side


def stable_sample(rows: DataFrame, key: Column, seed: str, most: int) -> DataFrame:
    """The ``most`` rows of the least SHA-256 of seed and key."""
    return rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)).orderBy("_h", key).limit(most).drop("_h")


def review_sample(rows: DataFrame, flagged: Column, key: Column, seed: str, most: int, group: str = "media_id") -> DataFrame:
    """All flagged rows, and of the others the ``most`` of the least hash in each group."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(group, "_flag").orderBy("_h", "pos"))
    return rows.withColumns({"_flag": flagged, "_h": h}).withColumn("_r", rank).where(F.col("_flag") | (F.col("_r") <= most)).withColumnRenamed("_flag", "flagged").drop("_h", "_r")


def blind_pairs(rows: DataFrame, seed: str, left: str = "left_text", right: str = "right_text") -> DataFrame:
    """rows with a, b (the two texts, sides hidden by a hash) and left_is (A or B)."""
    swap = hash_side(F.lit(seed), F.col("media_id").cast("string"), F.col("pos").cast("string")) == 1
    return rows.withColumns({"a": F.when(swap, F.col(right)).otherwise(F.col(left)), "b": F.when(swap, F.col(left)).otherwise(F.col(right)), "left_is": F.when(swap, "B").otherwise("A")})


def blind_order(names: list[str], seed: str, *key: str) -> Column:
    """An order of the names, one of all permutations, by a hash of the key."""
    orders = [",".join(p) for p in permutations(names)]
    digest = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]), 256)
    return F.element_at(F.array(*[F.lit(o) for o in orders]), (F.conv(F.left(digest, F.lit(4)), 16, 10).cast("int") % len(orders)) + 1)


def score_pairs(reviews: DataFrame, key: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Reviews (choice A, B or tie) with the key (left_is): left wins, losses and ties."""
    rows = reviews.join(key, on)
    won = F.col("choice") == F.col("left_is")
    tie = F.lower("choice") == "tie"
    return rows.groupBy(*by).agg(F.count_if(won).alias("left_won"), F.count_if(~won & ~tie).alias("left_lost"), F.count_if(tie).alias("tied"), F.count("*").alias("n"))


def overall_vote(*dimensions: str) -> Column:
    """The first dimension that is a valid vote (A, B or tie)."""
    return F.coalesce(*[F.when(F.col(d).isin("A", "B", "tie"), F.col(d)) for d in dimensions])


def order_outcomes(rows: DataFrame, order: str = "ranking") -> DataFrame:
    """Orders such as ``A>B=C`` to a row for each pair: x, y, outcome (win, tie) where x is not behind y."""
    parts = F.split(F.col(order), ">")
    ranks = F.flatten(F.transform(parts, lambda p, i: F.transform(F.split(p, "="), lambda x: F.struct(i.alias("rank"), F.trim(x).alias("name")))))
    made = rows.withColumn("_r", ranks)
    pairs = F.flatten(F.transform("_r", lambda x: F.transform(F.filter("_r", lambda y: (x["rank"] < y["rank"]) | ((x["rank"] == y["rank"]) & (x["name"] < y["name"]))), lambda y: F.struct(x["name"].alias("x"), y["name"].alias("y"), F.when(x["rank"] < y["rank"], "win").otherwise("tie").alias("outcome")))))
    return made.withColumn("_p", F.explode(pairs)).select(*rows.columns, "_p.*")


def category_counts(rows: DataFrame, column: str = "categories", *by: str) -> DataFrame:
    """Comma-separated categories counted one by one."""
    one = rows.select(*by, F.explode(F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")).alias("category"))
    return one.groupBy(*by, "category").agg(F.count("*").alias("n"))


def greedy_budget(rows: DataFrame, cost: str, order: list[Column], most_rows: int, budget: Column, group: str = "media_id") -> DataFrame:
    """rows with taken: in order, each row that still fits the group's budget
    and count (later, smaller ones may fit where one did not). A budget of 0 is none."""
    keyed = rows.withColumns({"_b": budget, "_k": F.row_number().over(Window.partitionBy(group).orderBy(*order))})
    state = "struct<n:int,used:bigint,took:array<int>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("took")).cast(state)
    items = F.array_sort(F.collect_list(F.struct("_k", F.col(cost).alias("cost"))))
    made = keyed.groupBy(group).agg(items.alias("i"), F.max("_b").alias("b"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["n"] < most_rows) & ((F.col("b") <= 0) | (acc["used"] + x["cost"] <= F.col("b")))
        return F.struct((acc["n"] + fits.cast("int")).alias("n"), (acc["used"] + F.when(fits, x["cost"]).otherwise(0)).alias("used"), F.when(fits, F.concat(acc["took"], F.array(x["_k"]))).otherwise(acc["took"]).alias("took")).cast(state)

    took = made.select(group, F.explode(F.aggregate("i", start, step)["took"]).alias("_k"), F.lit(True).alias("taken"))
    return keyed.join(took, [group, "_k"], "left").withColumn("taken", F.coalesce("taken", F.lit(False))).drop("_b", "_k")


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page of rows in order, and whether more follow."""
    found = rows.orderBy(*order).offset(offset).limit(size + 1)
    place = F.row_number().over(Window.orderBy(*order))  # a page of rows, no more
    return found.withColumn("_p", place).withColumn("has_more", F.max("_p").over(Window.partitionBy()) > size).where(F.col("_p") <= size).drop("_p")


def first_by_group(rows: DataFrame, group: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= most)


def running_offsets(clips: DataFrame, silence_ms: int, group: str = "media_id") -> DataFrame:
    """Clips put one after the other with silence between: start_ms and end_ms in the bundle."""
    length = F.col("end_ms") - F.col("start_ms")
    before = F.coalesce(F.sum(length + silence_ms).over(Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return clips.select(group, "pos", before.alias("start_ms"), (before + length).alias("end_ms"))


def rebased(cues: DataFrame, windows: DataFrame, group: str = "media_id") -> DataFrame:
    """Cues of a window (group, window_start, window_end) whose times count from
    the window's start, moved to the whole recording's, and cut to the window. Times that already do stay."""
    rows = cues.join(windows, group)
    relative = (F.max("end_ms").over(Window.partitionBy(group)) <= F.col("window_end") - F.col("window_start")) & (F.col("window_start") > 0)
    moved = rows.withColumn("_by", F.when(relative, F.col("window_start")).otherwise(F.lit(0).cast("long")))
    cut = moved.withColumns({"start_ms": F.greatest(F.col("start_ms") + F.col("_by"), "window_start"), "end_ms": F.least(F.col("end_ms") + F.col("_by"), "window_end")})
    return cut.where("end_ms > start_ms").select(group, "pos", "start_ms", "end_ms")


#: Length of clips and of bundles in ms, the silence between clips, and what the six bundles stand for.
CLIP_MS, BUNDLE_MS, SILENCE_MS = (3000, 15_000), (45_000, 75_000), 250
CATEGORIES = ("normal", "normal", "fast", "fast", "low_volume", "low_volume")


def filled(clips: DataFrame, order: list[Column], by: list[str], bundle_ms: tuple[int, int] = BUNDLE_MS, silence_ms: int = SILENCE_MS, clip_ms: tuple[int, int] = CLIP_MS) -> DataFrame:
    """The clips (duration_ms) that fill a bundle of each group, with place and at_ms (where each ends in it): in order, until the bundle is long enough. Groups that do not
    get there give none. Clips of other lengths than ``clip_ms`` are left out; the others never go over the bundle's most before it is long enough, so that none is skipped."""
    least, most = bundle_ms
    if clip_ms[1] + silence_ms > most - least:
        raise ValueError("a clip could go over the bundle's most")
    w = Window.partitionBy(*by).orderBy(*order)
    rows = clips.where(F.col("duration_ms").between(*clip_ms)).withColumn("place", F.row_number().over(w))
    rows = rows.withColumn("at_ms", F.sum("duration_ms").over(w.rowsBetween(Window.unboundedPreceding, 0)) + (F.col("place") - 1) * silence_ms)
    taken = rows.where(F.col("at_ms") - F.col("duration_ms") - F.when(F.col("place") > 1, silence_ms).otherwise(0) < least)
    return taken.withColumn("_all", F.max("at_ms").over(Window.partitionBy(*by))).where(F.col("_all") >= least).drop("_all")


def select_bundles(clips: DataFrame, seed: str, categories: tuple[str, ...] = CATEGORIES, group: str = "source_group") -> DataFrame:
    """clips (clip_id, source_group, duration_ms, rate, rms) of a bundle for each category: bundle, category, clip_id, group, place. Normal bundles prefer clips near both medians, fast
    ones the upper quarter of rates, quiet ones the lower quarter of rms, then a hash; groups take turns, and no clip is in two bundles.

    A bundle is a small job of its own, as it depends on the one before; of each only the group's name and its few clips come to the driver."""
    spark = clips.sparkSession
    q = clips.agg(F.percentile("rate", 0.5).alias("rate"), F.percentile("rms", 0.5).alias("rms"), F.percentile("rate", 0.75).alias("fast"), F.percentile("rms", 0.25).alias("low")).first()
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("clip_id").cast("string")), 256)
    orders = {
        "fast": [(F.col("rate") < q["fast"]).cast("int"), F.desc("rate"), h], "low_volume": [(F.col("rms") > q["low"]).cast("int"), F.col("rms"), h],
        "normal": [F.abs(F.col("rate") - q["rate"]) + F.abs(F.col("rms") - q["rms"]), h],
    }
    used: list[tuple] = []
    last = None
    for k, category in enumerate(categories, 1):
        left = clips
        if used:
            names = spark.createDataFrame([(u[2],) for u in used], f"clip_id {dict(clips.dtypes)['clip_id']}")
            left = clips.join(F.broadcast(names), "clip_id", "left_anti")
        bundles = filled(left, orders[category], [group])
        turn = F.lit(1) if last is None else F.when(F.col(group) > last, 1).otherwise(2)
        first = bundles.select(group).distinct().orderBy(turn, group).limit(1).collect()
        if not first:
            raise ValueError(f"no group fills bundle {k} ({category})")
        last = first[0][0]
        used += [(k, category, r["clip_id"], last, r["place"]) for r in bundles.where(F.col(group) == last).orderBy("place").collect()]
    kinds = dict(clips.dtypes)
    return spark.createDataFrame(used, f"bundle int, category string, clip_id {kinds['clip_id']}, {group} {kinds[group]}, place int")


def prepared(clips: DataFrame, tracks: int = 2, meetings: int = 3) -> DataFrame:
    """clips (meeting, track, start_ms, duration_ms) of the first ``tracks`` tracks that fill a bundle, of the first ``meetings`` meetings that have so many."""
    bundles = filled(clips, [F.col("start_ms"), F.col("duration_ms")], ["meeting", "track"])
    able = bundles.select("meeting", "track").distinct().withColumn("_t", F.row_number().over(Window.partitionBy("meeting").orderBy("track")))
    enough = able.where(F.col("_t") == tracks).select("meeting").orderBy("meeting").limit(meetings)  # as many rows as meetings are asked for
    return bundles.join(able.where(F.col("_t") <= tracks).drop("_t"), ["meeting", "track"], "left_semi").join(F.broadcast(enough), "meeting", "left_semi")
