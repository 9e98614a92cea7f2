"""Mixing sources to target weights (operator 2), DataFrame functions only.

Sources by code point, null last, take the weights in turn and share
``share`` of all sizes; a target stops at ``most`` times its source's size and
the excess goes to the others by weight until none is above (water-filling,
in closed form: sources that fill first are those with the least size per
weight). Within a source, documents are range-sorted by a hash-random key
(md5 of the id), and a distributed prefix sum of sizes tells which documents
lie before the source's budget: the key's range is cut into BUCKETS equal
ranges, sums of ranges give each range its offset, and a window runs inside
one range of one source only, so that a source with a third of all rows is
spread over all tasks. Budgets above the source's size repeat it by epochs;
the document at the cut is taken in part.

Null and empty texts have size 0; ids and texts may be null or repeat (rows that tie in key and size are
taken in either order; all rows of one id lie in one range, so that an id, or null, that repeats by the million is one task's); a null source is a
source. Very long texts count whole, and are cut at a word where the budget ends in them. Columns of docs may have any
names and come back as they are. An empty table gives none. Sources are a short list: their targets are worked out in one task, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import restored, sheltered

WEIGHTS = (5, 2, 1)
#: Share of all sizes as a fraction, and most times a source is repeated.
SHARE = (3, 2)
MOST = 2
#: Key ranges per source.
BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key() -> Column:
    """A hash-random key of the document, the same in every run."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to source, source_size, target; a row for each source.

    Works on the table of sources, a row each; its ranks need one order over
    all of them.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), turn.cast("int") + 1)
    out = sizes.withColumn("w", w.cast("long"))
    out = out.withColumns({"all_w": F.sum("w").over(every), "all_size": F.sum("source_size").over(every)})
    before = lambda c: F.coalesce(F.sum(c).over(filling), F.lit(0).cast("long"))
    out = out.withColumns({"w_before": before("w"), "size_before": before("source_size")})
    # full: twice the size is within what the level left to it would give
    level = F.lit(share[0]) * F.col("all_size") - F.lit(share[1] * most) * F.col("size_before")
    full = F.lit(share[1] * most).cast("double") * F.col("source_size") * (F.col("all_w") - F.col("w_before")) <= F.col("w").cast("double") * level
    out = out.withColumn("full", full)
    rest_w = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(every)
    rest = F.lit(share[0]) * F.col("all_size") - F.lit(share[1] * most) * F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(every)
    out = out.withColumns({"rest_w": rest_w, "rest": rest})
    part = (F.col("w") * F.col("rest")).cast("double") / (F.lit(share[1]) * F.col("rest_w")).cast("double")
    return out.select("source", "source_size", F.when(F.col("full"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(part).alias("target"))


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """rows: doc_id, source, size and any others; adds source_size, target,
    taken (words taken, repeats counted)."""
    keyed = rows.withColumn("_key", random_key())
    keyed = keyed.withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 6), 16, 10).cast("long") * buckets / F.lit(16**6)))
    sums = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    goal = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    offset = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = sums.withColumn("_offset", offset).withColumnsRenamed({"source": "_s", "_bucket": "_b"})
    goal = goal.withColumnRenamed("source", "_g")
    offsets = offsets.join(goal, F.col("_s").eqNullSafe(F.col("_g"))).select("_s", "_b", "_offset", "source_size", "target")
    run = F.coalesce(F.sum("size").over(Window.partitionBy("source", "_bucket").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    out = keyed.withColumn("_run", run).join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("_offset") - F.col("_run")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    out = out.withColumns({"_epochs": epochs, "_extra": extra, "taken": epochs * F.col("size") + extra})
    return out.drop("_bucket", "_run", "_s", "_b", "_offset")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return plan_mix(docs.select("doc_id", "source", word_count().alias("size"))).select("doc_id", "size", "source_size", "target", "taken")


def cuts(plan: DataFrame) -> DataFrame:
    """A plan to a row for each source: its epochs and the place of its cut.

    Documents whose (key, size) lies before the cut are taken once more than
    the epochs, those equal to it share ``words`` among ``rows`` of them.
    """
    rows = plan.groupBy("source", "_key", "size").agg(F.max("_epochs").alias("e"), F.sum("_extra").alias("words"), F.count("*").alias("rows"))
    at = F.max(F.when(F.col("words") > 0, F.struct("_key", "size", "words", "rows")))
    return rows.groupBy(F.col("source").alias("_source")).agg(F.max("e").cast("int").alias("_epochs"), at.alias("_cut"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: each as many times as it is taken whole, and the
    one at a source's cut once more, with the words before the cut.

    Texts are not shuffled: the plan, made from ids and sizes alone, comes
    down to a row for each source, which the second scan looks up.
    """
    used = ("doc_id", "text", "source")
    sized = sheltered(docs, *used).withColumns({"_size": word_count(), "_key": random_key()})
    place = cuts(plan_mix(sized.select("doc_id", "source", F.col("_size").alias("size"))))
    rows = sized.join(place, sized["source"].eqNullSafe(place["_source"]))
    here, cut = F.struct(F.col("_key"), F.col("_size").alias("size")), F.struct("_cut._key", "_cut.size")
    rest = F.when(here == cut, F.floor(F.col("_cut.words") / F.col("_cut.rows"))).otherwise(0).cast("int")
    whole = F.col("_epochs") + F.when(here < cut, 1).when((here == cut) & (rest == F.col("_size")), 1).otherwise(0)
    part = (rest > 0) & (rest < F.col("_size"))
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.where("_size > 0").withColumn("_copy", F.explode(copies))
    cut_text = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest("_copy", F.lit(1))), " ")
    return restored(rows.withColumn("text", F.when(F.col("_copy") < 0, F.col("text")).otherwise(cut_text)), docs, *used)
