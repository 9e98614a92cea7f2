"""Burned-in captions of two languages, cleaned: what was read and what is heard go to a model, a batch at a time; what it cannot do stays as it was read.

captions: group, pos, start_ms, end_ms, text (first line the source's language, second line the target's). heard: group, pos, start_ms, end_ms, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import answers as S
from cuelake.functions import text as T
from cuelake.operators import intervals as J
from cuelake.operators import rules as R
from cuelake.plans.stages import Model, request
from cuelake.sources.files import kept


def evidence(captions: DataFrame, heard: DataFrame, least_ms: int = 50, group: str = "media_id") -> DataFrame:
    """captions with source and target (their lines) and said: the different texts heard during each, in order."""
    line = lambda k: F.trim(F.coalesce(F.get(F.split("text", "\r\n|\r|\n"), k), F.lit("")))
    said = J.joined_texts(captions, heard, least_ms, group).withColumnRenamed("heard", "said")
    rows = captions.select(group, "pos", "start_ms", "end_ms", line(0).alias("source"), line(1).alias("target"))
    return rows.join(said, [group, "pos"], "left").withColumn("said", F.trim(F.coalesce("said", F.lit(""))))


def two_lines(text: Column) -> tuple[Column, Column, Column]:
    """source and target of a text, and whether it is two lines that both say something."""
    lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.get(lines, 0), F.get(lines, 1), F.coalesce(F.size(lines) == 2, F.lit(False))


def questions(rows: DataFrame, done: DataFrame, size: int, around: int = 2, group: str = "media_id") -> DataFrame:
    """A question for each batch of rows that are not done: group, batch, ids, question (items, and up to ``around`` rows before and after them, done or not)."""
    order = Window.partitionBy(group).orderBy("pos")
    cue = F.struct(F.col("pos").alias("id"), F.col("source").alias("ocr_source"), F.col("target").alias("ocr_target"), F.col("said").alias("heard"))
    numbered = rows.select(group, "pos", cue.alias("cue"), F.row_number().over(order).alias("k"))
    # neighbours stand beside each row before anything is left out
    numbered = numbered.withColumns({"behind": F.collect_list("cue").over(order.rowsBetween(-around, -1)), "ahead": F.collect_list("cue").over(order.rowsBetween(1, around))})
    open_ = numbered.join(done.select(group, "pos"), [group, "pos"], "left_anti")
    open_ = open_.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size))
    listed = F.array_sort(F.collect_list(F.struct("k", "cue", "behind", "ahead")))
    made = open_.groupBy(group, "batch").agg(listed.alias("l"))
    question = F.to_json(F.struct(F.transform("l", lambda x: x["cue"]).alias("items"), F.get("l", 0)["behind"].alias("context_before"), F.element_at("l", -1)["ahead"].alias("context_after")))
    return made.select(group, "batch", F.transform("l", lambda x: x["cue"]["id"]).alias("ids"), question.alias("question"))


def _whole(ids: Column) -> Column:
    """A check of answers: a text of two lines for each of the ids, and no other."""

    def check(answer: Column) -> Column:
        v = F.try_parse_json(answer)
        found = F.transform(S.rows(v, "items"), lambda x: S.number(S.field(x, "id")))
        wrong = found.isNull() | (F.size(F.array_distinct(found)) != F.size(found)) | (F.size(F.array_except(found, ids)) > 0) | (F.size(F.array_except(ids, found)) > 0)
        lines = F.exists(S.rows(v, "items"), lambda x: ~two_lines(S.said(x, "translation"))[2])
        return F.struct(F.when(v.isNull(), "not_json").when(wrong, "ids").when(lines, "lines").alias("error"))

    return check


def cleaned(captions: DataFrame, heard: DataFrame, model: Model, done: DataFrame | None = None, size: int = 12, group: str = "media_id") -> DataFrame:
    """group, pos, start_ms, end_ms, source, target, origin (saved, model, ocr or incomplete) of all captions.

    done: group, pos, text of an earlier run, which are not asked again. Batches that the model does not answer soundly fall back to what was
    read (for a missing source line, what is heard); a caption without both lines even then is incomplete, with an empty line."""
    rows = kept(evidence(captions, heard, group=group))
    none = rows.select(group, "pos").where(F.lit(False)).withColumn("text", F.lit(""))
    done = none if done is None else done.select(group, "pos", "text")
    made = request(questions(rows, done, size, group=group), model, "clean", _whole(F.col("ids")), attempts=1)
    answers = made.where("error is null").select(group, F.explode(F.from_json("answer", "items array<struct<id:bigint,translation:string>>")["items"]).alias("x"))
    texts = done.withColumn("origin", F.lit("saved")).unionByName(answers.select(group, F.col("x.id").alias("pos"), F.col("x.translation").alias("text"), F.lit("model").alias("origin")))
    rows = rows.join(texts.withColumnRenamed("text", "_text"), [group, "pos"], "left")
    source, target, _ = two_lines(F.col("_text"))
    read = F.when(F.col("source") != "", F.col("source")).otherwise(F.col("said"))
    rows = rows.withColumns({"_s": F.coalesce(source, read), "_t": F.coalesce(target, "target")})
    origin = F.coalesce("origin", F.when((F.col("_s") != "") & (F.col("_t") != ""), "ocr").otherwise("incomplete"))
    return rows.select(group, "pos", "start_ms", "end_ms", F.col("_s").alias("source"), F.col("_t").alias("target"), origin.alias("origin"))


def merged(rows: DataFrame, group: str = "media_id") -> DataFrame:
    """group, pos (new, from 1), start_ms, end_ms, source, target, n: neighbours that say the same become one, from the first one's start to the last one's end."""
    order = Window.partitionBy(group).orderBy("pos")
    plain = F.concat(T.word_characters(F.col("source")), T.word_characters(F.col("target")))
    marked = rows.withColumn("_p", plain).withColumn("_new", (~F.col("_p").eqNullSafe(F.lag("_p").over(order))).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.min_by(F.struct("start_ms", "source", "target"), "pos"), F.max_by("end_ms", "pos")
    out = runs.groupBy(group, F.col("_run").alias("pos")).agg(first.alias("f"), last.alias("end_ms"), F.count("*").alias("n"))
    return out.select(group, "pos", "f.start_ms", "end_ms", "f.source", "f.target", "n")


def summary(rows: DataFrame, scripts: dict[str, str], group: str = "media_id") -> DataFrame:
    """group, source_cues, cues (after merging), n_merged, n_model, n_ocr, n_incomplete, n_blocking (codes), n_repeated (targets equal to the one before, before merging) of cleaned rows."""
    order = Window.partitionBy(group).orderBy("pos")
    plain = T.word_characters(F.col("target"))
    marked = rows.withColumns({"_t": plain, "_was": F.lag(plain).over(order), "_codes": F.size(R.blocking(F.col("source"), F.col("target"), scripts))})
    counts = marked.groupBy(group).agg(
        F.count("*").alias("source_cues"), F.count_if(F.col("origin").isin("saved", "model")).alias("n_model"), F.count_if(F.col("origin") == "ocr").alias("n_ocr"), F.count_if(F.col("origin") == "incomplete").alias("n_incomplete"),
        F.sum("_codes").alias("n_blocking"), F.count_if((F.col("_was") != "") & (F.col("_t") == F.col("_was"))).alias("n_repeated"),
    )
    after = merged(rows, group).groupBy(group).agg(F.count("*").alias("cues"))
    return counts.join(after, group).withColumn("n_merged", F.col("source_cues") - F.col("cues"))
