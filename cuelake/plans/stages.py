"""Translation in stages by a model: scenes are analysed, cues translated, reviewed, mended, judged and shortened.

A stage is a table of questions (a batch of cues each), asked in parallel; answers are checked by the schemas of
``functions.answers``, and those that do not keep to theirs are asked once more. What a stage gives is written before the next reads it, so that
no question is asked twice. A model is a function that makes, once for each task, a function of a stage's name and a question (a dict) that gives the
answer's text, or raises ValueError. Batches are of one recording and scene, so that questions stay short whatever the recording."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cuelake.functions import answers as S
from cuelake.functions import similarity as M
from cuelake.operators import rules as R
from cuelake.operators import sequences as W
from cuelake.sources.files import batches_of, kept

Model = Callable[[], Callable[[str, dict], str]]
BATCH, ATTEMPTS = 10, 2
#: Questions that Python is handed at a time at most.
QUESTIONS = 64


def ask(questions: DataFrame, model: Model, stage: str, strict: bool = False) -> DataFrame:
    """questions (with ``question``, JSON) and answer (null where the call failed). A strict question says so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        say = model()

        def one(question: str) -> str | None:
            try:
                return say(stage, json.loads(question) | ({"strict": True} if strict else {}))
            except ValueError:
                return None

        for pdf in batches:
            yield pdf.assign(answer=[one(q) for q in pdf["question"]])

    return questions.mapInPandas(run, StructType([*questions.schema.fields, StructField("answer", StringType())]))


def request(questions: DataFrame, model: Model, stage: str, check: Callable[[Column], Column], attempts: int = ATTEMPTS) -> DataFrame:
    """questions with answer, error (null if the answer holds) and attempt: those without a sound answer are asked again, strictly."""
    done, todo = None, questions
    for k in range(1, attempts + 1):
        with batches_of(questions.sparkSession, QUESTIONS):
            made = kept(ask(todo, model, stage, k > 1).withColumn("error", F.when(F.col("answer").isNull(), "failed").otherwise(check(F.col("answer"))["error"])).withColumn("attempt", F.lit(k)))
        good = made if k == attempts else made.where("error is null")
        done = good if done is None else done.unionByName(good)
        todo = made.where("error is not null").select(*questions.columns)
        if k < attempts and todo.isEmpty():
            break
    return done


def batched(items: DataFrame, size: int = BATCH, group: str = "media_id", **more: Column) -> DataFrame:
    """items (group, scene, pos, text, and others) to a question for each batch: group, scene, batch, ids and question (ids, texts and ``more``, values by cue)."""
    k = F.floor((F.row_number().over(Window.partitionBy(group, "scene").orderBy("pos")) - 1) / size)
    rows = items.withColumn("batch", k)
    cue = F.struct(F.col("pos").alias("id"), F.col("text").alias("text"), *[c.alias(n) for n, c in more.items()])
    listed = F.array_sort(F.collect_list(cue))
    out = rows.groupBy(group, "scene", "batch").agg(listed.alias("items"))
    return out.select(group, "scene", "batch", F.transform("items", lambda x: x["id"]).alias("ids"), F.to_json(F.struct("items"), {"ignoreNullFields": "false"}).alias("question"))


def _items(answered: DataFrame, value: str, group: str = "media_id") -> DataFrame:
    """group, pos, ``value`` of answers of the form {"items": [{"id", "translation"}]}."""
    rows = answered.where("error is null").select(group, F.explode(F.from_json("answer", "items array<struct<id:bigint,translation:string>>")["items"]).alias("x"))
    return rows.select(group, F.col("x.id").alias("pos"), F.trim("x.translation").alias(value))


def exact_items(ids: Column) -> Callable[[Column], Column]:
    """Answers must have a text for each of the ids and no other."""

    def check(answer: Column) -> Column:
        v = F.try_parse_json(answer)
        found = F.transform(S.rows(v, "items"), lambda x: S.number(S.field(x, "id")))
        texts = F.transform(S.rows(v, "items"), lambda x: S.said(x, "translation"))
        wrong = found.isNull() | (F.size(F.array_distinct(found)) != F.size(found)) | (F.size(F.array_except(found, ids)) > 0) | (F.size(F.array_except(ids, found)) > 0)
        return F.struct(F.when(v.isNull(), "not_json").when(wrong, "ids").when(F.exists(texts, lambda t: t == ""), "empty").alias("error"))

    return check


def translated(items: DataFrame, model: Model, stage: str = "initial", size: int = BATCH, group: str = "media_id", **more: Column) -> DataFrame:
    """group, pos, translation, error: a batch whose answers do not hold, strictly asked too, is asked in halves, down to single cues; one that fails alone has its error."""
    out, todo = None, items
    while True:
        made = request(batched(todo, size, group, **more), model, stage, exact_items(F.col("ids")))
        good = _items(made, "translation", group).withColumn("error", F.lit(None).cast("string"))
        if size == 1:
            bad = made.where("error is not null").select(group, F.explode("ids").alias("pos"), F.lit(None).cast("string").alias("translation"), "error")
            good = good.unionByName(bad)
        out = good if out is None else out.unionByName(good)
        failed = made.where("error is not null").select(group, F.explode("ids").alias("pos"))
        if size == 1 or failed.isEmpty():
            return kept(out)
        todo, size = items.join(failed, [group, "pos"], "left_semi"), -(-size // 2)


def analysed(items: DataFrame, model: Model, group: str = "media_id") -> DataFrame:
    """items with before: the summary of the scene before (null for the first, or without a sound analysis). Scenes are asked in parallel."""
    scenes = items.groupBy(group, "scene").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("id"), "text"))).alias("items"))
    asked = scenes.select(group, "scene", F.transform("items", lambda x: x["id"]).alias("ids"), F.to_json(F.struct("items")).alias("question"))
    made = request(asked, model, "analysis", lambda a: S.summarized(a, F.col("ids"), "scene_summary", 1600))
    said = made.select(group, "scene", F.when(F.col("error").isNull(), F.left(F.trim(F.get_json_object("answer", "$.scene_summary")), F.lit(1600))).alias("_s"))
    before = said.withColumn("before", F.lag("_s").over(Window.partitionBy(group).orderBy("scene"))).select(group, "scene", "before")
    return items.join(before, [group, "scene"])


def _judged(pairs: DataFrame, model: Model, stage: str, strict: bool, group: str = "media_id") -> DataFrame:
    """pairs (group, scene, pos, text, now, candidate) with accepted: the judge, who does not know which is which, is sure of the candidate (strict: and confirms each equivalence)."""
    side = M.hash_side(F.lit(stage), F.col(group).cast("string"), F.col("pos").cast("string")) == 1
    a, b = F.when(side, F.col("candidate")).otherwise(F.col("now")), F.when(side, F.col("now")).otherwise(F.col("candidate"))
    asked = pairs.withColumns({"mapped": F.when(side, "A").otherwise("B"), "question": F.to_json(F.struct(F.col("pos").alias("id"), F.col("text").alias("source"), a.alias("A"), b.alias("B")))})
    made = request(asked, model, stage, lambda x: S.judgment(x, F.col("pos"), equivalence=strict, strict=strict))
    sure = (F.get_json_object("answer", "$.confidence") == "high") & (F.get_json_object("answer", "$.choice") == F.col("mapped"))
    for name in (*S.EQUIVALENCE, *S.PROOF) if strict else ():
        sure = sure & (F.get_json_object("answer", f"$.{name}") == "true")
    return made.select(group, "pos", "candidate", F.coalesce(F.col("error").isNull() & sure, F.lit(False)).alias("accepted"))


def _replaced(now: DataFrame, judged: DataFrame, origin: str, group: str = "media_id") -> DataFrame:
    rows = now.join(judged.where("accepted").select(group, "pos", F.col("candidate").alias("_c")), [group, "pos"], "left")
    return kept(rows.withColumns({"translation": F.coalesce("_c", "translation"), "origin": F.when(F.col("_c").isNotNull(), origin).otherwise(F.col("origin"))}).drop("_c"))


def three_pass(cues: DataFrame, model: Model, most: Column, gap_ms: int = 30_000, group: str = "media_id") -> DataFrame:
    """group, pos, translation, origin (source, initial, final or short): a first translation with the summary of the scene before, a
    reflection on it, a final one with the reflection, and a shorter one where it has more than ``most`` characters and the answer does not."""
    items = analysed(W.scenes(cues, gap_ms, group), model, group).select(group, "scene", "pos", "text", "before", most.alias("most"))
    first = translated(items, model, "initial", group=group, before=F.col("before"))
    rows = kept(items.join(first.drop("error"), [group, "pos"]).withColumn("origin", F.when(F.col("translation").isNull(), "source").otherwise("initial")))
    able = rows.where("translation is not null")
    thoughts = translated(able, model, "reflection", group=group, now=F.col("translation")).select(group, "pos", F.col("translation").alias("thought"))
    last = translated(able.join(thoughts, [group, "pos"]).where("thought is not null"), model, "final", group=group, now=F.col("translation"), thought=F.col("thought"))
    rows = _replaced(rows, last.select(group, "pos", F.col("translation").alias("candidate"), F.col("translation").isNotNull().alias("accepted")), "final", group)
    long = rows.where(F.length("translation") > F.col("most"))
    short = translated(long, model, "compression", group=group, now=F.col("translation"), most=F.col("most")).select(group, "pos", F.col("translation").alias("candidate"))
    fits = short.join(long.select(group, "pos", "most"), [group, "pos"]).select(group, "pos", "candidate", (F.length("candidate") <= F.col("most")).alias("accepted"))
    return _replaced(rows, fits, "short", group).select(group, "pos", F.coalesce("translation", "text").alias("translation"), "origin")


def reviewed(cues: DataFrame, model: Model, most: Column, scripts: dict[str, str], gap_ms: int = 30_000, around: int = 1, group: str = "media_id") -> tuple[DataFrame, DataFrame]:
    """(texts, issues). texts: group, pos, translation, origin (source, initial, repair or shortening), blocking (codes left), over_budget. issues: group, pos, type, detail of consistency.

    Translations are reviewed; windows of cues that the review or the rules find fault with are mended by candidates, which the rules must not block and a judge must prefer;
    texts over ``most`` characters are shortened, which a judge must find equivalent in all; last, whole recordings are looked over, a scene at a time."""
    items = analysed(W.scenes(cues, gap_ms, group), model, group).select(group, "scene", "pos", "text", "before", most.alias("most"))
    first = translated(items, model, "initial", group=group, before=F.col("before"))
    rows = kept(items.join(first.drop("error"), [group, "pos"]).withColumn("origin", F.when(F.col("translation").isNull(), "source").otherwise("initial")))

    asked = batched(rows.where("translation is not null"), group=group, now=F.col("translation"))
    found = request(asked, model, "review", lambda a: S.semantic_review(a, F.col("ids")))
    kind = "items array<struct<id:bigint,issues:array<struct<type:string,severity:string>>>>"
    faults = found.where("error is null").select(group, F.explode(F.from_json("answer", kind)["items"]).alias("x")).where(F.size("x.issues") > 0).select(group, F.col("x.id").alias("pos"))
    codes = lambda target: R.blocking(F.col("text"), F.coalesce(target, F.lit("")), scripts)
    blocked = rows.where(F.size(codes(F.col("translation"))) > 0).select(group, "pos")
    windows = W.repair_windows(faults.unionByName(blocked).distinct(), rows.groupBy(group).agg(F.max("pos").alias("n")), around, group)
    inside = windows.select(group, F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    in_window = rows.join(inside, [group, "pos"])
    mended = translated(in_window, model, "repair", group=group, now=F.col("translation")).select(group, "pos", F.col("translation").alias("candidate"))
    pairs = in_window.join(mended, [group, "pos"]).where("candidate is not null").withColumn("now", F.coalesce("translation", F.lit("")))
    pairs = pairs.where((F.col("candidate") != F.col("now")) & (F.size(codes(F.col("candidate"))) == 0)).select(group, "scene", "pos", "text", "now", "candidate")
    rows = _replaced(rows, _judged(pairs, model, "repair_judge", False, group), "repair", group)

    long = rows.where(F.length("translation") > F.col("most"))
    short = translated(long, model, "shortening", group=group, now=F.col("translation"), most=F.col("most")).select(group, "pos", F.col("translation").alias("candidate"))
    pairs = long.join(short, [group, "pos"]).where(F.length("candidate") <= F.col("most")).select(group, "scene", "pos", "text", F.col("translation").alias("now"), "candidate")
    rows = _replaced(rows, _judged(pairs, model, "shortening_judge", True, group), "shortening", group)

    looked = request(batched(rows.where("translation is not null"), 50, group, now=F.col("translation")), model, "consistency", lambda a: S.consistency(a, F.col("ids")))
    issue = "issues array<struct<id:bigint,type:string,detail:string>>"
    issues = looked.where("error is null").select(group, F.explode(F.from_json("answer", issue)["issues"]).alias("x")).select(group, F.col("x.id").alias("pos"), F.col("x.type").alias("type"), F.col("x.detail").alias("detail"))
    text = F.coalesce("translation", "text")
    return rows.select(group, "pos", text.alias("translation"), "origin", F.array_join(codes(F.col("translation")), ",").alias("blocking"), (F.length(text) > F.col("most")).alias("over_budget")), issues
