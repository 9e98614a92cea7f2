"""The second review strategy: recordings are surveyed for terms, translations reviewed batch by batch and across lines, mended within a budget, and terms made consistent.

Stages are tables of questions as in ``plans.stages``; each answer keeps to its schema or is asked once more."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import answers as S
from cuelake.operators import rules as R
from cuelake.operators import sequences as W
from cuelake.plans.stages import BATCH, Model, _judged, _replaced, batched, request, translated
from cuelake.sources.files import kept

_TERM = "array<struct<source:string,target:string,type:string,confidence:string,evidence_ids:array<bigint>>>"
_RANK = ("high", "medium", "low")


def _terms(answered: DataFrame, name: str, group: str) -> DataFrame:
    """group, low (the source, folded), source, target, type, confidence, evidence of sound answers."""
    rows = answered.where("error is null").select(group, F.explode(F.from_json("answer", f"{name} {_TERM}")[name]).alias("t"))
    return rows.select(group, F.lower(F.trim("t.source")).alias("low"), F.trim("t.source").alias("source"), F.trim("t.target").alias("target"), "t.type", "t.confidence", F.col("t.evidence_ids").alias("evidence"))


def surveyed(items: DataFrame, model: Model, group: str = "media_id") -> DataFrame:
    """Terms that the model finds in items (group, scene, pos, text). Scenes are asked in parallel."""
    scenes = items.groupBy(group, "scene").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("id"), "text"))).alias("items"))
    asked = scenes.select(group, "scene", F.transform("items", lambda x: x["id"]).alias("ids"), F.to_json(F.struct("items")).alias("question"))
    return kept(_terms(request(asked, model, "survey", lambda a: S.analysis(a, F.col("ids"))), "typed_glossary", group))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of nodes (node) and edges (a, b): least labels spread along edges, and labels follow their own labels."""
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = kept(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("of"))
        step = kept(step.join(up, step["component"] == up["up"], "left").select("node", "was", F.least("component", "of").alias("component")))
        labels = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return labels


def clustered(terms: DataFrame, group: str = "media_id") -> DataFrame:
    """group, cluster, low, target, type, confidence, evidence (ids, each once), canonical (the cluster's target: the surest, then that with the most evidence, then the
    first by text). Forms of one source, and forms that share evidence and a target, are one cluster."""
    sure = F.min(F.array_position(F.array(*[F.lit(x) for x in _RANK]), F.col("confidence")))
    forms = terms.groupBy(group, "low", "target").agg(sure.alias("rank"), F.min("type").alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    forms = kept(forms.withColumn("node", F.to_json(F.struct(group, "low", "target"))))
    # a form is tied to the least one of its source, and of each (evidence, target), not to all of them
    ties = [(forms.select(group, F.col("low").alias("k"), F.lit(0).cast("long").alias("e"), "node")), forms.select(group, F.col("target").alias("k"), F.explode("evidence").alias("e"), "node").withColumn("k", F.concat(F.lit("="), "k"))]
    edges = None
    for t in ties:
        least = t.groupBy(group, "k", "e").agg(F.min("node").alias("a"))
        made = t.join(least, [group, "k", "e"]).where("a <> node").select("a", F.col("node").alias("b"))
        edges = made if edges is None else edges.union(made)
    rows = forms.join(components(forms, edges), "node")
    best = rows.groupBy("component").agg(F.min(F.struct("rank", (-F.size("evidence")).alias("n"), "target"))["target"].alias("canonical"))
    confidence = F.element_at(F.array(*[F.lit(x) for x in _RANK]), F.col("rank").cast("int"))
    return rows.join(best, "component").select(group, F.col("component").alias("cluster"), "low", "target", "type", confidence.alias("confidence"), "evidence", "canonical")


def within_budget(windows: DataFrame, most: int, group: str = "media_id") -> DataFrame:
    """windows (group, first_pos, last_pos, priority) with taken: those of the least priority number, then the first, while the cues of a recording's windows so far are ``most`` at most."""
    order = Window.partitionBy(group).orderBy("priority", "first_pos")
    return windows.withColumn("taken", F.sum(F.col("last_pos") - F.col("first_pos") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) <= most)


_ISSUES = "array<struct<id:bigint,type:string,confidence:string,detail:string>>"


def _found(answered: DataFrame, origin: str, group: str) -> DataFrame:
    rows = answered.where("error is null").select(group, F.explode(F.from_json("answer", f"issues {_ISSUES}")["issues"]).alias("x"))
    return rows.select(group, F.col("x.id").alias("pos"), F.col("x.type").alias("type"), F.col("x.confidence").alias("confidence"), F.lit(origin).alias("origin"))


def second(cues: DataFrame, model: Model, most_characters: int, most_cues: int, scripts: dict[str, str], gap_ms: int = 30_000, group: str = "media_id") -> tuple[DataFrame, DataFrame]:
    """(texts, review). texts: group, pos, translation, origin (source, initial, repair or shortening), over_budget. review: group, pos, category (issue, cross_line,
    unresolved_budget or variant), reason: what a person should look at.

    Terms go with each cue whose text holds them. Batches are reviewed, and so are sentences that run over two cues; of the latter only what
    the reviewer is sure of counts. Windows about what was found are mended while a recording's budget of cues lasts, sure findings first; a judge must confirm each mend and each
    shortening in full. Last, the forms of each cluster of terms are compared over the whole recording."""
    items = kept(W.scenes(cues, gap_ms, group).select(group, "scene", "pos", "start_ms", "end_ms", "text"))
    terms = kept(clustered(surveyed(items, model, group), group))
    known = terms.select(group, "low", "canonical").distinct()
    held = items.select(group, "pos", F.lower("text").alias("said")).join(known, group).where(F.contains("said", "low"))
    glossary = held.groupBy(group, "pos").agg(F.array_sort(F.collect_set(F.struct(F.col("low").alias("source"), F.col("canonical").alias("target")))).alias("terms"))
    items = items.join(glossary, [group, "pos"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<source:string,target:string>>")))
    first = translated(items, model, "initial", group=group, terms=F.col("terms"))
    rows = kept(items.join(first.drop("error"), [group, "pos"]).withColumn("origin", F.when(F.col("translation").isNull(), "source").otherwise("initial")))

    done = rows.where("translation is not null")
    asked = request(batched(done, BATCH, group, now=F.col("translation")), model, "review", lambda a: S.review(a, F.col("ids")))
    across = R.cross_line_windows(rows.select(group, "pos", "start_ms", "end_ms", "text"), group)
    numbered = rows.select(group, "pos", F.row_number().over(Window.partitionBy(group).orderBy("pos")).alias("k"))
    lines = across.select(group, F.explode(F.array("first_pos", "last_pos")).alias("k")).distinct().join(numbered, [group, "k"]).select(group, "pos")
    crossed = request(batched(done.join(lines, [group, "pos"], "left_semi"), BATCH, group, now=F.col("translation")), model, "cross_line", lambda a: S.review(a, F.col("ids")))
    issues = kept(_found(asked, "issue", group).unionByName(_found(crossed, "cross_line", group).where("confidence = 'high'")))

    flagged = issues.groupBy(group, "pos").agg(F.min(F.when(F.col("confidence") == "high", 0).otherwise(1)).alias("priority"))
    windows = W.repair_windows(flagged.select(group, "pos"), rows.groupBy(group).agg(F.max("pos").alias("n")), 1, group)
    ranked = windows.join(flagged, group).where(F.col("pos").between(F.col("first_pos"), F.col("last_pos"))).groupBy(group, "first_pos", "last_pos").agg(F.min("priority").alias("priority"))
    taken = within_budget(ranked, most_cues, group).where("taken").select(group, F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    inside = done.drop("origin").join(taken, [group, "pos"])
    mended = translated(inside, model, "repair", group=group, now=F.col("translation")).select(group, "pos", F.col("translation").alias("candidate"))
    pairs = inside.join(mended, [group, "pos"]).where(F.col("candidate").isNotNull() & (F.col("candidate") != F.col("translation"))).withColumn("now", F.col("translation"))
    pairs = pairs.where(F.size(R.blocking(F.col("text"), F.col("candidate"), scripts)) == 0).select(group, "scene", "pos", "text", "now", "candidate")
    rows = _replaced(rows, _judged(pairs, model, "repair_judge", True, group), "repair", group)

    most = F.lit(most_characters)
    long = rows.where(F.length("translation") > most)
    short = translated(long, model, "shortening", group=group, now=F.col("translation"), most=most).select(group, "pos", F.col("translation").alias("candidate"))
    pairs = long.join(short, [group, "pos"]).where(F.length("candidate") <= most).select(group, "scene", "pos", "text", F.col("translation").alias("now"), "candidate")
    rows = _replaced(rows, _judged(pairs, model, "shortening_judge", True, group), "shortening", group)

    varied = terms.groupBy(group, "cluster").agg(F.min("type").alias("type"), F.array_sort(F.collect_set(F.struct("target", F.col("evidence").alias("ids")))).alias("variants")).where(F.size("variants") > 1)
    question = varied.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("type", "variants"))).alias("groups"))
    ids = F.array_distinct(F.flatten(F.transform("groups", lambda g: F.flatten(F.transform(g["variants"], lambda v: v["ids"])))))
    compared = request(question.select(group, ids.alias("ids"), F.to_json(F.struct("groups")).alias("question")), model, "variants", lambda a: S.variants(a, F.col("ids")))
    kind = "groups array<struct<classification:string,variants:array<struct<ids:array<bigint>>>>>"
    wrong = compared.where("error is null").select(group, F.explode(F.from_json("answer", kind)["groups"]).alias("g")).where("g.classification = 'definite_error'")
    wrong = wrong.select(group, F.explode("g.variants").alias("v")).select(group, F.explode("v.ids").alias("pos")).distinct()

    text = F.coalesce("translation", "text")
    texts = rows.select(group, "pos", text.alias("translation"), "origin", (F.length(text) > most).alias("over_budget"))
    open_ = issues.join(rows.where("origin not in ('repair', 'shortening')").select(group, "pos"), [group, "pos"], "left_semi")
    look = open_.select(group, "pos", F.col("origin").alias("category"), F.col("type").alias("reason")).distinct()
    look = look.unionByName(texts.where("over_budget").select(group, "pos", F.lit("unresolved_budget").alias("category"), F.lit("shortening_not_proven").alias("reason")))
    return texts, look.unionByName(wrong.select(group, "pos", F.lit("variant").alias("category"), F.lit("definite_error").alias("reason")))
