"""Gates: whether a round, a proof, a task's outputs or a whole evaluation passes.

Each takes tables of any size and gives a row for each sample, or one for all. What is null or missing never passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.answers import EQUIVALENCE, PROOF


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def round_passed(windows: Column) -> Column:
    """Of a round's summary: complete, nothing moved, no blocking issue or new overlap, and each of the ``windows`` expected was tried and mended."""
    c = F.col
    holds = [
        c("complete"), c("cue_count_unchanged"), c("timeline_unchanged"), c("blocking_issue_count") == 0, c("adjacent_overlap_delta") <= 0, c("attempted") == windows, c("accepted") == windows, c("rejected") == 0,
        F.coalesce("judge_requests", F.lit(0)) >= windows, ~c("quality_model_unavailable"), c("unresolved_count") == 0, ~c("budget_exhausted"),
    ]
    out = F.lit(True)
    for h in holds:
        out = out & _true(h)
    return out


#: What a judgment must confirm for a text to be taken, by where the text comes from; texts of other origins need none.
ALL_FLAGS = {"repair": (*EQUIVALENCE, *PROOF), "shortening": (*EQUIVALENCE, *PROOF)}
PILOT_FLAGS = {"repair": (), "shortening": EQUIVALENCE}


def proofs(finals: DataFrame, judgments: DataFrame, needs: dict[str, tuple[str, ...]] = ALL_FLAGS, group: str = "media_id") -> DataFrame:
    """group, proved: all final texts (pos, origin) that need one have a judgment (pos, origin, confidence, choice, mapped, flags map) of high
    confidence for the side that the candidate was, with each flag true."""
    rows = finals.join(judgments, [group, "pos", "origin"], "left")
    ok = F.lit(True)
    for origin, flags in needs.items():
        sure = _true(F.col("confidence") == "high") & _true(F.col("choice") == F.col("mapped"))
        for flag in flags:
            sure = sure & _true(F.try_element_at("flags", F.lit(flag)))
        ok = ok & ((F.col("origin") != origin) | sure)
    return rows.groupBy(group).agg(F.bool_and(ok).alias("proved"))


def outputs_valid(tasks: DataFrame, outputs: DataFrame) -> DataFrame:
    """tasks (task_id, status, required: names) with valid: completed, and each required output (task_id, name, size) is there and not empty."""
    found = outputs.where("size > 0").select("task_id", F.col("name").alias("need")).distinct().withColumn("there", F.lit(1))
    needed = tasks.select("task_id", F.explode_outer("required").alias("need"))
    have = needed.join(found, ["task_id", "need"], "left").groupBy("task_id").agg(F.bool_and(F.col("need").isNull() | F.col("there").isNotNull()).alias("have"))
    return tasks.join(have, "task_id").select("task_id", "status", (_true(F.col("status") == "completed") & F.col("have")).alias("valid"))


def structure(source: DataFrame, rendered: DataFrame, group: str = "media_id") -> DataFrame:
    """group, cue_count, ids_equal, times_equal (both in order), n_empty (source ids without a text) of each source."""
    ranked = lambda df, p: df.select(group, F.row_number().over(Window.partitionBy(group).orderBy("pos")).alias("k"), F.col("pos").alias(f"{p}_pos"), F.struct("start_ms", "end_ms").alias(f"{p}_time"))
    both = ranked(source, "s").join(ranked(rendered, "r"), [group, "k"], "full")
    same = both.groupBy(group).agg(F.count("s_pos").alias("cue_count"), F.bool_and(F.col("s_pos").eqNullSafe(F.col("r_pos"))).alias("ids_equal"), F.bool_and(F.col("s_time").eqNullSafe(F.col("r_time"))).alias("times_equal"))
    said = rendered.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(group, "pos").distinct()
    empty = source.join(said, [group, "pos"], "left_anti").groupBy(group).agg(F.count("*").alias("n_empty"))
    return same.join(source.select(group).distinct(), group, "left_semi").join(empty, group, "left").fillna(0, ["n_empty"])


def known_checks(texts: DataFrame, checks: DataFrame, group: str = "media_id") -> DataFrame:
    """checks (group, pos, name, required, forbidden) with passed: the text holds one of the required tokens, if there are any, and no forbidden one."""
    rows = checks.join(texts.select(group, "pos", "text"), [group, "pos"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    has = lambda c: F.exists(c, lambda x: F.contains(F.col("text"), x))
    return rows.select(group, "pos", "name", ((F.size("required") == 0) | has("required")).alias("_r"), has("forbidden").alias("_f")).select(group, "pos", "name", (F.col("_r") & ~F.col("_f")).alias("passed"))


def stage_errors(errors: DataFrame, group: str = "media_id") -> DataFrame:
    """group, n_errors, n_safe of errors (stage, error): shortenings turned down since they were not confirmed are safe."""
    safe = F.startswith("stage", F.lit("shortening:")) & F.contains("error", F.lit("equivalence was not fully confirmed"))
    return errors.groupBy(group).agg(F.count_if(~_true(safe)).alias("n_errors"), F.count_if(_true(safe)).alias("n_safe"))


def evaluated(samples: DataFrame, checks: DataFrame, requests_used: int | None = None, request_limit: int | None = None, most_budget: int | None = None, safe_errors: bool = False) -> DataFrame:
    """One row: totals of samples (cue_count, completed, ids_equal, times_equal, n_empty, proved, n_budget, n_errors, n_safe) and of checks (passed), and status.

    With ``most_budget`` so many texts over their budget at most, with a limit as many requests at most; with ``safe_errors`` errors that are safe do not count, and
    checks must exist."""
    errors = F.col("n_errors") if safe_errors else F.col("n_errors") + F.col("n_safe")
    whole = samples.agg(
        F.sum("cue_count").alias("cue_count"), F.bool_and(_true(F.col("completed") & F.col("ids_equal") & F.col("times_equal") & (F.col("n_empty") == 0))).alias("structurally_valid"), F.bool_and(_true(F.col("proved"))).alias("proof_gate_passed"),
        F.sum(errors).alias("stage_error_count"), F.sum("n_budget").alias("budget_violation_count"),
    )
    known = checks.agg(F.coalesce(F.bool_and("passed"), F.lit(not safe_errors)).alias("known_regressions_passed"))
    passed = F.col("structurally_valid") & F.col("proof_gate_passed") & (F.col("stage_error_count") == 0) & F.col("known_regressions_passed")
    if most_budget is not None:
        passed = passed & (F.col("budget_violation_count") <= most_budget)
    if request_limit is not None:
        passed = passed & F.lit(requests_used is not None and requests_used <= request_limit)
    return whole.crossJoin(known).withColumn("status", F.when(_true(passed), "passed").otherwise("failed"))  # two tables of one row


def strategies(source: DataFrame, tracks: dict[str, DataFrame], per_second: float, group: str = "media_id") -> DataFrame:
    """A row for each source: its structure against the first track, how many cues of each track are read faster than ``per_second`` characters, and whether the
    first has no more of them than each other."""
    first, *others = tracks
    out = structure(source, tracks[first], group)
    span = source.select(group, "pos", (F.col("end_ms") - F.col("start_ms")).alias("_ms"))
    for name, rows in tracks.items():
        fast = F.length(F.regexp_replace("text", r"\s+", "")) * 1000 > per_second * F.col("_ms")
        out = out.join(span.join(rows.select(group, "pos", "text"), [group, "pos"]).groupBy(group).agg(F.count_if((F.col("_ms") > 0) & fast).alias(f"fast_{name}")), group, "left").fillna(0, [f"fast_{name}"])
    return out.withColumns({f"not_worse_than_{name}": F.col(f"fast_{first}") <= F.col(f"fast_{name}") for name in others})


#: What a model writes around a translation.
WRAPPED = r"(?i)```|^\s*(?:json|markdown)\s*[:：]|作为(?:ai|人工智能)"


def benchmark(frozen: DataFrame, source: DataFrame, reference: DataFrame, candidates: DataFrame, group: str = "media_id") -> DataFrame:
    """A row for each source and label of candidates (label, pos, start_ms, end_ms, text): whether the source still has its frozen digest (group, sha256), counts of what is not
    as in the reference, passed, and the mean n-gram likeness to it over ids that both have."""
    from cuelake.functions.similarity import ngram_f1

    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    kept = source.groupBy(group).agg(F.sha2(F.array_join(texts, "\n"), 256).alias("now")).join(frozen, group, "left")
    kept = kept.select(group, (F.col("sha256").isNull() | (F.col("sha256") == F.col("now"))).alias("source_unchanged"))
    want = reference.select(group, "pos", F.struct("start_ms", "end_ms").alias("want_time"), F.col("text").alias("want"), F.lit(1).alias("w")).join(candidates.select(group, "label").distinct(), group)
    have = candidates.select(group, "label", "pos", F.struct("start_ms", "end_ms").alias("time"), "text", F.lit(1).alias("h"))
    both = want.join(have, [group, "label", "pos"], "full")
    there, wanted = F.col("h").isNotNull(), F.col("w").isNotNull()
    out = both.groupBy(group, "label").agg(
        F.count_if(wanted & ~there).alias("n_missing"), F.count_if(there & ~wanted).alias("n_extra"), F.count_if(wanted & ~F.col("time").eqNullSafe(F.col("want_time"))).alias("n_moved"),
        F.count_if(there & (F.trim(F.coalesce("text", F.lit(""))) == "")).alias("n_empty"), F.count_if(F.col("text").rlike(WRAPPED)).alias("n_wrapped"),
        F.coalesce(F.round(F.avg(F.when(there & wanted, ngram_f1(F.col("text"), F.col("want")))), 6), F.lit(0.0)).alias("bigram_f1"),
    )
    passed = sum((F.col(c) for c in ("n_missing", "n_extra", "n_moved", "n_empty", "n_wrapped")), F.lit(0)) == 0
    return out.withColumn("passed", passed).join(kept, group)
