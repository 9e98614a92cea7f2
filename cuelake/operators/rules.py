"""Quality rules: each gives issue rows (group, pos, type, severity, detail).

Rules are data: a table of named checks, each a filter over cues with their
neighbours' values, so that any set of rules is one pass over one window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T

ERROR, WARNING, INFO = "error", "warning", "info"

#: What a model writes around a translation, anywhere in a text, case ignored.
BOILERPLATE_PATTERNS = (
    r"(?:好的|当然)[，,\s]*(?:以下|下面)(?:是|为)?.*(?:翻译|字幕)",
    r"(?:以下|下面)(?:是|为)?.*(?:翻译|字幕)",
    r"这是.*翻译(?:结果|版本|内容)?",
    r"翻译如下",
    r"我(?:可以|来)?帮你.*翻译",
    r"Here (?:is|are).*(?:translation|subtitle)",
    r"I(?:'ve| have) translated",
    r"Sure[!,\.\s]+here (?:is|are).*(?:translation|subtitle)",
    r"Certainly[!,\.\s]+here (?:is|are).*(?:translation|subtitle)",
    r"```",
)
BOILERPLATE = f"(?i)({'|'.join(BOILERPLATE_PATTERNS)})"


@dataclass(frozen=True)
class Rule:
    """holds: the condition that makes an issue; detail: what is reported with it."""

    type: str
    severity: str
    holds: Column
    detail: Column


def neighbours(cues: DataFrame, group: str = "media_id") -> DataFrame:
    """cues with ordinal, duration_ms, and the start and text of the cues beside them."""
    order = Window.partitionBy(group).orderBy("pos")
    return cues.withColumns({
        "ordinal": F.row_number().over(order).cast("long"), "duration_ms": F.col("end_ms") - F.col("start_ms"),
        "next_start_ms": F.lead("start_ms").over(order), "prev_text": F.lag("text").over(order), "prev_end_ms": F.lag("end_ms").over(order), "prev_start_ms": F.lag("start_ms").over(order),
    })


def _longest_line(text: str = "text") -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(text, r"\n"), lambda x: F.length(F.trim(x)))), F.lit(0))


def numbering(number: str = "number") -> Rule:
    return Rule("broken_numbering", ERROR, F.col(number) != F.col("ordinal"), F.concat_ws("/", F.col(number).cast("string"), F.col("ordinal").cast("string")))


def time_overlap() -> Rule:
    return Rule("time_overlap", WARNING, F.col("end_ms") > F.col("next_start_ms"), (F.col("end_ms") - F.col("next_start_ms")).cast("string"))


def empty() -> Rule:
    return Rule("empty_subtitle", ERROR, F.trim(F.coalesce("text", F.lit(""))) == "", F.lit(""))


def too_long(line: int = 80, total: int = 160) -> list[Rule]:
    longest, length = _longest_line(), F.length("text")
    return [
        Rule("line_too_long", WARNING, longest > line, longest.cast("string")),
        Rule("subtitle_too_long", INFO, (longest <= line) & (length > total), length.cast("string")),
    ]


def too_short(least_ms: int = 500) -> Rule:
    return Rule("too_short", INFO, (F.col("duration_ms") < least_ms) & (F.trim("text") != ""), F.col("duration_ms").cast("string"))


def broken_time() -> Rule:
    return Rule("broken_timestamp", ERROR, F.col("start_ms") >= F.col("end_ms"), F.concat_ws("-", F.col("start_ms").cast("string"), F.col("end_ms").cast("string")))


def boilerplate(pattern: str = BOILERPLATE) -> Rule:
    return Rule("llm_boilerplate", ERROR, F.col("text").rlike(pattern), F.regexp_extract("text", pattern, 1))


def foreign_script(scripts: dict[str, str], least: int = 3) -> Rule:
    """A script, by name and character class, with at least ``least`` characters; the first that has."""
    hit = None
    for name, pattern in scripts.items():
        n = F.regexp_count("text", F.lit(pattern))
        hit = F.when(n >= least, name) if hit is None else hit.when(n >= least, name)
    return Rule("possibly_untranslated", WARNING, hit.isNotNull(), hit)


def reading_speed(wide: str, per_second: float, line: int, total: int) -> list[Rule]:
    """Of texts with the wide script: too many of its characters a second, in a line, in all."""
    n = F.regexp_count("text", F.lit(wide))
    longest = F.array_max(F.transform(F.split("text", r"\n"), lambda x: F.regexp_count(x, F.lit(wide))))
    return [
        Rule("reading_too_fast", WARNING, (n > 0) & (F.col("duration_ms") > 0) & (n * 1000 > F.col("duration_ms") * per_second), n.cast("string")),
        Rule("target_line_too_long", WARNING, longest > line, longest.cast("string")),
        Rule("target_too_long", WARNING, n > total, n.cast("string")),
    ]


def mixed_script(first: str, second: str, most: int = 20, least: int = 10) -> Rule:
    """More of the second script than of the first, more than ``most`` of it, and more than ``least`` in all."""
    a, b = F.regexp_count("text", F.lit(first)), F.regexp_count("text", F.lit(second))
    return Rule("mixed_language", WARNING, (b > a) & (b > most) & (a + b > least) & (a > 0), F.concat_ws("/", a.cast("string"), b.cast("string")))


def foreign_terms(inside: str, least: int = 6, allowed: tuple[str, ...] = ()) -> Rule:
    """Latin terms of at least ``least`` letters in texts that have the script ``inside``."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(rf"([A-Za-z]{{{least},}})"), F.lit(1)), lambda x: F.lower(x)))
    found = F.filter(found, lambda x: ~x.isin(*allowed)) if allowed else found
    return Rule("foreign_terms", INFO, F.col("text").rlike(inside) & (F.size(found) > 0), F.array_join(F.array_sort(found), ","))


def check(cues: DataFrame, rules: list[Rule], group: str = "media_id") -> DataFrame:
    """The issues of all rules: a scan and a window, however many the rules."""
    made = [F.when(r.holds, F.struct(F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"), r.detail.alias("detail"))) for r in rules]
    rows = neighbours(cues, group).select(group, "pos", F.explode(F.array_compact(F.array(*made))).alias("i"))
    return rows.select(group, "pos", "i.type", "i.severity", "i.detail")


def duplicate_runs(cues: DataFrame, group: str = "media_id") -> DataFrame:
    """An issue at the head of each run of two or more equal trimmed texts."""
    from cuelake.operators.sequences import equal_runs

    runs = equal_runs(cues, F.trim("text"), group).where("n >= 2")
    return runs.select(group, F.col("first_pos").alias("pos"), F.lit("duplicate").alias("type"), F.lit(WARNING).alias("severity"), F.col("n").cast("string").alias("detail"))


def near_duplicates(cues: DataFrame, similarity: float = 0.92, least: int = 8, group: str = "media_id") -> DataFrame:
    """An issue where neighbours are not equal but read alike (both of at least ``least`` letters)."""
    from cuelake.functions.similarity import matching_ratio

    rows = neighbours(cues, group).withColumns({"a": T.letters_only(F.col("prev_text")), "b": T.letters_only(F.col("text"))})
    rows = rows.where((F.length("a") >= least) & (F.length("b") >= least) & (F.trim("prev_text") != F.trim("text")))
    # lengths bound the ratio, so that most pairs never reach Python
    possible = 2.0 * F.least(F.length("a"), F.length("b")) / (F.length("a") + F.length("b")) >= similarity
    rows = rows.where(possible).withColumn("ratio", matching_ratio("a", "b")).where(F.col("ratio") >= similarity)
    return rows.select(group, "pos", F.lit("near_duplicate").alias("type"), F.lit(INFO).alias("severity"), F.round("ratio", 4).cast("string").alias("detail"))


def source_report(cues: DataFrame, group: str = "media_id") -> DataFrame:
    """The rule set of source tracks."""
    rules = [time_overlap(), empty(), *too_long(), too_short(), broken_time(), boilerplate()]
    return check(cues, rules, group).unionByName(duplicate_runs(cues, group))


def translation_report(cues: DataFrame, wide: str, scripts: dict[str, str], group: str = "media_id") -> DataFrame:
    """The rule set of translations: neither short nor duplicate cues are issues here."""
    rules = [time_overlap(), empty(), *too_long(), broken_time(), boilerplate(), foreign_script(scripts), *reading_speed(wide, 9.0, 18, 36), mixed_script(wide, "[A-Za-z]")]
    return check(cues, rules, group)


def summary(issues: DataFrame, group: str = "media_id") -> DataFrame:
    """group, n_error, n_warning, n_info, status: fail, warning or pass."""
    n = lambda s: F.count_if(F.col("severity") == s)
    out = issues.groupBy(group).agg(n(ERROR).alias("n_error"), n(WARNING).alias("n_warning"), n(INFO).alias("n_info"))
    return out.withColumn("status", F.when(F.col("n_error") > 0, "fail").when(F.col("n_warning") > 0, "warning").otherwise("pass"))


def by_type(issues: DataFrame) -> DataFrame:
    """Counts by severity and type, by severity, and in all."""
    return issues.groupingSets([["severity", "type"], ["severity"], []], "severity", "type").agg(F.count("*").alias("n"))


def text_in_silence() -> Column:
    return (F.col("silence_milli") > 600) & (F.trim(F.coalesce("text", F.lit(""))) != "")


def doubtful() -> Column:
    """Low confidence, high compression, or text in silence."""
    return F.coalesce(F.col("logprob_milli") < -1000, F.lit(False)) | F.coalesce(F.col("compression_milli") > 2400, F.lit(False)) | F.coalesce(text_in_silence(), F.lit(False))


def suspicious(cues: DataFrame, group: str = "media_id") -> DataFrame:
    """cues with suspicious: doubtful, or the text before again."""
    order = Window.partitionBy(group).orderBy("pos")
    plain = T.letters_only(F.col("text"))
    again = (plain == F.lag(plain).over(order)) & (plain != "")
    return cues.withColumn("suspicious", doubtful() | F.coalesce(again, F.lit(False)))


def invalid_strict(cues: DataFrame, group: str = "media_id") -> DataFrame:
    """Cues that break the contract of no overlap: negative or empty spans, control characters, a start before the end before."""
    rows = neighbours(cues, group)
    code = (
        F.when(F.col("start_ms") < 0, "negative").when(F.col("duration_ms") <= 0, "not_positive").when(F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control_character")
        .when(F.col("start_ms") < F.col("prev_end_ms"), "overlap")
    )
    return rows.select(group, "pos", code.alias("code")).where("code is not null")


def invalid_monotonic(cues: DataFrame, most_ms: int, group: str = "media_id") -> DataFrame:
    """Cues that break the contract of rising starts: empty spans, a start before the start before, an end over ``most_ms`` + 500."""
    rows = neighbours(cues, group)
    code = F.when(F.col("duration_ms") <= 0, "not_positive").when(F.col("start_ms") < F.col("prev_start_ms"), "not_rising").when(F.col("end_ms") > most_ms + 500, "beyond_media")
    return rows.select(group, "pos", code.alias("code")).where("code is not null")


def blocking(source: Column, target: Column, scripts: dict[str, str], least: int = 3) -> Column:
    """Codes that block a translation: empty, boilerplate, identical, possibly_untranslated."""
    a, b = T.word_characters(source), T.word_characters(target)
    foreign = F.lit(False)
    for pattern in scripts.values():
        foreign = foreign | (F.regexp_count(target, F.lit(pattern)) >= least)
    return F.array_compact(F.array(
        F.when(F.trim(F.coalesce(target, F.lit(""))) == "", "empty"), F.when(target.rlike(BOILERPLATE), "boilerplate"),
        F.when((a == b) & (F.length(a) >= 4), "identical"), F.when(foreign, "possibly_untranslated"),
    ))


def cross_line_windows(cues: DataFrame, group: str = "media_id") -> DataFrame:
    """Sentences over two cues: the cue before does not end one, and this one goes on in lower case."""
    rows = neighbours(cues, group)
    open_end = ~F.col("prev_text").rlike(r"[.!?…。！？][\"'”’)]*\s*$")
    goes_on = F.col("text").rlike(r"^\s*\p{Ll}")
    return rows.where(open_end & goes_on).select(group, (F.col("ordinal") - 1).alias("first_pos"), F.col("ordinal").alias("last_pos"))


def structure(candidate: DataFrame, expected: DataFrame, group: str = "media_id") -> DataFrame:
    """Of each group: missing and extra ids, ids with other times, and empty texts."""
    a = candidate.select(group, "pos", F.col("start_ms").alias("cs"), F.col("end_ms").alias("ce"), "text", F.lit(1).alias("c"))
    b = expected.select(group, "pos", F.col("start_ms").alias("xs"), F.col("end_ms").alias("xe"), F.lit(1).alias("x"))
    both = a.join(b, [group, "pos"], "full")
    return both.groupBy(group).agg(
        F.count_if(F.col("c").isNull()).alias("n_missing"), F.count_if(F.col("x").isNull()).alias("n_extra"),
        F.count_if((F.col("cs") != F.col("xs")) | (F.col("ce") != F.col("xe"))).alias("n_moved"), F.count_if(F.col("c").isNotNull() & (F.trim("text") == "")).alias("n_empty"),
    )


def is_bilingual(cues: DataFrame, first: str, second: str, group: str = "media_id") -> DataFrame:
    """Groups in which at least 60 % of cues have two lines and 30 % both scripts."""
    two = F.size(T.lines(F.col("text"))) == 2
    both = F.col("text").rlike(first) & F.col("text").rlike(second)
    out = cues.groupBy(group).agg(F.avg(two.cast("int")).alias("two_lines"), F.avg(both.cast("int")).alias("both_scripts"))
    return out.withColumn("bilingual", (F.col("two_lines") >= 0.6) & (F.col("both_scripts") >= 0.3))


def gate(baseline_disagreement: Column, disagreement: Column, coverage: Column, blockers_before: Column, blockers: Column, least_coverage: float = 0.6, least_gain: float = 0.05) -> Column:
    """insufficient below the coverage; eligible if it gains enough and adds no blocker; otherwise rejected."""
    better = (baseline_disagreement - disagreement >= least_gain) & (blockers <= blockers_before)
    return F.when(coverage < least_coverage, "insufficient").when(better, "eligible").otherwise("rejected")
