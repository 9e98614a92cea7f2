"""Settings of requests: what a value means, or what is wrong with it; keys of caches; names of outputs.

A setting gives a struct with ``error`` (null if it is sound)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modes of recognition, strategies of translation, and what repair may be.
ASR_MODES = ("auto", "fixed", "multilingual")
STRATEGIES = ("standard", "three_pass", "semantic_review", "wenyi_review", "semantic_wenyi_review")
REPAIR_MODES = ("off", "preview")
#: Candidates of decoding, their versions, strategies and modes; models that they are for.
CANDIDATES = [
    ("vad-balanced-v1", 1, "decode"), ("vad-sensitive-v1", 1, "decode"), ("decode-repeat-guard-v1", 1, "decode"), ("previous-text-off-v1", 1, "decode"),
    ("local-retry-v1", 1, "local_retry"), ("local-retry-selective-v2", 2, "local_retry_selective"), ("mixed-route-v1", 1, "mixed_route"),
]
MODES, MODELS, EXPERIMENTS = ("off", "dry_run"), ("small", "large-v3"), ("off", "dry_run", "apply")
#: Settings that are part of a cache's key for every strategy, with repair, with any strategy but the standard one, and with those that send the glossary.
KEY_ALWAYS = ("input", "api_provider", "llm_model", "target_language", "translation_mode", "effective_prompt")
KEY_REPAIR = ("translation_reliability", "translation_quality_model")
KEY_STAGED = ("translation_strategy", "translation_strategy_mode", "scene_gap_seconds", "context_window", "translation_quality_model", "max_cps_zh", "max_chars_per_subtitle_zh", "preserve_unknown_names")
KEY_GLOSSARY = ("profile_glossary",)


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def asr_request(mode: Column, language: Column, reject_conflict: bool = True) -> Column:
    """mode, language, error: without a mode, a language makes it fixed; only a fixed mode has a language."""
    lang = F.when(_plain(language) == "auto", "").otherwise(_plain(language))
    m = F.when(_plain(mode) != "", _plain(mode)).when(lang != "", "fixed").otherwise("auto")
    conflict = (lang != "") & F.lit(reject_conflict)
    error = F.when(~m.isin(*ASR_MODES), "mode").when((m == "fixed") & (lang == ""), "language_needed").when((m != "fixed") & conflict, "language_not_accepted")
    return F.struct(F.when(error.isNull(), m).alias("mode"), F.when(error.isNull() & (m == "fixed"), lang).alias("language"), error.alias("error"))


def translation_strategy(mode: Column, gap: Column) -> Column:
    """mode, gap (of scenes, 1 to 600 s; 30 without one), error."""
    m = F.replace(F.when(_plain(mode) == "", "standard").otherwise(_plain(mode)), F.lit("-"), F.lit("_"))
    seconds = F.coalesce(gap.cast("string"), F.lit("30")).try_cast("double")
    error = F.when(~m.isin(*STRATEGIES), "mode").when(seconds.isNull(), "gap_no_number").when(~seconds.between(1, 600) | F.isnan(seconds), "gap_range")
    return F.struct(F.when(error.isNull(), m).alias("mode"), F.when(error.isNull(), seconds).alias("gap"), error.alias("error"))


def reliability(mode: Column, limit: Column) -> Column:
    """mode, limit (of extra requests, 0 to 50; 12 without one), error."""
    m = F.trim(F.when(F.coalesce(mode, F.lit("")) == "", "off").otherwise(mode))
    text = F.coalesce(limit.cast("string"), F.lit(""))
    n = F.when(text == "", 12).otherwise(F.trim(text).try_cast("int"))
    error = F.when(~m.isin(*REPAIR_MODES), "mode").when(n.isNull(), "limit_no_integer").when(~n.between(0, 50), "limit_range")
    return F.struct(F.when(error.isNull(), m).alias("mode"), F.when(error.isNull(), n).alias("limit"), error.alias("error"))


def candidate(name: Column, mode: Column, model: Column) -> Column:
    """strategy, version, error of a candidate of decoding."""
    table = F.create_map(*[x for c, version, strategy in CANDIDATES for x in (F.lit(c), F.struct(F.lit(strategy).alias("strategy"), F.lit(version).alias("version")))])
    found = F.try_element_at(table, F.trim(F.coalesce(name, F.lit(""))))
    error = F.when(found.isNull(), "candidate").when(~F.coalesce(mode, F.lit("")).isin(*EXPERIMENTS), "mode").when(~mode.isin(*MODES), "mode_not_allowed").when(~F.coalesce(model, F.lit("")).isin(*MODELS), "model")
    return F.struct(F.when(error.isNull(), found["strategy"]).alias("strategy"), F.when(error.isNull(), found["version"]).alias("version"), error.alias("error"))


def cache_key(settings: Column, length: int = 24) -> Column:
    """Digest of those settings (map name to value) that the strategy and the repair mode make part of a key, by name; others, and null ones, change nothing."""
    strategy = F.coalesce(F.try_element_at(settings, F.lit("translation_strategy_mode")), F.lit("standard"))
    used = F.array(*[F.lit(x) for x in KEY_ALWAYS])
    more = lambda names, when: F.when(when, F.array(*[F.lit(x) for x in names])).otherwise(F.array().cast("array<string>"))
    repaired = F.try_element_at(settings, F.lit("reliability_mode")) == "preview"
    used = F.concat(used, more(KEY_REPAIR, F.coalesce(repaired, F.lit(False))), more(KEY_STAGED, strategy != "standard"), more(KEY_GLOSSARY, strategy.isin("wenyi_review", "semantic_wenyi_review")))
    kept = F.map_filter(settings, lambda k, v: F.array_contains(used, k) & v.isNotNull())
    return F.left(F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))), 256), F.lit(length))


def records_fingerprint(records: DataFrame, settings: dict[str, str], group: str = "media_id") -> DataFrame:
    """group, fingerprint: a digest of settings and of all records (pos, text) in order. Records are digested one by one first, so that no text of a recording is put together."""
    each = F.sha2(F.concat_ws("\x1f", F.col("pos").cast("string"), F.coalesce("text", F.lit("\x00"))), 256)
    fixed = "\x1e".join(f"{k}={v}" for k, v in sorted(settings.items()))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", each.alias("h")))), lambda x: x["h"])
    return records.groupBy(group).agg(F.sha2(F.concat(F.lit(fixed + "\x1e"), F.array_join(listed, "")), 256).alias("fingerprint"))


def fingerprints(files: DataFrame, cached: DataFrame) -> DataFrame:
    """files (path, size, mtime, content) with sha256 and origin: the cache's (path, size, mtime, sha256) where nothing of these has changed,
    otherwise of the content; empty files have none."""
    known = cached.select("path", "size", "mtime", F.col("sha256").alias("_known"))
    rows = files.where("size > 0").join(known, ["path", "size", "mtime"], "left")
    return rows.select("path", "size", "mtime", F.coalesce("_known", F.sha2("content", 256)).alias("sha256"), F.when(F.col("_known").isNotNull(), "cache").otherwise("content").alias("origin"))


def outputs(root: Column, stem: Column, model: Column, language: Column, mode: Column) -> Column:
    """Paths by kind: source, translated, bilingual, final (of the mode), report and review."""
    base = F.concat_ws(".", stem, model)
    translated, bilingual = F.concat(root, F.lit("/zh/"), base, F.lit(".translated."), language, F.lit(".srt")), F.concat(root, F.lit("/bilingual/"), base, F.lit(".bilingual."), language, F.lit(".srt"))
    return F.struct(
        F.concat(root, F.lit("/source/"), base, F.lit(".srt")).alias("source"), translated.alias("translated"), bilingual.alias("bilingual"), F.when(mode == "translated", translated).otherwise(bilingual).alias("final"),
        F.concat(root, F.lit("/reports/"), base, F.lit(".quality_report.json")).alias("report"), F.concat(root, F.lit("/reports/"), base, F.lit(".review_needed.srt")).alias("review"),
    )
