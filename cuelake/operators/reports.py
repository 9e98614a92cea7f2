"""Manifests, reports and what of them is public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of references; scopes that are in one language; the scope that takes gold alone; the ids of a manifest's samples.
REFERENCES = ("gold_verbatim", "production_subtitle", "ocr_weak")
FRENCH_SCOPES, GOLD_SCOPE = ("stage3a_french_film", "stage3a_public_gold"), "stage3a_public_gold"
SAMPLES = tuple(f"sample-{k:02d}" for k in range(1, 7))


def manifest_problems(samples: DataFrame, expected: tuple[str, ...] = SAMPLES, least_groups: int = 3) -> DataFrame:
    """manifest, problem: the first rule that a manifest breaks, null if none. samples: manifest, manifest_authorized, scope, sample_id, authorized, reference_type, language,
    reference_path, source_group. Paths must stay inside of the manifest's folder."""
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    scoped = F.coalesce(F.col("scope").isin(*FRENCH_SCOPES), F.lit(False))
    outside = said("reference_path").rlike(r"^[/\\]|^[A-Za-z]:") | F.exists(F.split(said("reference_path"), r"[/\\]"), lambda p: p == "..")
    rules = [
        ("manifest_not_authorized", ~F.coalesce("manifest_authorized", F.lit(False))), ("sample_ids", F.lit(False)), ("sample_not_authorized", ~F.coalesce("authorized", F.lit(False))),
        ("reference_type", ~F.coalesce(F.col("reference_type").isin(*REFERENCES), F.lit(False))), ("language", said("language") == ""), ("reference_path", (F.col("reference_type") != "ocr_weak") & (said("reference_path") == "")), ("path_outside", outside),
        ("scope_language", scoped & (said("language") != "fr")), ("scope_reference", (F.col("scope") == GOLD_SCOPE) & (F.col("reference_type") != "gold_verbatim")), ("source_group", scoped & (said("source_group") == "")), ("source_groups", F.lit(False)),
    ]
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"))) for k, (name, c) in enumerate(rules)]))
    first = samples.withColumn("b", F.array_min(broken)).groupBy("manifest").agg(
        F.min("b").alias("b"), F.array_sort(F.collect_list("sample_id")).alias("ids"), F.max(scoped).alias("scoped"), F.count_distinct(F.when(said("source_group") != "", said("source_group"))).alias("groups"),
    )
    names = [name for name, _ in rules]
    late = lambda name, c: F.when(c, F.struct(F.lit(names.index(name)).alias("k"), F.lit(name).alias("name")))
    worst = F.array_min(F.array_compact(F.array("b", late("sample_ids", F.col("ids") != F.array(*[F.lit(x) for x in sorted(expected)])), late("source_groups", F.col("scoped") & (F.col("groups") < least_groups)))))
    return first.select("manifest", worst["name"].alias("problem"))


def public_groups(samples: DataFrame) -> DataFrame:
    """source_group (an alias by rank), sample_count, gold_count, of samples (sample_id, source_group, reference_type): a row for each group."""
    counts = samples.groupBy("source_group").agg(F.count("*").alias("sample_count"), F.count_if(F.col("reference_type") == "gold_verbatim").alias("gold_count"))
    rank = F.row_number().over(Window.orderBy("source_group"))  # a row for each source group
    return counts.select(F.concat(F.lit("source-group-"), F.lpad(rank.cast("string"), 2, "0")).alias("source_group"), "sample_count", "gold_count")


def public_samples(samples: DataFrame) -> DataFrame:
    """samples with their group's alias, and profiles (map name to struct wer, cer, joined_sha256, normalized) without texts and with the first 12 digits of the hash."""
    rank = F.dense_rank().over(Window.orderBy("source_group"))
    alias = samples.select("source_group").distinct().select("source_group", F.concat(F.lit("source-group-"), F.lpad(rank.cast("string"), 2, "0")).alias("alias"))
    kept = F.transform_values("profiles", lambda k, v: F.struct(v["wer"].alias("wer"), v["cer"].alias("cer"), F.left(v["joined_sha256"], F.lit(12)).alias("hash_prefix")))
    return samples.join(alias, "source_group").select("sample_id", "reference_type", F.col("alias").alias("source_group"), kept.alias("profiles"))


def flattened(public: DataFrame) -> DataFrame:
    """A row for each sample and profile: sample_id, reference_type, profile, and the profile's values."""
    rows = public.select("sample_id", "reference_type", F.explode("profiles").alias("profile", "v"))
    return rows.select("sample_id", "reference_type", "profile", "v.*")


def safe_summary(run: DataFrame, keys: list[str]) -> DataFrame:
    """run with each list replaced by how many it holds (0 for null): what may leave the machine."""
    lists = [f.name for f in run.schema.fields if f.dataType.typeName() == "array" and f.name not in keys]
    return run.select(*[F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0))).cast("long").alias(f"{c}_count") if c in lists else F.col(c) for c in run.columns])


def sample_results(samples: DataFrame, tracks: dict[str, DataFrame], issues: DataFrame, group: str = "media_id") -> DataFrame:
    """A row for each sample (group, status, expected_language, detected_language): cues of each track, errors and warnings of its report, cues to review, and a conclusion: failed,
    wrong_language, no_source (cues of the track of that name), errors, review or ok."""
    out = samples
    for name, rows in tracks.items():
        out = out.join(rows.groupBy(group).agg(F.count("*").alias(f"n_{name}")), group, "left").fillna(0, [f"n_{name}"])
    n = lambda s: F.count_if(F.col("severity") == s)
    found = issues.groupBy(group).agg(n("error").alias("n_errors"), n("warning").alias("n_warnings"), F.count_distinct("pos").alias("n_review"))
    out = out.join(found, group, "left").fillna(0, ["n_errors", "n_warnings", "n_review"])
    other = F.col("expected_language").isNotNull() & F.col("detected_language").isNotNull() & (F.col("expected_language") != F.col("detected_language"))
    first: Column = (
        F.when(F.col("status") != "completed", "failed").when(other, "wrong_language").when(F.col("n_source") == 0, "no_source").when(F.col("n_errors") > 0, "errors").when(F.col("n_review") > 0, "review").otherwise("ok")
    )
    return out.withColumn("conclusion", first)
