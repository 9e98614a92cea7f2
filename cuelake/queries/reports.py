"""Queries over manifests, reports and their public parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.bridge import CUES_SQL, OTHER_SQL, cues, other_track, table
from cuelake.operators import reports as P
from cuelake.operators import rules as R
from cuelake.queries.registry import query

#: A manifest of six samples for each customer, each broken in one way (or none) in turn, and what is wrong with it, by hand.
_BROKEN = [
    ({}, None), ({"manifest_authorized": None}, "manifest_not_authorized"), ({"sample_id": "sample-07"}, "sample_ids"), ({"authorized": False}, "sample_not_authorized"), ({"reference_type": "gold"}, "reference_type"),
    ({"language": " "}, "language"), ({"reference_path": ""}, "reference_path"), ({"reference_path": "a/../../b"}, "path_outside"), ({"language": "en"}, "scope_language"), ({"reference_type": "ocr_weak"}, "scope_reference"),
    ({"source_group": None}, "source_group"), ({"all_groups": "g1"}, "source_groups"), ({"scope": "other", "language": "en", "source_group": None}, None), ({"scope": "other", "reference_type": "ocr_weak", "reference_path": None}, None),
]
_SAMPLE = {"manifest_authorized": True, "scope": "stage3a_public_gold", "sample_id": "sample-06", "authorized": True, "reference_type": "gold_verbatim", "language": "fr", "reference_path": "refs/a.srt", "source_group": "g6"}


@query("s30_s31_s32_manifest", "SELECT c_custkey AS manifest, [" + ", ".join("NULL" if p is None else f"'{p}'" for _, p in _BROKEN) + f"][c_custkey % {len(_BROKEN)} + 1] AS problem FROM customer")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("c_custkey") % len(_BROKEN) + 1).cast("int")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("manifest"), k.alias("k"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i"))

    def value(name: str):
        """The sixth sample has the case's values, the scope and the manifest's flag are all samples'."""
        plain = {"sample_id": F.concat(F.lit("sample-0"), F.col("i").cast("string")), "source_group": F.concat(F.lit("g"), F.col("i").cast("string"))}.get(name, F.lit(_SAMPLE[name]))
        case = F.element_at(F.array(*[F.lit(({**_SAMPLE, **c})[name]) for c, _ in _BROKEN]), F.col("k"))
        every = F.element_at(F.array(*[F.lit(c.get("all_groups")).cast("string") for c, _ in _BROKEN]), F.col("k"))
        out = F.when((F.col("i") == 6) | F.lit(name in ("scope", "manifest_authorized")), case).otherwise(plain)
        return (F.coalesce(every, out) if name == "source_group" else out).alias(name)

    return P.manifest_problems(rows.select("manifest", *[value(name) for name in _SAMPLE]))


_PUBLIC = "s AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'gold_verbatim' ELSE 'ocr_weak' END AS reference_type FROM documents WHERE source IS NOT NULL), r AS (SELECT source, 'source-group-' || lpad(row_number() OVER (ORDER BY source)::VARCHAR, 2, '0') AS alias FROM (SELECT DISTINCT source FROM s))"


def public_input(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars").cast("double")
    profile = lambda k: F.struct((n / k).alias("wer"), (n / (2 * k)).alias("cer"), F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(f"/{k}")), 256).alias("joined_sha256"), F.col("text").alias("normalized"))
    profiles = F.create_map(F.lit("speed"), profile(4), F.lit("quality"), profile(8))
    rows = table(spark, d, "documents").where("source is not null")
    return rows.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("source_group"), F.when(F.col("lang") == "en", "gold_verbatim").otherwise("ocr_weak").alias("reference_type"), profiles.alias("profiles"))


@query("a34_public_groups", f"WITH {_PUBLIC} SELECT alias AS source_group, count(*) AS sample_count, count(*) FILTER (WHERE reference_type = 'gold_verbatim') AS gold_count FROM s JOIN r USING (source) GROUP BY alias")
def public_groups(spark: SparkSession, d: str) -> DataFrame:
    return P.public_groups(public_input(spark, d))


@query("a42_flattened", f"WITH {_PUBLIC} SELECT doc_id AS sample_id, reference_type, profile, n_chars / k::DOUBLE AS wer, n_chars / (2 * k)::DOUBLE AS cer, left(sha256(doc_id || '/' || k), 12) AS hash_prefix FROM s JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id), (VALUES ('speed', 4), ('quality', 8)) p(profile, k)")
def flattened(spark: SparkSession, d: str) -> DataFrame:
    return P.flattened(P.public_samples(public_input(spark, d)))


@query("a33_safe_summary", "SELECT user_id, count(*) AS seen_ids_count, count(*) FILTER (WHERE event_id % 3 = 0) AS repaired_ids_count, 0 AS none_ids_count, max(value) AS most FROM events GROUP BY user_id")
def safe_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_id").alias("seen_ids"), F.collect_list(F.when(F.col("event_id") % 3 == 0, F.col("event_id"))).alias("repaired_ids"), F.lit(None).cast("array<bigint>").alias("none_ids"), F.max("value").alias("most"))
    return P.safe_summary(runs, ["user_id"])


@query("a39_sample_results", f"""WITH {CUES_SQL}, {OTHER_SQL}, n AS (SELECT media_id, count(*) AS n_source FROM cues GROUP BY media_id), t AS (SELECT media_id, count(*) AS n_translated FROM other WHERE media_id % 13 <> 5 GROUP BY media_id),
i AS (SELECT media_id, pos, CASE WHEN end_ms - start_ms > 5000 THEN 'error' ELSE 'warning' END AS severity FROM cues WHERE end_ms - start_ms > 4000), q AS (SELECT media_id, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings, count(DISTINCT pos) AS n_review FROM i GROUP BY media_id),
s AS (SELECT media_id, CASE WHEN media_id % 11 = 3 THEN 'failed' ELSE 'completed' END AS status, 'en' AS expected_language, CASE WHEN media_id % 7 = 2 THEN 'fr' WHEN media_id % 7 = 4 THEN NULL ELSE 'en' END AS detected_language FROM n)
SELECT s.*, coalesce(n_translated, 0) AS n_translated, n_source, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings, coalesce(n_review, 0) AS n_review,
  CASE WHEN status <> 'completed' THEN 'failed' WHEN detected_language <> 'en' THEN 'wrong_language' WHEN n_source = 0 THEN 'no_source' WHEN coalesce(n_errors, 0) > 0 THEN 'errors' WHEN coalesce(n_review, 0) > 0 THEN 'review' ELSE 'ok' END AS conclusion
FROM s JOIN n USING (media_id) LEFT JOIN t USING (media_id) LEFT JOIN q USING (media_id)""")
def sample_results(spark: SparkSession, d: str) -> DataFrame:
    rows, m = cues(spark, d), F.col("media_id")
    samples = rows.select("media_id").distinct().select("media_id", F.when(m % 11 == 3, "failed").otherwise("completed").alias("status"), F.lit("en").alias("expected_language"), F.when(m % 7 == 2, "fr").when(m % 7 != 4, "en").alias("detected_language"))
    long = F.col("end_ms") - F.col("start_ms")
    issues = R.check(rows, [R.Rule("long", "error", long > 5000, F.lit("")), R.Rule("longish", "warning", (long > 4000) & (long <= 5000), F.lit(""))])
    return P.sample_results(samples, {"translated": other_track(rows).where("media_id % 13 <> 5"), "source": rows}, issues)
