"""Queries over two tracks, reviews, plans and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.bridge import CUES_SQL, OTHER_SQL, cues, other_track, table
from cuelake.operators import bootstrap as B
from cuelake.operators import intervals as J
from cuelake.operators import metrics as A
from cuelake.operators import review as V
from cuelake.operators import rules as R
from cuelake.plans import planning as C
from cuelake.queries.registry import query
from cuelake.queries.sequences import _SUSPECT, _islands
from cuelake.sources.files import kept
from cuelake.streaming import stage_events as E

_C = f"WITH {CUES_SQL} "
_T = f"WITH {CUES_SQL}, {OTHER_SQL} "
_OVERLAP = "least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)"


def tracks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = cues(spark, d)
    return rows, other_track(rows)


@query("j01_best_overlap", f"""{_T} SELECT media_id, pos, text, other_pos, other_text, overlap_ms FROM (
  SELECT l.media_id, l.pos, l.text, r.pos AS other_pos, r.text AS other_text, {_OVERLAP} AS overlap_ms, row_number() OVER (PARTITION BY l.media_id, l.pos ORDER BY {_OVERLAP} DESC, r.pos) AS k
  FROM cues l JOIN other r ON l.media_id = r.media_id WHERE {_OVERLAP} > 300) WHERE k = 1""")
def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    return J.best_overlap(*tracks(spark, d))


@query("a14_a15_pair_lengths", f"""{_T}, p AS (SELECT media_id, length(other_text)::DOUBLE / length(text) AS ratio FROM (
  SELECT l.media_id, l.pos, l.text, r.text AS other_text, row_number() OVER (PARTITION BY l.media_id, l.pos ORDER BY {_OVERLAP} DESC, r.pos) AS k FROM cues l JOIN other r ON l.media_id = r.media_id WHERE {_OVERLAP} > 300) WHERE k = 1 AND length(text) > 0)
SELECT media_id, count(*) AS n, avg(ratio) AS mean_ratio, median(ratio) AS median_ratio, min(ratio) AS least_ratio, max(ratio) AS most_ratio, avg((ratio < 0.8)::INT) AS shorter, avg((ratio BETWEEN 0.8 AND 1.25)::INT) AS alike, avg((ratio > 1.25)::INT) AS longer FROM p GROUP BY media_id""")
def pair_lengths(spark: SparkSession, d: str) -> DataFrame:
    return A.pair_lengths(J.best_overlap(*tracks(spark, d)))


@query("j02_nearest_within", f"""{_T} SELECT media_id, pos, other_pos, distance_ms FROM (
  SELECT l.media_id, l.pos, r.pos AS other_pos, greatest(0, r.start_ms - l.end_ms, l.start_ms - r.end_ms) AS distance_ms,
         row_number() OVER (PARTITION BY l.media_id, l.pos ORDER BY greatest(0, r.start_ms - l.end_ms, l.start_ms - r.end_ms), abs(r.start_ms - l.start_ms), r.pos) AS k
  FROM cues l JOIN other r ON l.media_id = r.media_id WHERE greatest(0, r.start_ms - l.end_ms, l.start_ms - r.end_ms) <= 500) WHERE k = 1""")
def nearest_within(spark: SparkSession, d: str) -> DataFrame:
    return J.nearest_within(*tracks(spark, d), 500)


@query("j02_aligned_groups", f"""{_T}, b AS (SELECT media_id, start_ms, end_ms, 1 AS l FROM cues UNION ALL SELECT media_id, start_ms, end_ms, 0 FROM other),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, l ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM (
  SELECT *, CASE WHEN start_ms >= max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, l) = 1 THEN 1 ELSE 0 END AS new FROM b))
SELECT media_id, part, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(1 - l) AS BIGINT) AS n_right, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY media_id, part""")
def aligned_groups(spark: SparkSession, d: str) -> DataFrame:
    return J.aligned_groups(*tracks(spark, d))


@query("j03_joined_texts", f"""{_T} SELECT media_id, pos, string_agg(text, ' ' ORDER BY s, p) AS heard FROM (SELECT l.media_id, l.pos, r.text, min(r.start_ms) AS s, arg_min(r.pos, r.start_ms * 100000 + r.pos) AS p FROM cues l JOIN other r ON l.media_id = r.media_id WHERE {_OVERLAP} > 50 GROUP BY ALL) GROUP BY media_id, pos""")
def joined_texts(spark: SparkSession, d: str) -> DataFrame:
    return J.joined_texts(*tracks(spark, d))


_WINDOWS = "windows AS (SELECT media_id, pos, start_ms - 1000 AS start_ms, end_ms + 1000 AS end_ms FROM cues WHERE (media_id * 3 + pos) % 6 = 0)"


def windows(rows: DataFrame) -> DataFrame:
    flagged = rows.where((F.col("media_id") * 3 + F.col("pos")) % 6 == 0)
    return flagged.select("media_id", "pos", (F.col("start_ms") - 1000).alias("start_ms"), (F.col("end_ms") + 1000).alias("end_ms"))


@query("j04_j05_touching", f"WITH {CUES_SQL}, {_WINDOWS} SELECT media_id, pos FROM cues c WHERE EXISTS (SELECT 1 FROM windows w WHERE w.media_id = c.media_id AND w.start_ms < c.end_ms AND w.end_ms > c.start_ms)")
def touching(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    return J.touching(rows, windows(rows)).select("media_id", "pos")


@query("j06_j07_j08_replace_windows", f"""{_T}, {_WINDOWS} SELECT media_id, pos, 'base' AS origin FROM cues c WHERE NOT EXISTS (SELECT 1 FROM windows w WHERE w.media_id = c.media_id AND floor((c.start_ms + c.end_ms) / 2) BETWEEN w.start_ms AND w.end_ms)
UNION ALL SELECT media_id, pos, 'candidate' FROM other c WHERE EXISTS (SELECT 1 FROM windows w WHERE w.media_id = c.media_id AND w.start_ms < c.end_ms AND w.end_ms > c.start_ms)""")
def replace_windows(spark: SparkSession, d: str) -> DataFrame:
    rows, other = tracks(spark, d)
    return J.replace_windows(rows, other, windows(rows)).select("media_id", "pos", "origin")


@query("j09_u15_uncovered", f"""{_T}, padded AS (SELECT media_id, start_ms - 250 AS start_ms, end_ms + 250 AS end_ms FROM other WHERE pos % 3 <> 0), covered AS ({_islands(0, 'padded')}), spoken AS ({_islands(500)}),
e AS (SELECT media_id, t, sum(s) AS s, sum(c) AS c FROM (SELECT media_id, start_ms AS t, 1 AS s, 0 AS c FROM spoken UNION ALL SELECT media_id, end_ms, -1, 0 FROM spoken UNION ALL SELECT media_id, start_ms, 0, 1 FROM covered UNION ALL SELECT media_id, end_ms, 0, -1 FROM covered) GROUP BY ALL),
x AS (SELECT media_id, t AS start_ms, lead(t) OVER w AS end_ms, sum(s) OVER w AS s, sum(c) OVER w AS c FROM e WINDOW w AS (PARTITION BY media_id ORDER BY t)),
kept AS (SELECT media_id, start_ms, end_ms FROM x WHERE s > 0 AND c = 0 AND end_ms - start_ms >= 1000)
SELECT media_id, island, start_ms, end_ms FROM ({_islands(500, 'kept')})""")
def uncovered(spark: SparkSession, d: str) -> DataFrame:
    rows, other = tracks(spark, d)
    return J.difference(rows, other.where("pos % 3 <> 0"))


@query("j10_j41_buckets", f"""{_T}, b AS (SELECT media_id, pos, text, start_ms, end_ms, 1 AS l FROM cues UNION ALL SELECT media_id, pos, text, start_ms, end_ms, 0 FROM other), s AS (SELECT media_id, min(start_ms) AS t0, max(end_ms) AS t1 FROM b GROUP BY media_id),
k AS (SELECT b.*, t0, t1, least(greatest(0, floor((t1 - t0 - 1) / 15000)), floor((floor((start_ms + end_ms) / 2) - t0) / 15000))::BIGINT AS bucket FROM b JOIN s USING (media_id))
SELECT media_id, bucket, t0 + bucket * 15000 AS start_ms, least(t0 + bucket * 15000 + 15000, t1) AS end_ms, count(*) FILTER (WHERE l = 1) AS n_left, count(*) FILTER (WHERE l = 0) AS n_right,
  coalesce(string_agg(text, ' ' ORDER BY pos, text) FILTER (WHERE l = 1), '') AS left_text, coalesce(string_agg(text, ' ' ORDER BY pos, text) FILTER (WHERE l = 0), '') AS right_text FROM k GROUP BY media_id, bucket, t0, t1""")
def buckets(spark: SparkSession, d: str) -> DataFrame:
    return J.bucket_alignment(*tracks(spark, d))


@query("j11_midpoint_texts", f"""{_T} SELECT l.media_id, l.pos, coalesce(string_agg(r.text, ' ' ORDER BY floor((r.start_ms + r.end_ms) / 2), r.pos), '') AS heard FROM cues l LEFT JOIN other r ON l.media_id = r.media_id AND floor((r.start_ms + r.end_ms) / 2) >= l.start_ms AND floor((r.start_ms + r.end_ms) / 2) < l.end_ms GROUP BY l.media_id, l.pos""")
def midpoint_texts(spark: SparkSession, d: str) -> DataFrame:
    return J.midpoint_texts(*tracks(spark, d))


@query("a02_a03_window_quality", f"""WITH {CUES_SQL}, {_WINDOWS}, {_SUSPECT}, p AS (SELECT w.media_id, w.pos, c.pos AS cp, c.text, c.logprob_milli, c.compression_milli, c.suspicious, c.start_ms, c.end_ms, least(w.end_ms, c.end_ms) - greatest(w.start_ms, c.start_ms) AS o
  FROM windows w JOIN suspect c ON w.media_id = c.media_id WHERE least(w.end_ms, c.end_ms) - greatest(w.start_ms, c.start_ms) > 0),
a AS (SELECT *, text = lag(text) OVER (PARTITION BY media_id, pos ORDER BY cp) AS again FROM p)
SELECT media_id, pos, count(*) AS n, sum(o)::BIGINT AS covered_ms, avg(logprob_milli) AS mean_logprob, max(compression_milli) AS most_compression, count(*) FILTER (WHERE again) AS n_again, count(*) FILTER (WHERE suspicious) AS n_suspicious,
  sum(length(text))::BIGINT AS characters, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM a GROUP BY media_id, pos""")
def window_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    return A.window_quality(R.suspicious(rows), windows(rows))


@query("f28_f29_structure", f"""{_T}, c AS (SELECT media_id, pos + (pos % 9 = 0)::INT * 1000 AS pos, start_ms, end_ms, CASE WHEN pos % 4 = 0 THEN '' ELSE text END AS text, 1 AS c FROM other), x AS (SELECT media_id, pos, start_ms, end_ms, 1 AS x FROM cues)
SELECT media_id, count(*) FILTER (WHERE c IS NULL) AS n_missing, count(*) FILTER (WHERE x IS NULL) AS n_extra, count(*) FILTER (WHERE c.start_ms <> x.start_ms OR c.end_ms <> x.end_ms) AS n_moved, count(*) FILTER (WHERE c IS NOT NULL AND trim(text) = '') AS n_empty
FROM c FULL JOIN x USING (media_id, pos) GROUP BY media_id""".replace("(WHERE c IS NULL)", "(WHERE c.c IS NULL)").replace("c IS NOT NULL", "c.c IS NOT NULL").replace("(WHERE x IS NULL)", "(WHERE x.x IS NULL)"))
def structure(spark: SparkSession, d: str) -> DataFrame:
    rows, other = tracks(spark, d)
    changed = other.withColumns({"text": F.when(F.col("pos") % 4 == 0, "").otherwise(F.col("text")), "pos": F.col("pos") + (F.col("pos") % 9 == 0).cast("int") * 1000})
    return R.structure(changed, rows)


_WORD = r"regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', '', 'g')"


@query("f16_f22_j36_blocking", f"""{_T} SELECT media_id, pos, array_to_string(list_filter([CASE WHEN trim(t) = '' THEN 'empty' END, CASE WHEN {_WORD.format('s')} = {_WORD.format('t')} AND length({_WORD.format('s')}) >= 4 THEN 'identical' END], lambda x: x IS NOT NULL), ',') AS codes
FROM (SELECT media_id, pos, text AS s, CASE WHEN pos % 5 = 0 THEN ' ' WHEN pos % 5 = 1 THEN 'other ' || text ELSE upper(text) END AS t FROM cues) WHERE trim(t) = '' OR ({_WORD.format('s')} = {_WORD.format('t')} AND length({_WORD.format('s')}) >= 4)""")
def blocking(spark: SparkSession, d: str) -> DataFrame:
    target = F.when(F.col("pos") % 5 == 0, " ").when(F.col("pos") % 5 == 1, F.concat(F.lit("other "), "text")).otherwise(F.upper("text"))
    codes = R.blocking(F.col("text"), target, {"han": "[\\x{4e00}-\\x{9fff}]"})
    return cues(spark, d).select("media_id", "pos", F.array_join(codes, ",").alias("codes")).where("codes <> ''")


@query("f25_m22_fast_cues", f"{_C} SELECT media_id, pos, length(regexp_replace(text, '[\\t\\n\\f\\r \\x0b]+', '', 'g')) * 1000 / (end_ms - start_ms)::DOUBLE AS per_second FROM cues WHERE end_ms > start_ms AND length(regexp_replace(text, '[\\t\\n\\f\\r \\x0b]+', '', 'g')) * 1000 > 80 * (end_ms - start_ms)")
def fast_cues(spark: SparkSession, d: str) -> DataFrame:
    n, duration = F.length(F.regexp_replace("text", r"\s+", "")), F.col("end_ms") - F.col("start_ms")
    return cues(spark, d).where((duration > 0) & (n * 1000 > 80 * duration)).select("media_id", "pos", (n * 1000 / duration).alias("per_second"))


@query("f26_script_anomaly", f"{_C} SELECT role, avg((NOT regexp_matches(text, '[éèç]'))::INT) AS share FROM cues WHERE trim(text) <> '' GROUP BY role")
def script_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return cues(spark, d).where(F.trim("text") != "").groupBy("role").agg(F.avg((~F.col("text").rlike("[éèç]")).cast("int")).alias("share"))


@query("f27_l02_l03_gate", f"""{_C} SELECT media_id, CASE WHEN cov < 0.6 THEN 'insufficient' WHEN d0 - d1 >= 0.05 AND b1 <= b0 THEN 'eligible' ELSE 'rejected' END AS decision FROM (
  SELECT media_id, avg((turn % 3 = 0)::INT) AS d0, avg((turn % 4 = 0)::INT) AS d1, avg((length(text) > 60)::INT) AS cov, count(*) FILTER (WHERE pos % 2 = 0) AS b0, count(*) FILTER (WHERE pos % 2 = 1) AS b1 FROM cues GROUP BY media_id)""")
def gate(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    rows = cues(spark, d).groupBy("media_id").agg(
        share(F.col("turn") % 3 == 0).alias("d0"), share(F.col("turn") % 4 == 0).alias("d1"), share(F.length("text") > 60).alias("cov"),
        F.count_if(F.col("pos") % 2 == 0).alias("b0"), F.count_if(F.col("pos") % 2 == 1).alias("b1"),
    )
    return rows.select("media_id", R.gate(F.col("d0"), F.col("d1"), F.col("cov"), F.col("b0"), F.col("b1")).alias("decision"))


@query("a04_corpus_rates", f"{_C} SELECT role, sum(pos % 3)::BIGINT AS errors, sum(length(text))::BIGINT AS words, max(pos % 3) AS most_errors, count(*) AS n, sum(pos % 3)::DOUBLE / sum(length(text)) AS rate FROM cues GROUP BY role")
def corpus_rates(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0)
    rows = cues(spark, d).select("role", (F.col("pos") % 3).alias("substitutions"), zero.alias("insertions"), zero.alias("deletions"), F.length("text").alias("words"))
    return A.corpus_rates(rows, "role")


def _spelt_units(spark: SparkSession, d: str) -> DataFrame:
    """Cues as units of two transcripts: in the left one words of over eight letters are wrong, in the right one those that end in s."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = cues(spark, d).select("media_id", "pos", words.alias("w"))
    zero, n = F.lit(0), F.size("w")
    left = rows.select("media_id", "pos", F.size(F.filter("w", lambda x: F.length(x) > 8)).alias("substitutions"), zero.alias("insertions"), zero.alias("deletions"), n.alias("words"))
    right = rows.select("media_id", "pos", zero.alias("substitutions"), F.size(F.filter("w", lambda x: F.endswith(x, F.lit("s")))).alias("insertions"), zero.alias("deletions"), n.alias("words"))
    return B.paired_units(left, right, ["media_id", "pos"])


@query("a27_paired_bootstrap")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return B.paired_bootstrap(_spelt_units(spark, d), "cues")


@query("a27_bootstrap_counts", f"""{_C}, w AS (SELECT regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM cues),
u AS (SELECT len(list_filter(w, lambda x: length(x) > 8)) AS l, len(list_filter(w, lambda x: ends_with(x, 's'))) AS r FROM w)
SELECT 10000::BIGINT AS resamples, count(*) AS least_drawn, count(*) AS most_drawn, count(*) FILTER (WHERE l > r) AS right_won, count(*) FILTER (WHERE l < r) AS left_won, count(*) FILTER (WHERE l = r) AS ties FROM u""")
def bootstrap_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each resample draws as many units as there are, over all partitions."""
    units = _spelt_units(spark, d)
    drawn = B.resampled(units, "cues", 10_000).agg(F.count("*").alias("resamples"), F.min("drawn").alias("least_drawn"), F.max("drawn").alias("most_drawn"))
    return drawn.crossJoin(B.paired_bootstrap(units, "cues", 1).select("right_won", "left_won", "ties"))  # two tables of one row


@query("a17_a18_grouping_levels", f"""{_C} SELECT 'all' AS level, '' AS name, avg(length(text)) AS mean, count(*) AS n FROM cues UNION ALL SELECT 'tag', unnest([role, 'half' || pos % 2]), avg(length(text)), count(*) FROM cues GROUP BY ALL
UNION ALL SELECT 'candidate', 'c' || media_id % 3, avg(length(text)), count(*) FROM cues GROUP BY ALL""".replace("SELECT 'tag', unnest([role, 'half' || pos % 2]), avg(length(text)), count(*) FROM cues GROUP BY ALL", "SELECT 'tag', t, avg(length(text)), count(*) FROM (SELECT text, unnest([role, 'half' || pos % 2]) AS t FROM cues) GROUP BY t"))
def grouping_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).select("text", F.array("role", F.concat(F.lit("half"), (F.col("pos") % 2).cast("string"))).alias("tags"), F.concat(F.lit("c"), (F.col("media_id") % 3).cast("string")).alias("candidate"))
    return A.grouping_levels(rows, F.length("text"))


@query("a16_mean_of_files", f"{_C} SELECT avg(m) AS mean_of_means, max(m) AS most FROM (SELECT media_id, avg(length(text)) AS m FROM cues GROUP BY media_id)")
def mean_of_files(spark: SparkSession, d: str) -> DataFrame:
    return cues(spark, d).groupBy("media_id").agg(F.avg(F.length("text")).alias("m")).agg(F.avg("m").alias("mean_of_means"), F.max("m").alias("most"))


@query("j20_j21_j23_term_consistency", """WITH t(source_term, target_term) AS (VALUES ('the', 'that'), ('and', 'with'), ('la', 'le'))
SELECT t.*, coalesce(s.n, 0) AS n_source, coalesce(g.n, 0) AS n_target, greatest(0, coalesce(s.n, 0) - coalesce(g.n, 0)) AS missing FROM t
LEFT JOIN (SELECT source_term, sum((length(text) - length(replace(lower(text), source_term, ''))) // length(source_term))::BIGINT AS n FROM conversations, t WHERE role = 'user' AND contains(lower(text), source_term) GROUP BY 1) s USING (source_term)
LEFT JOIN (SELECT target_term, sum((length(text) - length(replace(lower(text), target_term, ''))) // length(target_term))::BIGINT AS n FROM conversations, t WHERE role = 'assistant' AND contains(lower(text), target_term) GROUP BY 1) g USING (target_term)""")
def term_consistency(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([("the", "that"), ("and", "with"), ("la", "le")], "source_term string, target_term string")
    rows = table(spark, d, "conversations")
    return A.term_consistency(rows.where("role = 'user'"), rows.where("role = 'assistant'"), terms)


_REVIEWS = "reviews AS (SELECT media_id, pos, role, CASE (media_id + pos) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS choice, CASE WHEN ('0x' || left(sha256('blind:' || media_id || ':' || pos), 2))::INT % 2 = 1 THEN 'B' ELSE 'A' END AS left_is FROM cues)"


def reviews(rows: DataFrame) -> DataFrame:
    k = (F.col("media_id") + F.col("pos")) % 3
    return rows.select("media_id", "pos", "role", F.when(k == 0, "A").when(k == 1, "B").otherwise("tie").alias("choice"))


@query("j16_j17_j19_score_pairs", f"WITH {CUES_SQL}, {_REVIEWS} SELECT role, count(*) FILTER (WHERE choice = left_is) AS left_won, count(*) FILTER (WHERE choice <> left_is AND choice <> 'tie') AS left_lost, count(*) FILTER (WHERE choice = 'tie') AS tied, count(*) AS n FROM reviews GROUP BY role")
def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    key = V.blind_pairs(rows.select("media_id", "pos", F.col("text").alias("left_text"), F.col("role").alias("right_text")), "blind").select("media_id", "pos", "left_is")
    return V.score_pairs(reviews(rows), key, ["media_id", "pos"], ["role"])


@query("j38_j40_j42_blind_pairs", f"""WITH {CUES_SQL}, {_REVIEWS} SELECT media_id, pos, left_is, CASE WHEN left_is = 'B' THEN r.role ELSE text END AS a, CASE WHEN left_is = 'B' THEN text ELSE r.role END AS b FROM reviews r JOIN cues USING (media_id, pos)""")
def blind_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).select("media_id", "pos", F.col("text").alias("left_text"), F.col("role").alias("right_text"))
    return V.blind_pairs(rows, "blind").select("media_id", "pos", "left_is", "a", "b")


@query("j39_blind_order", f"{_C} SELECT media_id, pos, ['x,y,z', 'x,z,y', 'y,x,z', 'y,z,x', 'z,x,y', 'z,y,x'][('0x' || left(sha256('order:' || media_id || ':' || pos), 4))::INT % 6 + 1] AS sides FROM cues")
def blind_order(spark: SparkSession, d: str) -> DataFrame:
    return cues(spark, d).select("media_id", "pos", V.blind_order(["x", "y", "z"], "order", "media_id", "pos").alias("sides"))


@query("j18_m24_order_outcomes", f"""{_C}, o AS (SELECT pos % 2 AS k FROM cues) SELECT x, y, outcome, count(*) AS n FROM (SELECT unnest(CASE WHEN k = 0 THEN [('A', 'B', 'win'), ('A', 'C', 'win'), ('B', 'C', 'tie')] ELSE [('C', 'A', 'win'), ('A', 'B', 'win'), ('C', 'B', 'win')] END) AS s FROM o) t(s), (SELECT 1) WHERE false GROUP BY ALL
UNION ALL SELECT 'A', 'B', 'win', count(*) FROM o UNION ALL SELECT 'A', 'C', 'win', count(*) FROM o WHERE k = 0 UNION ALL SELECT 'B', 'C', 'tie', count(*) FROM o WHERE k = 0 UNION ALL SELECT 'C', 'A', 'win', count(*) FROM o WHERE k = 1 UNION ALL SELECT 'C', 'B', 'win', count(*) FROM o WHERE k = 1""".replace("SELECT x, y, outcome, count(*) AS n FROM (SELECT unnest(CASE WHEN k = 0 THEN [('A', 'B', 'win'), ('A', 'C', 'win'), ('B', 'C', 'tie')] ELSE [('C', 'A', 'win'), ('A', 'B', 'win'), ('C', 'B', 'win')] END) AS s FROM o) t(s), (SELECT 1) WHERE false GROUP BY ALL\nUNION ALL SELECT 'A', 'B', 'win', count(*) FROM o", "SELECT 'A' AS x, 'B' AS y, 'win' AS outcome, count(*) AS n FROM o"))
def order_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).select(F.when(F.col("pos") % 2 == 0, "A>B=C").otherwise("C>A>B").alias("ranking"))
    return V.order_outcomes(rows).groupBy("x", "y", "outcome").agg(F.count("*").alias("n"))


@query("j17_category_counts", f"{_C} SELECT category, count(*) AS n FROM (SELECT unnest(CASE pos % 3 WHEN 0 THEN ['tone', 'terms'] WHEN 1 THEN ['tone'] ELSE [] END) AS category FROM cues) GROUP BY category")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("pos") % 3
    return V.category_counts(cues(spark, d).select(F.when(k == 0, "tone, terms").when(k == 1, "tone,").otherwise("").alias("categories")))


@query("j16_overall_vote", f"{_C} SELECT media_id, pos, CASE WHEN pos % 2 = 0 THEN 'B' WHEN pos % 3 = 0 THEN 'tie' END AS vote FROM cues")
def overall_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).select("media_id", "pos", F.when(F.col("pos") % 2 == 0, "B").otherwise("none").alias("fidelity"), F.when(F.col("pos") % 3 == 0, "tie").alias("style"))
    return rows.select("media_id", "pos", V.overall_vote("fidelity", "style").alias("vote"))


@query("l04_l05_review_sample", f"""WITH {CUES_SQL}, {_SUSPECT}, h AS (SELECT *, row_number() OVER (PARTITION BY media_id, suspicious ORDER BY sha256('sha:' || media_id || '/' || pos), pos) AS k FROM suspect) SELECT media_id, pos, suspicious AS flagged FROM h WHERE suspicious OR k <= 2""")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = R.suspicious(cues(spark, d))
    key = F.concat(F.col("media_id").cast("string"), F.lit("/"), F.col("pos").cast("string"))
    return V.review_sample(rows, F.col("suspicious"), key, "sha", 2).select("media_id", "pos", "flagged")


@query("l06_stable_sample", "SELECT p_partkey FROM part ORDER BY sha256('seed:' || p_partkey), p_partkey LIMIT 12")
def stable_sample(spark: SparkSession, d: str) -> DataFrame:
    return V.stable_sample(table(spark, d, "part"), F.col("p_partkey"), "seed", 12).select("p_partkey")


@query("l11_l12_l15_first_by_group", "SELECT user_id, event_id, ts, place FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events) WHERE place <= 2")
def first_by_group(spark: SparkSession, d: str) -> DataFrame:
    return V.first_by_group(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.col("event_id")], 2)


@query("l13_l14_t35_t36_catalogue", """SELECT kind, language, count(*) AS n FROM (SELECT CASE WHEN l = 'fr' THEN 'french' WHEN l = 'de' THEN 'german' WHEN l = 'es' THEN 'spanish' ELSE 'english' END AS language, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS kind FROM (SELECT lang AS l, n_chars FROM documents)) GROUP BY ALL""")
def catalogue(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in (("fr", "french"), ("de", "german"), ("es", "spanish"), ("en", "english")) for x in pair])
    path = F.concat(F.lit("films/"), F.when(F.col("n_chars") > 2000, "long").otherwise("short"), F.lit("/a."), F.coalesce("lang", F.lit("en")), F.lit(".srt"))
    rows = table(spark, d, "documents").select(path.alias("path"))
    rows = rows.select(names[F.regexp_extract("path", r"\.([a-z]{2})\.srt$", 1)].alias("language"), F.regexp_extract("path", r"/([a-z]+)/", 1).alias("kind"))
    return rows.groupBy("kind", "language").agg(F.count("*").alias("n"))


@query("a29_storage", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source")
def storage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


def stage_rows(spark: SparkSession, d: str) -> DataFrame:
    """The events table as stage events of tasks."""
    rows = table(spark, d, "events")
    status = F.when(F.col("event_id") % 11 == 0, "failed").when(F.col("event_id") % 7 == 0, "completed").otherwise("running")
    return rows.select(F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("stage"), status.alias("status"), F.col("value").alias("duration_seconds"), F.col("event_id"))


_STAGE = "stage AS (SELECT ts, user_id::VARCHAR AS task_id, event_type AS stage, CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'completed' ELSE 'running' END AS status, value, event_id FROM events)"


@query("r01_k11_stage_counts", f"WITH {_STAGE} SELECT date_trunc('hour', ts) AS window_start, stage, status, count(*) AS n, sum(value) AS seconds FROM stage GROUP BY ALL")
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.stage_counts(stage_rows(spark, d))


@query("r02_a31_latest_state", f"WITH {_STAGE} SELECT task_id, arg_max(stage, (ts, stage, status)) AS stage, arg_max(status, (ts, stage, status)) AS status, max(ts) AS updated, count(*) AS n FROM stage GROUP BY task_id")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return E.latest_state(stage_rows(spark, d))


@query("r03_r04_a28_progress", f"""WITH {_STAGE}, l AS (SELECT task_id, arg_max(status, (ts, stage, status)) AS status, max(ts) AS updated FROM stage GROUP BY task_id),
e AS (SELECT *, CASE WHEN status NOT IN ('completed', 'failed') AND (SELECT max(ts) FROM events) - updated > INTERVAL 1 DAY THEN 'stale' ELSE status END AS s FROM l)
SELECT s AS effective_status, CASE s WHEN 'failed' THEN 'retry' WHEN 'stale' THEN 'resume' WHEN 'completed' THEN 'none' ELSE 'wait' END AS recovery, count(*) AS n FROM e GROUP BY s""")
def progress(spark: SparkSession, d: str) -> DataFrame:
    rows = stage_rows(spark, d)
    now = rows.agg(F.max("timestamp").alias("now"))
    states = E.latest_state(rows).crossJoin(F.broadcast(now))  # a single row: the latest time
    return E.progress(states, F.col("now"), 86_400).groupBy("effective_status", "recovery").agg(F.count("*").alias("n"))


@query("r06_r07_r08_logs", f"""WITH {_STAGE}, g AS (SELECT task_id, list(stage || ' ' || status ORDER BY ts, event_id) AS l FROM stage GROUP BY task_id)
SELECT task_id, coalesce(list_filter(l[-20:], lambda x: regexp_matches(x, '(?i)error|failed|exception|traceback'))[-1], NULL) AS error, CASE WHEN len(list_filter(l[-10:], lambda x: regexp_matches(x, 'click|view'))) > 0 THEN CASE WHEN list_filter(l[-10:], lambda x: regexp_matches(x, 'click|view'))[-1] LIKE '%click%' THEN 'working' ELSE 'reading' END END AS stage FROM g""")
def logs(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(" ", "stage", "status")
    rows = stage_rows(spark, d).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "event_id", line.alias("line")))), lambda x: x["line"]).alias("l"))
    return rows.select("task_id", E.last_error(F.col("l")).alias("error"), E.stage_from_log(F.col("l"), {"click": "working", "view": "reading"}).alias("stage"))


@query("e04_r10_retry_plan", f"""WITH {_STAGE}, l AS (SELECT task_id, arg_max(status, (ts, stage, status)) AS status FROM stage GROUP BY task_id) SELECT task_id, status = 'failed' AND task_id::INT % 2 = 0 AS retry, CASE WHEN status <> 'failed' THEN 'not_failed' WHEN task_id::INT % 2 <> 0 THEN 'not_allowed' END AS reason FROM l""")
def retry_plan(spark: SparkSession, d: str) -> DataFrame:
    states = E.latest_state(stage_rows(spark, d))
    return C.retry_plan(states, states.where("cast(task_id AS int) % 2 = 0").select("task_id"))


_CONFIG = {"audio": "16k", "asr": "small", "translation": "standard", "quality": "v1"}


@query("j28_c06_c07_plan", "SELECT 'skip' AS category, CAST(NULL AS VARCHAR) AS first_stage, count(*) FILTER (WHERE p_partkey % 4 = 0) AS n FROM part UNION ALL SELECT 'reuse', 'asr', count(*) FILTER (WHERE p_partkey % 4 = 1) FROM part UNION ALL SELECT 'rebuild', 'input', count(*) FILTER (WHERE p_partkey % 4 = 2) FROM part UNION ALL SELECT 'new', 'input', count(*) FILTER (WHERE p_partkey % 4 = 3) FROM part")
def plan(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files: a quarter each complete, of an older model, changed, and new."""
    files = table(spark, d, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("fingerprint"))
    k = F.col("task_id") % 4
    now = C.signatures(files, _CONFIG)
    same = C.signatures(files.where(k == 0), _CONFIG)
    older = C.signatures(files.where(k == 1), _CONFIG | {"asr": "tiny"})
    changed = C.signatures(files.where(k == 2).withColumn("fingerprint", F.upper("fingerprint")), _CONFIG)
    states = same.unionByName(older).unionByName(changed).withColumn("status", F.lit("completed"))
    return C.plan(now, states).groupBy("category", "first_stage").agg(F.count("*").alias("n"))


@query("c08_t26_task_identity", "SELECT c_custkey, c_name || '-' || left(sha256(lower('in/' || c_name || '.mp4')), 12) AS task FROM customer")
def task_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", C.task_identity(F.concat(F.lit("in/"), "c_name", F.lit(".mp4"))).alias("task"))


@query("j27_contract", "SELECT n_name AS scenario, r_name AS profile, left(sha256(n_name || ':' || r_name), 12) AS run_id FROM nation, region")
def contract(spark: SparkSession, d: str) -> DataFrame:
    return C.contract(table(spark, d, "nation").select(F.col("n_name").alias("scenario")), table(spark, d, "region").select(F.col("r_name").alias("profile")))


@query("j26_s29_coverage", "SELECT left(sha256(n_name || ':' || r_name), 12) AS run_id, 'missing' AS problem FROM nation, region WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'x' || r_regionkey, 'unexpected' FROM region")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    profiles = region.select(F.col("r_name").alias("profile"))
    every = C.contract(nation.select(F.col("n_name").alias("scenario")), profiles)
    found = C.contract(nation.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("scenario")), profiles)
    odd = region.select(F.concat(F.lit("x"), F.col("r_regionkey").cast("string")).alias("run_id"))
    return C.coverage(every, found.select("run_id").union(odd))


@query("e03_j24_j25_c05_config_difference", "SELECT p_name || p_partkey AS name, p_brand AS left_value, CASE WHEN p_size % 5 = 0 THEN p_type WHEN p_size % 5 = 1 THEN NULL ELSE p_brand END AS right_value FROM part WHERE p_size % 5 < 2")
def config_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("value"), "p_type", "p_size")
    right = rows.where("p_size % 5 <> 1").select("name", F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(F.col("value")).alias("value"))
    return C.config_difference(rows.select("name", "value"), right)


@query("j34_j35_c02_resolve", "SELECT * FROM (VALUES ('beam', '5', 'default'), ('mode', 'fast', 'layer_1'), ('model', 'large', 'layer_2')) t(name, value, origin)")
def resolve(spark: SparkSession, d: str) -> DataFrame:
    layer = lambda rows: spark.createDataFrame(rows, "name string, value string")
    return C.resolve({"beam": "5", "mode": "slow", "model": "tiny"}, layer([("mode", "fast"), ("model", "small")]), layer([("model", "large"), ("mode", None)]))


@query("j32_c12_merge_profiles", "SELECT n_name AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'mine' ELSE r_name END AS value, CASE WHEN n_nationkey % 3 = 0 THEN 'local' ELSE 'builtin' END AS origin FROM nation JOIN region ON n_regionkey = r_regionkey")
def merge_profiles(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    builtin = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("r_name").alias("value"))
    return C.merge_profiles(builtin, nation.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("id"), F.lit("mine").alias("value")))


@query("j30_j31_s37_pairs", "SELECT 'clip' || p_partkey % 500 AS base, count(*) AS n, array_to_string(list_sort(list_distinct(list(CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'zh' END))), ',') AS languages FROM part GROUP BY 1")
def pairs(spark: SparkSession, d: str) -> DataFrame:
    language = F.when(F.col("p_partkey") % 2 == 0, ".en").otherwise("_zh")
    path = F.concat(F.lit("/media/Clip"), (F.col("p_partkey") % 500).cast("string"), language, F.lit(".srt"))
    return C.pair_by_stem(table(spark, d, "part").select(path.alias("path")))


@query("j33_e02_terms", "SELECT lower(p_brand) AS source, CASE WHEN min(p_size) <= 5 THEN 'profile' ELSE 'dynamic' END AS origin, CASE WHEN min(p_size) <= 5 THEN min(p_type) FILTER (WHERE p_size <= 5) ELSE min(p_type) END AS target FROM part GROUP BY 1")
def terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.concat(F.lit(" "), "p_brand").alias("source"), F.col("p_type").alias("target"), F.when(F.col("p_size") <= 5, "profile").otherwise("dynamic").alias("origin"), F.lit("high").alias("confidence"))
    return C.best_terms(rows)


@query("k17_cached_translate", f"{_C} SELECT media_id, CASE WHEN media_id % 4 = 0 THEN 'cache' ELSE 'model' END AS origin, array_to_string(list(CASE WHEN media_id % 4 = 0 THEN role ELSE 'b a ' || pos END ORDER BY pos), '|') AS translations FROM cues GROUP BY media_id")
def translate(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model turns words round; a quarter of the batches is cached."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("x")))), lambda s: s["x"])
    rows = cues(spark, d).groupBy(F.col("media_id").alias("key")).agg(ordered(F.concat(F.col("pos").cast("string"), F.lit(" a b"))).alias("texts"), ordered(F.col("role")).alias("roles"))
    cache = rows.where("key % 4 = 0").select("key", F.col("roles").alias("translations"))
    out = C.translate(rows.select("key", "texts"), C.stub_translator, cache)
    return out.select(F.col("key").alias("media_id"), "origin", F.array_join("translations", "|").alias("translations"))


@query("u12_request_body", """SELECT conv_id, '{"model":"stub","temperature":0.2,"messages":[{"role":"system","content":"translate"},{"role":"user","content":"[' || string_agg('\\"' || role || '\\"', ',' ORDER BY role) || ']"}]}' AS body FROM conversations GROUP BY conv_id""")
def request_body(spark: SparkSession, d: str) -> DataFrame:
    from cuelake.functions.structured import request_body as body

    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("texts"))
    return rows.select("conv_id", body("stub", F.lit("translate"), F.col("texts")).alias("body"))


@query("f32_immutable", f"{_C} SELECT media_id, pos, start_ms, 'changed' AS problem FROM cues WHERE pos % 6 = 0")
def immutable(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).select("media_id", "pos", "start_ms")
    changed = rows.withColumn("start_ms", F.when(F.col("pos") % 6 == 0, F.col("start_ms") + 1).otherwise(F.col("start_ms")))
    return rows.exceptAll(changed).withColumn("problem", F.lit("changed"))


@query("f32_altered", f"""{_C} SELECT media_id, pos, start_ms, text, 'before' AS side FROM cues WHERE length(text) % 5 = 0 AND pos <> 2 UNION ALL SELECT media_id, pos, start_ms, replace(text, chr(10), ' ') || '.', 'after' FROM cues WHERE length(text) % 5 = 0
UNION ALL SELECT media_id, pos, start_ms, text, 'after' FROM cues WHERE pos = 2 AND length(text) % 5 <> 0""")
def altered(spark: SparkSession, d: str) -> DataFrame:
    """Records that a stage was to leave alone: a fifth of the texts changed, and a recording's second cue there twice."""
    rows = kept(cues(spark, d))  # three tracks are made of it, which one task would read together otherwise
    text = F.when(F.length("text") % 5 == 0, F.concat(F.translate("text", "\n", " "), F.lit("."))).otherwise(F.col("text"))
    after = rows.withColumn("text", text).unionByName(rows.where("pos = 2"))
    return C.altered(rows, after, ["media_id", "pos", "start_ms", "text"])


_LANGUAGES = {"fr": "french", "de": "german", "es": "spanish", "zh": "chinese"}


@query("s37_collected", r"""WITH f AS (SELECT doc_id, 'films/' || source || '/' || CASE doc_id % 7 WHEN 0 THEN 'Space Love ' WHEN 1 THEN 'My Doc ' ELSE 'Film ' END || doc_id // 3 || '.' || CASE WHEN doc_id % 11 = 0 THEN 'EN' ELSE coalesce(lang, 'xx') END || CASE WHEN doc_id % 13 = 0 THEN '.txt' ELSE '.srt' END AS path FROM documents),
n AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM f WHERE path LIKE '%.srt'),
r AS (SELECT *, regexp_replace(name, '(?i)\.([a-z]{2,6})\.(srt|ass|ssa|sub)$', '') AS base, lower(regexp_extract(name, '(?i)\.([a-z]{2,6})\.srt$', 1)) AS code FROM n),
t AS (SELECT path, base, name, CASE code WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' WHEN 'zh' THEN 'chinese' END AS language, CASE WHEN contains(lower(name), 'space') THEN 'scifi' WHEN contains(lower(name), 'love') THEN 'romance' WHEN contains(lower(name), 'doc') THEN 'documentary' ELSE 'drama' END AS genre FROM r WHERE code IN ('fr', 'de', 'es', 'zh')),
p AS (SELECT *, language || '/' || genre || '/' || name AS place FROM t),
s AS (SELECT base, string_agg(DISTINCT name, ',' ORDER BY name) AS sources FROM r WHERE code = 'en' GROUP BY base)
SELECT path, p.base, name, language, genre, place, row_number() OVER (PARTITION BY place ORDER BY path) = 1 AND language IN ('french', 'spanish') AS taken, sources FROM p LEFT JOIN s USING (base)""")
def collected(spark: SparkSession, d: str) -> DataFrame:
    """Documents as subtitle files, with their languages as suffixes."""
    k = F.col("doc_id")
    title = F.when(k % 7 == 0, "Space Love ").when(k % 7 == 1, "My Doc ").otherwise("Film ")
    code = F.when(k % 11 == 0, "EN").otherwise(F.coalesce("lang", F.lit("xx")))
    path = F.concat(F.lit("films/"), "source", F.lit("/"), title, F.floor(k / 3).cast("string"), F.lit("."), code, F.when(k % 13 == 0, ".txt").otherwise(".srt"))
    return C.collected(table(spark, d, "documents").select(path.alias("path")), _LANGUAGES, ["French", "spanish"], "drama")


@query("a24_a25_consensus")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    """Of all texts of a scene, whole, the one most like the others."""
    from cuelake.operators.sequences import scenes

    return A.consensus(scenes(cues(spark, d)), ["media_id", "scene"])
