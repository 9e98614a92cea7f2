"""Queries of rules, sessions, folds and metrics over one track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.bridge import CUES_SQL, cues, table
from cuelake.functions import text as T
from cuelake.operators import intervals as J
from cuelake.operators import metrics as A
from cuelake.operators import rules as R
from cuelake.operators import sequences as W
from cuelake.queries.registry import query

_C = f"WITH {CUES_SQL} "
_ACCENT = r"[À-ÖØ-öø-ÿ]"
#: Stand-ins for scripts that the tables lack, for the rules by script.
_SCRIPTS = {"french": r"[çœÇŒêÊ]", "german": r"[äöüßÄÖÜ]", "spanish": r"[ñÑ¿¡]"}

_ISSUE = {
    "overlap": "SELECT media_id, pos, 'time_overlap' AS type, 'warning' AS severity, (end_ms - nxt)::VARCHAR AS detail FROM (SELECT *, lead(start_ms) OVER (PARTITION BY media_id ORDER BY pos) AS nxt FROM cues) WHERE end_ms > nxt",
    "empty": "SELECT media_id, pos, 'empty_subtitle' AS type, 'error' AS severity, '' AS detail FROM cues WHERE trim(coalesce(text, '')) = ''",
    "long": """SELECT media_id, pos, CASE WHEN m > 80 THEN 'line_too_long' ELSE 'subtitle_too_long' END AS type, CASE WHEN m > 80 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN m > 80 THEN m ELSE length(text) END::VARCHAR AS detail
  FROM (SELECT *, list_max(list_transform(string_split(text, chr(10)), lambda x: length(trim(x)))) AS m FROM cues) WHERE m > 80 OR length(text) > 160""",
    "short": "SELECT media_id, pos, 'too_short' AS type, 'info' AS severity, (end_ms - start_ms)::VARCHAR AS detail FROM cues WHERE end_ms - start_ms < 500 AND trim(text) <> ''",
    "time": "SELECT media_id, pos, 'broken_timestamp' AS type, 'error' AS severity, start_ms || '-' || end_ms AS detail FROM cues WHERE start_ms >= end_ms",
    "runs": """SELECT media_id, min(pos) AS pos, 'duplicate' AS type, 'warning' AS severity, count(*)::VARCHAR AS detail FROM (
  SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN trim(text) = lag(trim(text)) OVER (PARTITION BY media_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM cues)) GROUP BY media_id, run HAVING count(*) >= 2""",
}
_SOURCE = " UNION ALL ".join(_ISSUE.values())


@query("f01_e05_source_report", f"{_C} {_SOURCE}")
def source_report(spark: SparkSession, d: str) -> DataFrame:
    return R.source_report(cues(spark, d))


@query("f05_time_overlap", f"{_C} {_ISSUE['overlap']}")
def time_overlap(spark: SparkSession, d: str) -> DataFrame:
    return R.check(cues(spark, d), [R.time_overlap()])


@query("f03_f06_empty", f"WITH {CUES_SQL.replace('role, text, start_ms', 'role, CASE WHEN (media_id + pos) % 13 = 0 THEN ' + chr(39) + ' ' + chr(39) + ' ELSE text END AS text, start_ms')} {_ISSUE['empty']}")
def empty(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).withColumn("text", F.when((F.col("media_id") + F.col("pos")) % 13 == 0, " ").otherwise(F.col("text")))
    return R.check(rows, [R.empty()])


@query("f04_numbering", f"{_C} SELECT media_id, pos, 'broken_numbering' AS type, 'error' AS severity, (turn + 1 + turn // 5) || '/' || pos AS detail FROM cues WHERE turn + 1 + turn // 5 <> pos")
def numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).withColumn("number", F.col("turn") + 1 + F.floor(F.col("turn") / 5))
    return R.check(rows, [R.numbering()])


@query("f07_too_long", f"{_C} {_ISSUE['long']}")
def too_long(spark: SparkSession, d: str) -> DataFrame:
    return R.check(cues(spark, d), R.too_long())


@query("f08_too_short", f"{_C} {_ISSUE['short']}")
def too_short(spark: SparkSession, d: str) -> DataFrame:
    return R.check(cues(spark, d), [R.too_short()])


@query("f09_duplicate_runs", f"""{_C} SELECT media_id, min(pos) AS pos, 'duplicate' AS type, 'warning' AS severity, count(*)::VARCHAR AS detail FROM cues GROUP BY media_id, pos // 3 HAVING count(*) >= 2""")
def duplicate_runs(spark: SparkSession, d: str) -> DataFrame:
    """Three cues in a row have one text, blanks around it aside."""
    return R.duplicate_runs(cues(spark, d).withColumn("text", F.concat(F.lit("line "), F.floor(F.col("pos") / 3).cast("string"), F.when(F.col("pos") % 2 == 0, "  ").otherwise(""))))


@query("f09_near_duplicates", f"{_C} SELECT media_id, pos, 'near_duplicate' AS type, 'info' AS severity, '0.96' AS detail FROM cues WHERE pos % 2 = 0")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Two cues have one text, of 25 letters and digits; the next two differ in its last: 48 of 50 match."""
    return R.near_duplicates(cues(spark, d).withColumn("text", F.concat(F.lit("The very same sentence again "), (F.floor(F.col("pos") / 2) % 10).cast("string"))))


#: Each third cue says again what the one before said, with blanks behind it, or a letter more where the recording's number is even.
_ECHOED = """echoed AS (SELECT media_id, pos, start_ms, end_ms, CASE WHEN pos % 3 = 2 THEN lag(text) OVER (PARTITION BY media_id ORDER BY pos) || CASE WHEN media_id % 2 = 0 THEN 'x' ELSE '  ' END ELSE text END AS text FROM cues)"""


def echoed(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    before = F.lag("text").over(Window.partitionBy("media_id").orderBy("pos"))
    return rows.withColumn("text", F.when(F.col("pos") % 3 == 2, F.concat(before, F.when(F.col("media_id") % 2 == 0, "x").otherwise("  "))).otherwise(F.col("text")))


@query("f09_duplicate_runs_of_cues", f"{_C[:-1]}, {_ECHOED} {_ISSUE['runs'].replace('FROM cues', 'FROM echoed')}")
def duplicate_runs_of_cues(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, some of them said again."""
    return R.duplicate_runs(echoed(spark, d))


_LETTERS = r"regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query("f09_near_duplicates_of_cues", f"""{_C[:-1]}, {_ECHOED},
n AS (SELECT *, {_LETTERS.format('text')} AS b, {_LETTERS.format('was')} AS a FROM (SELECT *, lag(text) OVER (PARTITION BY media_id ORDER BY pos) AS was FROM echoed)),
r AS (SELECT media_id, pos, CASE WHEN starts_with(b, a) THEN round(2.0::DOUBLE * length(a) / (length(a) + length(b)), 4) ELSE 0 END AS ratio FROM n WHERE length(a) >= 8 AND length(b) >= 8 AND trim(was) <> trim(text))
SELECT media_id, pos, 'near_duplicate' AS type, 'info' AS severity, ratio::VARCHAR AS detail FROM r WHERE ratio >= 0.92""")
def near_duplicates_of_cues(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, some of them said again with a letter more; others are not alike."""
    return R.near_duplicates(echoed(spark, d))


@query("f10_broken_time", f"WITH {CUES_SQL}, b AS (SELECT media_id, pos, start_ms, CASE WHEN pos % 7 = 0 THEN start_ms ELSE end_ms END AS end_ms FROM cues) SELECT media_id, pos, 'broken_timestamp' AS type, 'error' AS severity, start_ms || '-' || end_ms AS detail FROM b WHERE start_ms >= end_ms")
def broken_time(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).withColumn("end_ms", F.when(F.col("pos") % 7 == 0, F.col("start_ms")).otherwise(F.col("end_ms")))
    return R.check(rows, [R.broken_time()])


#: Texts and what of them is a model's own words, by hand.
_WORDS = [
    ("Here is the Translation you asked for: yes", "Here is the Translation"), ("I cannot come tonight.", None), ("I'm sorry, here we are.", None), ("well, I have translated it", "I have translated"), ("```\nyes", "```"), ("Sure! here are the subtitles", "Sure! here are the subtitle"),
    ("好的，以下是字幕：走吧", "好的，以下是字幕"), ("好的，我们走吧。", None), ("她说：翻译如下 走", "翻译如下"), ("我来帮你把这句翻译", "我来帮你把这句翻译"), ("Translation: no", None), ("where is the subtitle", None),
]
_SAID = ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for _, w in _WORDS)


@query("f11_boilerplate", f"{_C} SELECT media_id, pos, 'llm_boilerplate' AS type, 'error' AS severity, [{_SAID}][pos % {len(_WORDS)} + 1] AS detail FROM cues WHERE [{_SAID}][pos % {len(_WORDS)} + 1] IS NOT NULL")
def boilerplate(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array(*[F.lit(t) for t, _ in _WORDS])
    return R.check(cues(spark, d).withColumn("text", F.element_at(texts, (F.col("pos") % len(_WORDS) + 1).cast("int"))), [R.boilerplate()])


_FOREIGN = "CASE " + " ".join(f"WHEN len(regexp_extract_all(text, '{p}')) >= 3 THEN '{n}'" for n, p in _SCRIPTS.items()) + " END"


@query("f12_foreign_script", f"{_C} SELECT media_id, pos, 'possibly_untranslated' AS type, 'warning' AS severity, {_FOREIGN} AS detail FROM cues WHERE {_FOREIGN} IS NOT NULL")
def foreign_script(spark: SparkSession, d: str) -> DataFrame:
    return R.check(cues(spark, d), [R.foreign_script(_SCRIPTS)])


@query("f13_reading_speed", f"""WITH {CUES_SQL}, n AS (SELECT *, len(regexp_extract_all(text, '{_ACCENT}')) AS n, list_max(list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '{_ACCENT}')))) AS m FROM cues)
SELECT media_id, pos, 'reading_too_fast' AS type, 'warning' AS severity, n::VARCHAR AS detail FROM n WHERE n > 0 AND end_ms > start_ms AND n * 1000 > (end_ms - start_ms) * 9
UNION ALL SELECT media_id, pos, 'target_line_too_long', 'warning', m::VARCHAR FROM n WHERE m > 18 UNION ALL SELECT media_id, pos, 'target_too_long', 'warning', n::VARCHAR FROM n WHERE n > 36""")
def reading_speed(spark: SparkSession, d: str) -> DataFrame:
    return R.check(cues(spark, d), R.reading_speed(_ACCENT, 9, 18, 36))


@query("f14_mixed_script", f"""WITH {CUES_SQL}, n AS (SELECT *, len(regexp_extract_all(text, '{_ACCENT}')) AS a, len(regexp_extract_all(text, '[A-Za-z]')) AS b FROM cues)
SELECT media_id, pos, 'mixed_language' AS type, 'warning' AS severity, a || '/' || b AS detail FROM n WHERE b > a AND b > 20 AND a + b > 10 AND a > 0""")
def mixed_script(spark: SparkSession, d: str) -> DataFrame:
    return R.check(cues(spark, d), [R.mixed_script(_ACCENT, "[A-Za-z]")])


@query("f15_foreign_terms", f"""{_C} SELECT media_id, pos, 'foreign_terms' AS type, 'info' AS severity, array_to_string(list_sort(f), ',') AS detail FROM (
  SELECT *, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{{6,}}'), lambda x: lower(x))) AS f FROM cues) WHERE regexp_matches(text, '{_ACCENT}') AND len(f) > 0""")
def foreign_terms(spark: SparkSession, d: str) -> DataFrame:
    return R.check(cues(spark, d), [R.foreign_terms(_ACCENT)])


@query("f02_translation_report", f"{_C} {_ISSUE['overlap']} UNION ALL {_ISSUE['long']} UNION ALL SELECT media_id, pos, 'possibly_untranslated', 'warning', {_FOREIGN} FROM cues WHERE {_FOREIGN} IS NOT NULL")
def translation_report(spark: SparkSession, d: str) -> DataFrame:
    return R.translation_report(cues(spark, d), T.HAN, _SCRIPTS)


_A01 = f"SELECT media_id, count(*) FILTER (WHERE severity = 'error') AS n_error, count(*) FILTER (WHERE severity = 'warning') AS n_warning, count(*) FILTER (WHERE severity = 'info') AS n_info FROM ({_SOURCE}) GROUP BY media_id"


@query("a01_m23_summary", f"{_C} SELECT *, CASE WHEN n_error > 0 THEN 'fail' WHEN n_warning > 0 THEN 'warning' ELSE 'pass' END AS status FROM ({_A01})")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return R.summary(R.source_report(cues(spark, d)))


@query("a30_by_type", f"{_C} SELECT severity, type, count(*) AS n FROM ({_SOURCE}) GROUP BY GROUPING SETS ((severity, type), (severity), ())")
def by_type(spark: SparkSession, d: str) -> DataFrame:
    return R.by_type(R.source_report(cues(spark, d)))


_PLAIN = r"regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g')"
_SUSPECT = rf"suspect AS (SELECT *, logprob_milli < -1000 OR compression_milli > 2400 OR (silence_milli > 600 AND trim(text) <> '') OR coalesce(p = lag(p) OVER (PARTITION BY media_id ORDER BY pos) AND p <> '', false) AS suspicious FROM (SELECT *, {_PLAIN} AS p FROM cues))"


@query("f17_f18_suspicious", f"WITH {CUES_SQL}, {_SUSPECT} SELECT media_id, pos FROM suspect WHERE suspicious")
def suspicious(spark: SparkSession, d: str) -> DataFrame:
    return R.suspicious(cues(spark, d)).where("suspicious").select("media_id", "pos")


@query("f19_invalid_strict", f"""{_C} SELECT media_id, pos, code FROM (SELECT media_id, pos, CASE WHEN start_ms < 0 THEN 'negative' WHEN end_ms <= start_ms THEN 'not_positive' WHEN start_ms < lag(end_ms) OVER (PARTITION BY media_id ORDER BY pos) THEN 'overlap' END AS code FROM cues) WHERE code IS NOT NULL""")
def invalid_strict(spark: SparkSession, d: str) -> DataFrame:
    return R.invalid_strict(cues(spark, d))


@query("f20_invalid_monotonic", f"""{_C} SELECT media_id, pos, code FROM (SELECT media_id, pos, CASE WHEN end_ms <= start_ms THEN 'not_positive' WHEN start_ms < lag(start_ms) OVER (PARTITION BY media_id ORDER BY pos) THEN 'not_rising' WHEN end_ms > 20500 THEN 'beyond_media' END AS code FROM cues) WHERE code IS NOT NULL""")
def invalid_monotonic(spark: SparkSession, d: str) -> DataFrame:
    return R.invalid_monotonic(cues(spark, d), 20_000)


@query("f33_cross_line", rf"""{_C} SELECT media_id, pos - 1 AS first_pos, pos AS last_pos FROM (SELECT *, lag(regexp_replace(text, '[.!?]+$', '')) OVER (PARTITION BY media_id ORDER BY pos) AS was FROM cues)
WHERE NOT regexp_matches(was, '[.!?…。！？]["''”’)]*[\t\n\f\r ]*$') AND regexp_matches(lower(text), '^[\t\n\f\r ]*\p{{Ll}}')""")
def cross_line(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).withColumn("text", F.lower(F.regexp_replace("text", r"[.!?]+$", "")))
    return R.cross_line_windows(rows)


@query("f23_bilingual", f"""{_C} SELECT media_id, avg(two) AS two_lines, avg(both_) AS both_scripts, avg(two) >= 0.6 AND avg(both_) >= 0.3 AS bilingual FROM (
  SELECT media_id, (len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) = 2)::INT AS two, (regexp_matches(text, '{_ACCENT}') AND regexp_matches(text, '[A-Za-z]'))::INT AS both_ FROM cues) GROUP BY media_id""")
def bilingual(spark: SparkSession, d: str) -> DataFrame:
    return R.is_bilingual(cues(spark, d), _ACCENT, "[A-Za-z]")


@query("w01_scenes", f"""{_C} SELECT media_id, pos, CAST(sum(new) OVER (PARTITION BY media_id ORDER BY pos) AS BIGINT) AS scene FROM (
  SELECT media_id, pos, CASE WHEN pos = 1 OR start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY pos) >= 30000 THEN 1 ELSE 0 END AS new FROM cues)""")
def scenes(spark: SparkSession, d: str) -> DataFrame:
    return W.scenes(cues(spark, d)).select("media_id", "pos", "scene")


def _islands(gap: int, source: str = "cues") -> str:
    return f"""SELECT media_id, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (
    SELECT *, CASE WHEN start_ms > max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 WHEN row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms) = 1 THEN 1 ELSE 0 END AS new
    FROM (SELECT media_id, greatest(start_ms, 0) AS start_ms, end_ms FROM {source}) WHERE end_ms > start_ms)) GROUP BY media_id, island"""


@query("w02_islands", f"{_C} {_islands(250)}")
def islands(spark: SparkSession, d: str) -> DataFrame:
    return J.islands(cues(spark, d), 250)


@query("a20_union_length", f"{_C} SELECT media_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS covered_ms FROM ({_islands(0)}) GROUP BY media_id")
def union_length(spark: SparkSession, d: str) -> DataFrame:
    return J.union_length(cues(spark, d))


@query("w02_gaps", f"{_C} SELECT * FROM (SELECT media_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms) AS end_ms FROM ({_islands(0)})) WHERE end_ms - start_ms > 400")
def gaps(spark: SparkSession, d: str) -> DataFrame:
    return J.gaps(cues(spark, d), 400)


@query("w03_split_at_gaps", f"""WITH RECURSIVE {CUES_SQL}, g AS (SELECT media_id, pos, start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY pos) AS gap FROM cues),
s AS (SELECT media_id, 1::BIGINT AS a, max(pos)::BIGINT AS b FROM cues GROUP BY media_id
  UNION ALL SELECT media_id, CASE h WHEN 0 THEN a ELSE cut END, CASE h WHEN 0 THEN cut - 1 ELSE b END FROM (
    SELECT s.media_id, a, b, arg_max(g.pos, (gap, -abs(g.pos - a - (b - a + 1) / 2::DOUBLE), -g.pos)) AS cut FROM s JOIN g ON g.media_id = s.media_id AND g.pos - a BETWEEN 1 AND b - a WHERE b - a + 1 > 3 GROUP BY s.media_id, a, b), (VALUES (0), (1)) v(h))
SELECT media_id, pos, part FROM g JOIN (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY a) - 1 AS part FROM s WHERE b - a + 1 <= 3) p USING (media_id) WHERE pos BETWEEN a AND b""")
def split_at_gaps(spark: SparkSession, d: str) -> DataFrame:
    return W.split_at_largest_gaps(cues(spark, d), 3).select("media_id", "pos", "part")


@query("w04_repair_windows", f"""WITH {CUES_SQL}, f AS (SELECT c.media_id, greatest(1, pos - 1) AS a, least(n, pos + 1) AS b FROM cues c JOIN (SELECT media_id, max(pos) AS n FROM cues GROUP BY media_id) USING (media_id) WHERE (c.media_id + pos) % 5 = 0),
g AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS w FROM (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY media_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 WHEN row_number() OVER (PARTITION BY media_id ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS new FROM f))
SELECT media_id, min(a) AS first_pos, max(b) AS last_pos, count(*) AS n_flagged FROM g GROUP BY media_id, w""")
def repair_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    flagged = rows.where((F.col("media_id") + F.col("pos")) % 5 == 0).select("media_id", "pos")
    return W.repair_windows(flagged, rows.groupBy("media_id").agg(F.max("pos").alias("n")))


@query("w05_w21_retry_spans", f"""WITH {CUES_SQL}, {_SUSPECT} SELECT media_id, pos, s AS start_ms, e AS end_ms FROM (
  SELECT media_id, pos, suspicious, greatest(0, coalesce(lag(start_ms) OVER w, start_ms) - 500) AS s, coalesce(lead(end_ms) OVER w, end_ms) + 500 AS e FROM suspect WINDOW w AS (PARTITION BY media_id ORDER BY pos)) WHERE suspicious""")
def retry_spans(spark: SparkSession, d: str) -> DataFrame:
    return W.retry_spans(R.suspicious(cues(spark, d)), F.col("suspicious"))


@query("w06_boundary_duplicates")
def boundary_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).withColumn("text", F.concat(F.lit("line "), F.floor(F.col("turn") / 2).cast("string")))
    return W.drop_boundary_duplicates(rows).select("media_id", "pos", "text", "start_ms", "end_ms")


@query("w07_w08_merge_similar")
def merge_similar(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).withColumn("text", F.concat(F.lit("line "), F.floor(F.col("turn") / 2).cast("string")))
    return W.merge_similar(rows).select("media_id", "pos", "text", "start_ms", "end_ms")


@query("w09_equal_runs", f"""{_C} SELECT media_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
  SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN turn // 2 = lag(turn // 2) OVER (PARTITION BY media_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM cues)) GROUP BY media_id, run""")
def equal_runs(spark: SparkSession, d: str) -> DataFrame:
    return W.equal_runs(cues(spark, d), F.floor(F.col("turn") / 2))


@query("w10_merge_segments", f"""WITH RECURSIVE {CUES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, pos) AS k FROM cues),
f AS (SELECT media_id, k, 1 AS n, start_ms AS s, end_ms AS e, length(text) AS l FROM o WHERE k = 1
  UNION ALL SELECT o.media_id, o.k, CASE WHEN joins THEN n ELSE n + 1 END, CASE WHEN joins THEN s ELSE o.start_ms END, CASE WHEN joins THEN greatest(e, o.end_ms) ELSE o.end_ms END, CASE WHEN joins THEN l + 1 + length(o.text) ELSE length(o.text) END
  FROM (SELECT f.*, o.k AS next, o.start_ms - e <= 2000 AND o.end_ms - s <= 15000 AS joins FROM f JOIN o ON o.media_id = f.media_id AND o.k = f.k + 1) f JOIN o ON o.media_id = f.media_id AND o.k = f.next)
SELECT media_id, n::BIGINT AS pos, arg_max(s, k) AS start_ms, arg_max(e, k) AS end_ms, arg_max(l, k) AS length FROM f GROUP BY media_id, n HAVING arg_max(e, k) - arg_max(s, k) >= 3000""")
def merge_segments(spark: SparkSession, d: str) -> DataFrame:
    return W.merge_segments(cues(spark, d)).select("media_id", "pos", "start_ms", "end_ms", F.length("text").alias("length"))


@query("w11_u13_speech_blocks", f"""WITH RECURSIVE {CUES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms) AS k FROM cues), t AS (SELECT media_id, max(end_ms) AS total FROM cues GROUP BY media_id),
f AS (SELECT media_id, k, 0 AS n, start_ms AS s, end_ms AS e, end_ms - start_ms AS ms FROM o WHERE k = 1
  UNION ALL SELECT media_id, next, n + closes::INT, CASE WHEN closes THEN a ELSE s END, CASE WHEN closes THEN b ELSE greatest(e, b) END, CASE WHEN closes THEN b - a ELSE ms + b - a END
  FROM (SELECT f.*, o.k AS next, o.start_ms AS a, o.end_ms AS b, o.start_ms - e >= 8000 OR o.end_ms - s > 60000 OR ms + o.end_ms - o.start_ms > 60000 OR ms >= 45000 AS closes FROM f JOIN o ON o.media_id = f.media_id AND o.k = f.k + 1))
SELECT media_id, n AS block, greatest(0, arg_max(s, k) - 800) AS start_ms, least(any_value(total), arg_max(e, k) + 800) AS end_ms, arg_max(ms, k) AS speech_ms FROM f JOIN t USING (media_id) GROUP BY media_id, n""")
def speech_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    return W.speech_blocks(rows.join(rows.groupBy("media_id").agg(F.max("end_ms").alias("total_ms")), "media_id"))


_ENDS = "ms >= 6500 OR units >= 176 OR (ms >= 700 AND (units * 250 > 12 * ms OR regexp_matches(word, '[。！？!?.]$'))) OR (ms >= 4500 AND regexp_matches(word, '[，,;；:：]$'))"


@query("w12_w13_w14_resegment", rf"""WITH RECURSIVE {CUES_SQL}, tokens AS (SELECT media_id, pos, start_ms, end_ms, len(w) AS n, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), lambda x: x <> '') AS w FROM cues)),
timed AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY pos, k) AS i, word, start_ms + (k - 1) * greatest(1, (end_ms - start_ms) // n) AS s, start_ms + k * greatest(1, (end_ms - start_ms) // n) AS e FROM tokens),
fold AS (SELECT media_id, i, 1 AS cue, word AS text, s, e, false AS closed FROM timed WHERE i = 1
  UNION ALL
  SELECT media_id, i, cue, text, s, e, NOT first AND ({_ENDS}) FROM (SELECT *, greatest(1, e - s) AS ms, (len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]')) + len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'))) * 2 + len(regexp_extract_all(text, '[^\p{{L}}\p{{N}} ]')) AS units FROM (
    SELECT f.media_id, t.i, f.cue + f.closed::INT AS cue, t.word, CASE WHEN f.closed THEN t.word WHEN regexp_matches(t.word, '^[,.;:!?)\]}}]') THEN f.text || t.word ELSE f.text || ' ' || t.word END AS text, CASE WHEN f.closed THEN t.s ELSE f.s END AS s, t.e, f.closed AS first FROM fold f JOIN timed t ON t.media_id = f.media_id AND t.i = f.i + 1))),
made AS (SELECT media_id, cue AS pos, arg_max(text, i) AS text, arg_max(s, i) AS start_ms, greatest(arg_max(s, i) + 1, arg_max(e, i)) AS end_ms FROM fold GROUP BY ALL),
checked AS (SELECT media_id, CASE WHEN count(*) FILTER (WHERE end_ms <= start_ms OR start_ms < 0) > 0 THEN 'invalid_timestamps' WHEN count(*) FILTER (WHERE start_ms < before) > 0 THEN 'overlap' END AS fallback
  FROM (SELECT *, max(end_ms) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM made) GROUP BY media_id)
SELECT media_id, pos, text, start_ms, end_ms, fallback FROM made JOIN checked USING (media_id) WHERE fallback IS NULL UNION ALL SELECT media_id, pos, text, start_ms, end_ms, coalesce(fallback, 'no_word_timestamps') FROM cues LEFT JOIN checked USING (media_id) WHERE fallback IS NOT NULL OR media_id NOT IN (SELECT media_id FROM checked)""")
def resegment(spark: SparkSession, d: str) -> DataFrame:
    """Words get equal shares of their cue's time. Recordings whose cues overlap stay as they are."""
    rows = cues(spark, d)
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    # split and counted before they are dealt out: beside the generator, each word would split its whole text anew
    split = rows.select("media_id", "start_ms", "end_ms", (F.col("pos") * 1_000_000).alias("base"), words.alias("words")).withColumn("n", F.size("words"))
    made = split.select("media_id", "start_ms", "end_ms", "n", "base", F.posexplode("words").alias("k", "word"))
    step = F.greatest(F.lit(1).cast("long"), F.floor((F.col("end_ms") - F.col("start_ms")) / F.col("n")))
    tokens = made.select("media_id", (F.col("base") + F.col("k")).alias("pos"), F.concat(F.lit(" "), "word").alias("text"), (F.col("start_ms") + F.col("k") * step).alias("start_ms"), (F.col("start_ms") + (F.col("k") + 1) * step).alias("end_ms"))
    return W.resegmented(rows, tokens, pause_ms=10**12)


@query("w15_w16_batches", f"""WITH {CUES_SQL}, b AS (SELECT media_id, (pos - 1) // 3 AS batch, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM cues GROUP BY ALL), t AS (SELECT media_id, max(pos) AS top FROM cues GROUP BY media_id)
SELECT media_id, batch, first_pos, last_pos, n, first_pos - greatest(1, first_pos - 2) AS n_before, least(top, last_pos + 2) - last_pos AS n_after FROM b JOIN t USING (media_id)""")
def batches(spark: SparkSession, d: str) -> DataFrame:
    return W.batch_context(cues(spark, d), 3)


@query("w17_w18_context", f"""{_C} SELECT media_id, pos, coalesce(array_to_string(list(role) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS before,
  coalesce(array_to_string(list(role) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ','), '') AS after FROM cues""")
def context(spark: SparkSession, d: str) -> DataFrame:
    rows = W.context(cues(spark, d), column="role")
    return rows.select("media_id", "pos", F.array_join("context_before", ",").alias("before"), F.array_join("context_after", ",").alias("after"))


@query("w19_time_grid", f"{_C} SELECT media_id, s AS start_ms, least(s + 5000, t1) AS end_ms FROM (SELECT media_id, t1, unnest(generate_series(t0, t1 - 1, 5000)) AS s FROM (SELECT media_id, min(start_ms) AS t0, max(end_ms) AS t1 FROM cues GROUP BY media_id) WHERE t1 > t0)")
def time_grid(spark: SparkSession, d: str) -> DataFrame:
    return W.time_grid(cues(spark, d), 5000)


@query("w20_change_midpoints", f"""{_C} SELECT media_id, pos, (start_ms + at_) // 2 AS mid_ms FROM (SELECT *, lead(role) OVER w AS r, lead(start_ms) OVER w AS at_ FROM cues WINDOW w AS (PARTITION BY media_id ORDER BY pos)) WHERE r <> role AND at_ - start_ms > 250""")
def change_midpoints(spark: SparkSession, d: str) -> DataFrame:
    return W.change_midpoints(cues(spark, d), F.col("role"))


@query("a05_segmentation", f"""{_C} SELECT media_id, count(*) FILTER (WHERE d <= 0) AS n_empty, count(*) FILTER (WHERE start_ms < b) AS n_overlap, sum(greatest(0, coalesce(start_ms - b, 0)))::BIGINT AS gap_ms, count(*) FILTER (WHERE d > 0 AND length(text) * 1000 > 20 * d) AS n_fast,
  count(*) FILTER (WHERE list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 42) AS n_long_line, sha256(string_agg(text, chr(10) ORDER BY pos)) AS text_sha256
  FROM (SELECT *, end_ms - start_ms AS d, max(end_ms) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM cues) GROUP BY media_id""")
def segmentation(spark: SparkSession, d: str) -> DataFrame:
    return A.segmentation(cues(spark, d))


@query("a06_a40_basic", f"{_C} SELECT media_id, count(*) AS n, sum(end_ms - start_ms)::BIGINT AS total_ms, avg(end_ms - start_ms) AS mean_ms, min(end_ms - start_ms) AS least_ms, max(end_ms - start_ms) AS most_ms FROM cues GROUP BY media_id")
def basic(spark: SparkSession, d: str) -> DataFrame:
    return A.basic(cues(spark, d))


@query("a07_m08_m09_rhythm", f"""{_C} SELECT media_id, avg(cps) AS mean_cps, max(cps) AS most_cps, quantile_cont(cps, 0.95) AS p95_cps, quantile_cont(cps, 0.5) AS median_cps, avg(k) AS lines, sum(length(text))::DOUBLE / sum(k) AS line_length
  FROM (SELECT *, length(text) * 1000.0::DOUBLE / (end_ms - start_ms) AS cps, len(string_split(text, chr(10))) AS k FROM cues WHERE end_ms > start_ms) GROUP BY media_id""")
def rhythm(spark: SparkSession, d: str) -> DataFrame:
    return A.rhythm(cues(spark, d))


@query("a08_a09_a10_a11_style", r"""SELECT *, CASE WHEN len(t) = 0 THEN 'plain' ELSE array_to_string(t, ',') END AS tags FROM (SELECT *, list_filter([CASE WHEN questions >= 3 THEN 'questioning' END, CASE WHEN exclamations >= 3 THEN 'lively' END, CASE WHEN annotations >= 2 THEN 'annotated' END, CASE WHEN omissions >= 2 THEN 'elliptic' END], lambda x: x IS NOT NULL) AS t FROM (
  SELECT media_id, sum(len(regexp_extract_all(text, '\.\.\.|…')))::BIGINT AS omissions, sum(len(regexp_extract_all(text, '\[[^\]]*\]|\([^)]*\)')))::BIGINT AS annotations, sum(len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Z]{2,}$'))))::BIGINT AS capitals, sum(len(regexp_extract_all(text, '\?')))::BIGINT AS questions, sum(len(regexp_extract_all(text, '!')))::BIGINT AS exclamations
  FROM (SELECT conv_id AS media_id, regexp_replace(text, ', ', '... ', 'g') AS text FROM conversations) GROUP BY media_id))""".replace("SELECT *, CASE WHEN len(t)", "SELECT * EXCLUDE (t), CASE WHEN len(t)"))
def style(spark: SparkSession, d: str) -> DataFrame:
    return A.style_tags(A.style_counts(cues(spark, d).withColumn("text", F.regexp_replace("text", ", ", "... "))))


@query("a12_openings", f"""{_C} SELECT media_id, opening, n, place FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY n DESC, opening) AS place FROM (SELECT media_id, left(text, 3) AS opening, count(*) AS n FROM cues WHERE length(text) >= 3 GROUP BY ALL HAVING count(*) > 1)) WHERE place <= 5""")
def openings(spark: SparkSession, d: str) -> DataFrame:
    return A.openings(cues(spark, d))


@query("a13_repetition", rf"{_C} SELECT media_id, count(DISTINCT w) AS n_distinct, count(*) AS n_words FROM (SELECT media_id, unnest(regexp_extract_all(lower(text), '\p{{L}}{{3,}}')) AS w FROM cues) GROUP BY media_id")
def repetition(spark: SparkSession, d: str) -> DataFrame:
    return A.repetition(cues(spark, d))


@query("a21_a22_duplicate_rate", f"""{_C} SELECT media_id, count(*) FILTER (WHERE again) AS n_again, count(*) AS n, count(*) FILTER (WHERE again)::DOUBLE / count(*) AS share FROM (SELECT media_id, turn // 2 = lag(turn // 2) OVER (PARTITION BY media_id ORDER BY pos) AS again FROM cues) GROUP BY media_id""")
def duplicate_rate(spark: SparkSession, d: str) -> DataFrame:
    return A.adjacent_duplicates(cues(spark, d).withColumn("text", F.floor(F.col("turn") / 2).cast("string")))


@query("a23_containment", f"""{_C} SELECT media_id, count(*) FILTER (WHERE contains(a, b) OR contains(b, a)) AS n FROM (SELECT media_id, a, lag(a) OVER (PARTITION BY media_id ORDER BY pos) AS b FROM (SELECT *, 'cue' || (turn // 3) || repeat('x', (turn % 3)::INT) AS a FROM cues)) WHERE length(a) >= 4 AND length(b) >= 4 GROUP BY media_id""")
def containment(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Cue "), F.floor(F.col("turn") / 3).cast("string"), F.repeat(F.lit("x"), (F.col("turn") % 3).cast("int")))
    return A.adjacent_containment(cues(spark, d).withColumn("text", text))


@query("l10_a32_page", f"{_C} SELECT media_id, pos, text, true AS has_more FROM cues ORDER BY media_id, pos LIMIT 20 OFFSET 40")
def page(spark: SparkSession, d: str) -> DataFrame:
    from cuelake.operators.review import page as one_page

    return one_page(cues(spark, d).select("media_id", "pos", "text"), [F.col("media_id"), F.col("pos")], 40, 20)


@query("a41_m10_m11_median", f"{_C} SELECT role, count(*) AS n, median(length(text)) AS median_length FROM cues GROUP BY role")
def median(spark: SparkSession, d: str) -> DataFrame:
    return cues(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.median(F.length("text")).alias("median_length"))


@query("s01_s02_s10_s11_k01_k03_round_trip", f"""{_C} SELECT media_id, pos, pos AS number, greatest(start_ms, 0) AS start_ms, greatest(end_ms, 0) AS end_ms, text FROM (
  SELECT media_id, pos, start_ms, end_ms, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM cues) WHERE text <> ''""")
def round_trip(spark: SparkSession, d: str) -> DataFrame:
    from cuelake.sources import subtitles

    made = subtitles.render(cues(spark, d).where(F.trim("text") != ""))
    return subtitles.parse(made).select("media_id", "pos", "number", "start_ms", "end_ms", "text")


@query("s05_s06_s08_s09_strict_scan", f"{_C} SELECT media_id, count(*) AS n, count(DISTINCT pos) AS n_numbers FROM cues GROUP BY media_id")
def strict_scan(spark: SparkSession, d: str) -> DataFrame:
    from cuelake.sources import subtitles

    rows = subtitles.last_of_number(subtitles.parse(subtitles.render(cues(spark, d)), subtitles.STRICT))
    return rows.groupBy("media_id").agg(F.count("*").alias("n"), F.countDistinct("number").alias("n_numbers"))


@query("s03_two_line_scan", "SELECT event_id AS media_id, 1 AS pos, event_id AS number, '' AS text FROM events")
def two_line_scan(spark: SparkSession, d: str) -> DataFrame:
    from cuelake.sources import subtitles

    content = F.concat(F.col("event_id").cast("string"), F.lit("\r\n00:00:01,000 --> 00:00:02,000\r\n\r\nnot a block"))
    return subtitles.parse(table(spark, d, "events").select(F.col("event_id").alias("media_id"), content.alias("content")), least_lines=2).select("media_id", "pos", "number", "text")


@query("s40_segments", "SELECT conv_id, count(*) AS n FROM (SELECT conv_id, unnest(regexp_split_to_array(text, '\\.[\\t\\n\\f\\r ]*')) AS s FROM conversations) WHERE trim(s) <> '' GROUP BY conv_id")
def segments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", F.explode(F.split("text", r"\.[\t\n\f\r ]*")).alias("s"))
    return rows.where(F.trim("s") != "").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("k05_review_rows", f"""WITH {CUES_SQL}, i AS ({_SOURCE}) SELECT media_id, pos, row_number() OVER (PARTITION BY media_id ORDER BY pos) AS number, types FROM (SELECT media_id, pos, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM i GROUP BY media_id, pos)""")
def review_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = R.source_report(cues(spark, d)).groupBy("media_id", "pos").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("media_id").orderBy("pos")))
