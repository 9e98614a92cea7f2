"""Queries of the scalar functions: times, texts, similarities, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.bridge import CUES_SQL, cues, table
from cuelake.functions import similarity as S
from cuelake.functions import structured as N
from cuelake.functions import text as T
from cuelake.functions import time as P
from cuelake.queries.registry import query

_C = f"WITH {CUES_SQL} "
_CLOCK = "printf('%02d:%02d:%02d,%03d', ({0}) // 3600000, ({0}) // 60000 % 60, ({0}) // 1000 % 60, ({0}) % 1000)"
_LATIN = r"[À-ÖØ-öø-ÿ]"


@query("p08_p09_p10_p11_p12_format_time", f"{_C} SELECT media_id, pos, {_CLOCK.format('greatest(start_ms, 0)')} || ' --> ' || {_CLOCK.format('greatest(end_ms, 0)')} AS time_line FROM cues")
def format_time(spark: SparkSession, d: str) -> DataFrame:
    return cues(spark, d).select("media_id", "pos", P.time_line(F.col("start_ms"), F.col("end_ms")).alias("time_line"))


@query("p01_p02_p03_p05_parse_time_line", f"{_C} SELECT media_id, pos, greatest(start_ms, 0) AS start_ms, greatest(end_ms, 0) AS end_ms, greatest(end_ms, 0) - greatest(start_ms, 0) AS duration_ms FROM cues")
def parse_time_line(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).select("media_id", "pos", P.time_line(F.col("start_ms"), F.col("end_ms")).alias("t"))
    return rows.select("media_id", "pos", P.bounds_or_fail(F.col("t"))["start_ms"].alias("start_ms"), P.bounds_or_zero(F.col("t"))["end_ms"].alias("end_ms"), P.duration_or_zero(F.col("t")).alias("duration_ms"))


@query("p04_p06_loose_clock", f"{_C} SELECT media_id, pos, greatest(start_ms, 0) // 1000 * 1000 AS ms FROM cues")
def loose_clock(spark: SparkSession, d: str) -> DataFrame:
    return cues(spark, d).select("media_id", "pos", P.loose_clock_ms(F.left(P.format_ms(F.col("start_ms")), F.lit(8))).alias("ms"))


@query("p07_campaign_seconds", "SELECT event_id, CAST(event_id % 3 * 3600 + event_id % 60 * 60 + event_id % 59 AS DOUBLE) AS seconds FROM events")
def campaign_seconds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", P.campaign_seconds(F.concat_ws(":", k % 3, k % 60, k % 59)).alias("seconds"))


@query("t02_t03_letters_only", "SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', '', 'g') AS plain FROM documents".replace("\\\\", "\\"))
def letters_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.letters_only(F.col("text")).alias("plain"))


@query("t04_t05_t06_t07_word_characters", r"SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]+', '', 'g') AS plain FROM documents")
def word_characters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.word_characters(F.col("text")).alias("plain"))


@query("t08_t09_compact", r"SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[\t\n\f\r \x0b\x{a0}\x{3000}]+', '', 'g') AS plain FROM documents")
def compact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.compact(F.col("text")).alias("plain"))


@query("t01_normalize_spoken", r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(translate(replace(lower(text), 'ß', 'ss'), '’‘ʼ´`', ''''''''''''), '–', '-'), '[\x{2010}-\x{2015}-]', ' ', 'g'), '[^\p{L}\p{N}'' ]+', ' ', 'g'),
  '(^|[^\p{L}\p{N}])''+', '\1', 'g'), '''+([^\p{L}\p{N}]|$)', '\1', 'g'), ' +', ' ', 'g')) AS plain FROM conversations""")
def normalize_spoken(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.normalize_spoken(F.col("text")).alias("plain"))


@query("t10_reading_units", r"""SELECT conv_id, turn, len(regexp_extract_all(text, '[\p{L}\p{N}]')) * 2 + len(regexp_extract_all(text, '[\p{L}\p{N}]+')) * 2
  + length(text) - len(regexp_extract_all(text, '[\p{L}\p{N}]')) - len(regexp_extract_all(text, '[\t\n\f\r \x0b]')) AS quarters FROM conversations""")
def reading_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.reading_units(F.col("text")).cast("long").alias("quarters"))


@query("t11_t12_join_tokens", r"SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+'), ' ') AS joined FROM conversations")
def join_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return table(spark, d, "conversations").select("conv_id", "turn", T.join_tokens(tokens).alias("joined"))


@query("t13_t14_target_length", rf"""SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '{_LATIN}')) > 0 THEN len(regexp_extract_all(text, '{_LATIN}'))
  ELSE length(regexp_replace(text, '[\t\n\f\r \x0b]+', '', 'g')) END AS n FROM conversations""")
def target_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.target_length(F.col("text"), _LATIN).cast("long").alias("n"))


@query("t15_t16_detect_script", r"""SELECT page_id, CASE WHEN len(regexp_extract_all(html, '[\x{4e00}-\x{9fff}]')) > 0.3 * greatest(length(html), 1) THEN 'zh' WHEN len(regexp_extract_all(html, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]')) > 0 THEN 'mixed' ELSE 'latin' END AS script FROM pages""")
def detect_script(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.detect_script(F.col("html")).alias("script"))


@query("t17_t18_wide_lines", rf"""SELECT conv_id, turn, CASE WHEN len(l) >= 2 THEN array_to_string(list_filter(l, lambda x: regexp_matches(x, '{_LATIN}')), chr(10)) ELSE text END AS target
  FROM (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)""")
def wide_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.wide_lines_only(F.col("text"), _LATIN).alias("target"))


@query("t20_t21_t22_strip_source", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN role ELSE text END AS target FROM conversations""")
def strip_source(spark: SparkSession, d: str) -> DataFrame:
    rendered = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("@"), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("@"), "text", F.lit("\n"), "role")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.strip_source(F.concat(F.lit("@"), "text"), rendered).alias("target"))


@query("t24_best_line", r"""SELECT conv_id, turn, coalesce(list_reduce(list_prepend('', list_filter(l, lambda x: len(regexp_extract_all(x, '\p{L}')) >= 3)), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END), '') AS best
  FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)""")
def best_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.best_line(T.lines(F.col("text"))).alias("best"))


@query("t25_t38_safe_name", r"""SELECT doc_id, CASE WHEN s = '' THEN 'media' ELSE s END AS name FROM (SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '[<>:"/\\|?*\x00-\x1f]+', '-', 'g'), '[\t\n\f\r \x0b]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 72), '[-.]+$', '') AS s FROM documents)""")
def safe_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.safe_name(F.col("text")).alias("name"))


@query("t27_t32_t34_redact", r"""SELECT event_id, left(regexp_replace(regexp_replace(regexp_replace('token=' || event_id || ' at /home/u' || user_id || '/x.srt Bearer ' || event_type, '(?i)(api[_-]?key|token|secret|password|authorization)([\t\n\f\r ]*[=:][\t\n\f\r ]*)[^\t\n\f\r ]+', '\1\2[redacted]', 'g'),
  '(?i)bearer[\t\n\f\r ]+[^\t\n\f\r ]+', 'Bearer [redacted]', 'g'), '([A-Za-z]:\\|/(home|Users|root|tmp)/)[^\t\n\f\r ]*', '[path]', 'g'), 1000) AS safe FROM events""")
def redact(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("token="), F.col("event_id").cast("string"), F.lit(" at /home/u"), F.col("user_id").cast("string"), F.lit("/x.srt Bearer "), F.col("event_type"))
    return table(spark, d, "events").select("event_id", T.redact(line).alias("safe"))


@query("t31_t33_mask_key", "SELECT c_custkey, left(c_name, 3) || '...' || right(c_name, 4) AS masked FROM customer")
def mask_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.mask_key(F.col("c_name")).alias("masked"))


@query("t41_t42_human_bytes", """SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', b / 1024.0) || ' KB' ELSE printf('%.1f', b / 1048576.0) || ' MB' END AS size FROM (SELECT doc_id, n_chars * 64 AS b FROM documents)""")
def human_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.human_bytes(F.col("n_chars") * 64).alias("size"))


@query("t39_distinct_terms", "SELECT p_partkey, left(CASE WHEN lower(p_brand) = lower(p_type) THEN p_brand ELSE p_brand || ', ' || p_type END, 512) AS terms FROM part")
def distinct_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.distinct_terms(F.concat_ws(" , ", "p_brand", "p_type", F.upper("p_brand"), F.lit(""))).alias("terms"))


@query("f24_repeated_phrase", r"""SELECT conv_id, turn, list_bool_or([coalesce(list_bool_or(list_transform(generate_series(1, len(w) - 2 * n + 1), lambda i: w[i:i + n - 1] = w[i + n:i + 2 * n - 1])), false) FOR n IN [3, 4, 5]]) AS repeated
  FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(replace(lower(text), 'ß', 'ss'), '[\t\n\f\r \x0b]+'), lambda x: x <> '') AS w FROM conversations)""")
def repeated_phrase(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.repeated_phrase(F.col("text")).alias("repeated"))


@query("m01_levenshtein", "SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def levenshtein(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return p.join(other, "p_partkey").select("p_partkey", F.levenshtein("p_name", "next").cast("long").alias("distance"))


@query("m03_ngram_f1", """WITH p AS (SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
gx AS (SELECT p_partkey, g, count(*) AS n FROM (SELECT p_partkey, substr(x, unnest(generate_series(1, length(x) - 1)), 2) AS g FROM p) GROUP BY ALL),
gy AS (SELECT p_partkey, g, count(*) AS n FROM (SELECT p_partkey, substr(y, unnest(generate_series(1, length(y) - 1)), 2) AS g FROM p) GROUP BY ALL),
c AS (SELECT p_partkey, sum(least(gx.n, gy.n)) AS common FROM gx JOIN gy USING (p_partkey, g) GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN greatest(length(x) - 1, 0) + greatest(length(y) - 1, 0) = 0 THEN 1.0 ELSE 2.0 * coalesce(common, 0)::DOUBLE / (greatest(length(x) - 1, 0) + greatest(length(y) - 1, 0)) END AS f1 FROM p LEFT JOIN c USING (p_partkey)""")
def ngram_f1(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return p.join(other, "p_partkey").select("p_partkey", S.ngram_f1(F.col("p_name"), F.col("next")).alias("f1"))


@query("m05_bleu_chrf")
def bleu_chrf(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).select("media_id", "pos", F.col("text").alias("reference"), F.regexp_replace("text", "and ", "").alias("candidate"))
    return S.bleu_chrf(rows).drop("reference", "candidate")


@query("m06_m07_box_iou", """SELECT l_orderkey, l_linenumber, CASE WHEN u > 0 THEN i / u ELSE 0 END AS iou FROM (SELECT l_orderkey, l_linenumber, i, w * h * 2 - i AS u FROM (
  SELECT *, greatest(w - dx, 0) * greatest(h - dx, 0) AS i FROM (SELECT l_orderkey, l_linenumber, l_quantity AS w, l_quantity + 1 AS h, l_discount * 100 AS dx FROM lineitem)))""")
def box_iou(spark: SparkSession, d: str) -> DataFrame:
    q, dx = F.col("l_quantity"), F.col("l_discount") * 100
    box = lambda x: F.struct(x.alias("left"), x.alias("top"), q.alias("width"), (q + 1).alias("height"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.box_iou(box(F.lit(0.0)), box(dx)).alias("iou"))


@query("m12_m14_batch_hash", f"{_C} SELECT media_id, sha256(string_agg(text, chr(10) ORDER BY pos)) AS sha, left(sha256(string_agg(text, chr(10) ORDER BY pos)), 24) AS cache_key FROM cues GROUP BY media_id")
def batch_hash(spark: SparkSession, d: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    out = cues(spark, d).groupBy("media_id").agg(F.sha2(F.array_join(texts, "\n"), 256).alias("sha"))
    return out.withColumn("cache_key", F.left("sha", F.lit(24)))


@query("m15_m16_m17_hash_side", "SELECT conv_id, turn, ('0x' || left(sha256('blind:' || conv_id || ':' || turn), 2))::INT % 2 AS side FROM conversations")
def hash_side(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", S.hash_side(F.lit("blind"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("side"))


@query("m19_a35_rates", "SELECT l_returnflag, avg(l_discount) AS mean, count(*) FILTER (WHERE l_tax > 0.04)::DOUBLE / count(*) AS share FROM lineitem GROUP BY l_returnflag")
def rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(S.finite_mean(F.col("l_discount")).alias("mean"), (F.count_if(F.col("l_tax") > 0.04) / F.count("*")).alias("share"))
    return rows


@query("m20_text_budget", f"{_C} SELECT media_id, pos, least(36, greatest(1, (end_ms - start_ms) * 9 // 1000)) AS budget FROM cues")
def text_budget(spark: SparkSession, d: str) -> DataFrame:
    return cues(spark, d).select("media_id", "pos", S.text_budget(F.col("end_ms") - F.col("start_ms"), 9, 36).alias("budget"))


@query("n01_n07_n08_answers", """SELECT event_id, 'text ' || event_id AS answer, (event_id % 2 = 0) AS is_object FROM events""")
def answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    inner = F.concat(F.lit('{"choices":[{"message":{"content":"text '), k, F.lit('"}}]}'))
    other = F.concat(F.lit('{"message":{"content":"text '), k, F.lit('"}}'))
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), inner, F.lit("\n```"))).otherwise(other)
    shape = F.when(F.col("event_id") % 2 == 0, text).otherwise(F.lit("[1]"))
    return table(spark, d, "events").select("event_id", N.answer_text(N.unwrap_fence(text)).alias("answer"), N.json_object(shape).isNotNull().alias("is_object"))


@query("n09_n16_e01_id_sets", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'missing' WHEN 2 THEN 'unexpected' ELSE 'duplicate' END AS error FROM events")
def id_sets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    expected = F.array(k, k + 1)
    returned = F.when(k % 4 == 0, expected).when(k % 4 == 1, F.array(k)).when(k % 4 == 2, F.array(k, k + 1, k + 9)).otherwise(F.array(k, k, k + 1))
    return table(spark, d, "events").select("event_id", N.id_set_error(returned, expected).alias("error"))


@query("n10_n24_evidence", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id || ',' || (event_id + 1) END AS evidence FROM events")
def evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    ids = F.when(k % 3 == 0, F.array(k, k + 7)).otherwise(F.array(k, k + 1, k))
    return table(spark, d, "events").select("event_id", F.array_join(N.evidence(ids, F.array(k, k + 1)).cast("array<string>"), ",").alias("evidence"))


@query("n13_n23_confidence", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'high' WHEN event_id % 100 >= 80 THEN 'high' WHEN event_id % 100 >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM events")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_id") % 5 == 0, F.lit(" High ")).otherwise(((F.col("event_id") % 100) / 100).cast("string"))
    return table(spark, d, "events").select("event_id", N.confidence(value).alias("confidence"))


@query("m02_ratio_of_cues", f"WITH {CUES_SQL} SELECT media_id, pos, CASE WHEN length(text) = 0 THEN 0 ELSE round(2.0::DOUBLE * length(text) / (2 * length(text) + length(role) + 1), 6) END AS ratio FROM cues")
def ratio_of_cues(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts against themselves with a word more: all of the shorter one matches."""
    return cues(spark, d).select("media_id", "pos", F.round(S.matching_ratio("text", F.concat("text", F.lit(" "), "role")), 6).alias("ratio"))


@query("m04_j12_errors_of_cues", rf"""WITH {CUES_SQL}, w AS (SELECT media_id, pos, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM cues)
SELECT media_id, pos, CASE WHEN pos % 3 = 0 THEN len(list_filter(w, lambda x: length(x) > 8)) ELSE 0 END AS substitutions, CASE WHEN pos % 3 = 1 THEN 2 ELSE 0 END AS insertions, CASE WHEN pos % 3 = 2 THEN len(list_filter(w, lambda x: length(x) = 3)) ELSE 0 END AS deletions, len(w) AS words FROM w""")
def errors_of_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues of which long words are others, two words come more, or words of three letters lack."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    heard = F.when(F.col("pos") % 3 == 0, F.transform("w", lambda x: F.when(F.length(x) > 8, "|||").otherwise(x))).when(F.col("pos") % 3 == 1, F.concat("w", F.array(F.lit("|"), F.lit("||")))).otherwise(F.filter("w", lambda x: F.length(x) != 3))
    return cues(spark, d).select("media_id", "pos", words.alias("w")).select("media_id", "pos", S.word_errors(F.array_join("w", " "), F.array_join(heard, " ")).alias("e")).select("media_id", "pos", "e.*")


@query("t23_formatted_cues", rf"""WITH RECURSIVE {CUES_SQL},
v AS (SELECT media_id, pos, regexp_replace(regexp_replace(trim(regexp_replace(text || CASE WHEN pos % 2 = 0 THEN '。。你好, ' || role ELSE '' END, '[ \t]+', ' ', 'g'), ' ' || chr(10)), '\s*\n\s*', '', 'g'), '$^', '') AS t, pos % 2 = 0 AS han FROM cues),
m AS (SELECT media_id, pos, {"".join("regexp_replace(" for _ in "，。！？；：、")}CASE WHEN han THEN translate(t, ',.!?;:', '，。！？；：') ELSE t END{"".join(f", '{x}+', '{x}', 'g')" for x in "，。！？；：、")} AS t FROM v),
s AS (
  SELECT media_id, pos, '' AS done, t AS rest, 0 AS n FROM m
  UNION ALL SELECT media_id, pos, done || CASE WHEN n > 0 THEN chr(10) ELSE '' END || left(rest, k), substr(rest, k + 1), n + 1
  FROM (SELECT *, CASE WHEN length(regexp_extract(left(rest, 19), '^(.*[，。！？；：、])', 1)) >= 9 THEN length(regexp_extract(left(rest, 19), '^(.*[，。！？；：、])', 1)) ELSE 18 END AS k FROM s WHERE length(rest) > 18))
SELECT media_id, pos, done || CASE WHEN n > 0 AND rest <> '' THEN chr(10) ELSE '' END || rest AS text FROM s WHERE length(rest) <= 18""")
def formatted_cues(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts in lines of eighteen characters; half of them have Han characters."""
    text = F.concat("text", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("。。你好, "), "role")).otherwise(""))
    return cues(spark, d).select("media_id", "pos", T.formatted(text, F.lit(18)).alias("text"))
