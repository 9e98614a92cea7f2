"""Queries over burned-in captions, recognition and translation of the same recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.bridge import CUES_SQL, cues
from cuelake.operators import evidence as E
from cuelake.operators import rules as R
from cuelake.operators import sequences as W
from cuelake.queries.registry import query
from cuelake.sources.files import kept

_WORD = r"regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', '', 'g')"

#: Captions, what is heard (a fifth lacks, a seventh is cut, times are later) and two translations (in words the other way round). The engine of the
#: SQL counts edits by bytes and has no capital of ß: there, letters of plain texts that are not ASCII become capitals, one byte each.
_TRACKS = r"""plain AS (SELECT media_id, pos, start_ms, end_ms, silence_milli, text FROM cues),
captions AS (SELECT media_id, pos, start_ms, end_ms, text, silence_milli / 1000::DOUBLE AS stability, CASE WHEN pos % 3 = 0 THEN NULL ELSE substr(text, 4) END AS target FROM plain),
heard AS (SELECT media_id, pos, start_ms + (media_id % 3) * 400 + 900 AS start_ms, end_ms + (media_id % 3) * 400 + 900 AS end_ms, CASE WHEN pos % 7 = 0 THEN substr(text, 1, 9) WHEN pos % 6 = 0 THEN '?!' ELSE text END AS text FROM plain WHERE (media_id + pos) % 5 <> 0),
base AS (SELECT media_id, pos, start_ms, end_ms, CASE WHEN pos % 4 = 0 THEN ' ' WHEN pos % 4 = 1 THEN text ELSE upper(replace(substr(text, 6), 'ß', 'ss')) END AS text FROM plain WHERE pos % 9 <> 0)"""


def _edits(a: str, b: str) -> str:
    one_byte = "translate({0}, 'äçèéêíñóöü', 'ABCDEFGHIJ')"
    return f"levenshtein({one_byte.format(a)}, {one_byte.format(b)})"


def tracks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = kept(cues(spark, d))  # all three tracks are made of it, many times over
    p, late = F.col("pos"), (F.col("media_id") % 3) * 400 + 900
    captions = rows.select("media_id", "pos", "start_ms", "end_ms", "text", (F.col("silence_milli") / 1000).alias("stability"), F.when(p % 3 != 0, F.expr("substr(text, 4)")).alias("target"))
    text = F.when(p % 7 == 0, F.left("text", F.lit(9))).when(p % 6 == 0, "?!").otherwise(F.col("text"))
    heard = rows.where((F.col("media_id") + p) % 5 != 0).select("media_id", "pos", (F.col("start_ms") + late).alias("start_ms"), (F.col("end_ms") + late).alias("end_ms"), text.alias("text"))
    other = F.when(p % 4 == 0, " ").when(p % 4 == 1, F.col("text")).otherwise(F.upper(F.expr("substr(text, 6)")))
    return captions, heard, rows.where(p % 9 != 0).select("media_id", "pos", "start_ms", "end_ms", other.alias("text"))


def _parts(name: str, right: str) -> str:
    """Rows of captions and another track with the part that each is in."""
    return f"""{name}_b AS (SELECT media_id, 'l' AS side, pos, start_ms, end_ms FROM captions UNION ALL SELECT media_id, 'r', pos, start_ms, end_ms FROM {right}),
{name}_i AS (SELECT *, count(*) FILTER (WHERE side = 'r') OVER (PARTITION BY media_id, part) AS n_right FROM (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, side, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM (
  SELECT *, CASE WHEN start_ms < max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, side, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {name}_b))),
{name}_n AS (SELECT media_id, pos, other FROM (SELECT l.media_id, l.pos, r.pos AS other, row_number() OVER (PARTITION BY l.media_id, l.pos ORDER BY greatest(0, r.start_ms - l.end_ms, l.start_ms - r.end_ms), abs(r.start_ms - l.start_ms), r.pos) AS k
  FROM {name}_i l JOIN {right} r ON l.media_id = r.media_id WHERE l.side = 'l' AND l.n_right = 0 AND greatest(0, r.start_ms - l.end_ms, l.start_ms - r.end_ms) <= 500) WHERE k = 1),
{name} AS (SELECT i.media_id, i.side, i.pos, coalesce(t.part, i.part) AS part FROM {name}_i i LEFT JOIN {name}_n n ON i.side = 'l' AND i.media_id = n.media_id AND i.pos = n.pos LEFT JOIN {name}_i t ON t.side = 'r' AND t.media_id = n.media_id AND t.pos = n.other)"""


def _length(name: str, source: str, by: str, gap_order: str = "start_ms, end_ms") -> str:
    return f"""{name} AS (SELECT {by}, sum(e - s)::BIGINT AS ms FROM (SELECT {by}, g, min(start_ms) AS s, max(end_ms) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY {gap_order} ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN start_ms > max(end_ms) OVER (PARTITION BY {by} ORDER BY {gap_order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY {by} ORDER BY {gap_order}) = 1 THEN 1 ELSE 0 END AS new
  FROM (SELECT {by}, greatest(start_ms, 0) AS start_ms, end_ms FROM {source}) WHERE end_ms > start_ms)) GROUP BY {by}, g) GROUP BY {by})"""


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({b}, 0) > 0 THEN round(coalesce({a}, 0) / {b}::DOUBLE, 6) ELSE 0 END"


@query("a19_recognition_signals", rf"""WITH {CUES_SQL}, {_TRACKS}, {_parts('pa', 'heard')},
l AS (SELECT c.*, {_WORD.format('coalesce(text, $$$$)')} AS p, part FROM captions c JOIN pa ON side = 'l' AND pa.media_id = c.media_id AND pa.pos = c.pos),
r AS (SELECT c.*, {_WORD.format('coalesce(text, $$$$)')} AS p, part FROM heard c JOIN pa ON side = 'r' AND pa.media_id = c.media_id AND pa.pos = c.pos),
steady AS (SELECT * FROM l WHERE stability >= 0.75 AND p <> ''), {_length('steady_ms', 'steady', 'media_id, part')}, {_length('caption_ms', "(SELECT * FROM l WHERE p <> '')", 'media_id')},
{_length('lone_ms', "(SELECT * FROM r WHERE p <> '' AND NOT EXISTS (SELECT 1 FROM l WHERE l.media_id = r.media_id AND l.part = r.part))", 'media_id')}, {_length('heard_ms', 'r', 'media_id')},
said AS (SELECT media_id, part, string_agg(p, '' ORDER BY pos) AS a FROM steady GROUP BY ALL), told AS (SELECT media_id, part, string_agg(p, '' ORDER BY pos) AS b FROM r GROUP BY ALL),
s AS (SELECT media_id, sum(ms) AS stable_ms, sum({_edits('a', "coalesce(b, '')")}) AS edits, sum(length(a))::BIGINT AS reference_characters, sum(CASE WHEN coalesce(b, '') = '' THEN ms ELSE 0 END) AS missing_ms
  FROM said LEFT JOIN told USING (media_id, part) JOIN steady_ms USING (media_id, part) GROUP BY media_id),
t AS (SELECT media_id, {_rate('count(*) FILTER (WHERE again)', 'count(*)')} AS repeated, {_rate("count(*) FILTER (WHERE p <> '' AND NOT regexp_matches(text, '[A-Za-z]'))", "count(*) FILTER (WHERE p <> '')")} AS anomalous
  FROM (SELECT *, p <> '' AND p = lag(p) OVER (PARTITION BY media_id ORDER BY pos) AS again FROM r) GROUP BY media_id)
SELECT m.media_id, {_rate('stable_ms', 'cm.ms')} AS coverage, CASE WHEN reference_characters > 0 THEN {_rate('edits', 'reference_characters')} END AS disagreement, {_rate('missing_ms', 'stable_ms')} AS missing, {_rate('lm.ms', 'hm.ms')} AS extra,
  coalesce(repeated, 0) AS repeated, coalesce(anomalous, 0) AS anomalous, coalesce(reference_characters, 0) AS reference_characters
FROM (SELECT DISTINCT media_id FROM captions) m LEFT JOIN s USING (media_id) LEFT JOIN t USING (media_id) LEFT JOIN caption_ms cm USING (media_id) LEFT JOIN lone_ms lm USING (media_id) LEFT JOIN heard_ms hm USING (media_id)""")
def recognition_signals(spark: SparkSession, d: str) -> DataFrame:
    captions, heard, _ = tracks(spark, d)
    return E.recognition_signals(captions, heard, "[A-Za-z]")


def blocking(source, target):
    return R.blocking(source, target, {"han": "[\\x{4e00}-\\x{9fff}]"})


_ROWS = rf"""WITH {CUES_SQL}, {_TRACKS}, {_parts('ps', 'heard')}, {_parts('pt', 'base')},
sa AS (SELECT p.media_id, part, string_agg(text, ' ' ORDER BY c.pos) AS x FROM heard c JOIN ps p ON side = 'r' AND p.media_id = c.media_id AND p.pos = c.pos GROUP BY ALL),
ta AS (SELECT p.media_id, part, string_agg(text, ' ' ORDER BY c.pos) AS x FROM base c JOIN pt p ON side = 'r' AND p.media_id = c.media_id AND p.pos = c.pos GROUP BY ALL),
j AS (SELECT c.media_id, c.pos, coalesce(target, '') AS target, coalesce(sa.x, '') AS source, coalesce(ta.x, '') AS translation FROM captions c
  JOIN ps ON ps.side = 'l' AND ps.media_id = c.media_id AND ps.pos = c.pos LEFT JOIN sa ON sa.media_id = c.media_id AND sa.part = ps.part
  JOIN pt ON pt.side = 'l' AND pt.media_id = c.media_id AND pt.pos = c.pos LEFT JOIN ta ON ta.media_id = c.media_id AND ta.part = pt.part),
w AS (SELECT *, {_WORD.format('source')} AS a, {_WORD.format('translation')} AS b, {_WORD.format('target')} AS c FROM j),
k AS (SELECT *, array_to_string(list_filter([CASE WHEN trim(translation) = '' THEN 'empty' END, CASE WHEN a = b AND length(a) >= 4 THEN 'identical' END, CASE WHEN target <> '' AND b = '' THEN 'ocr_target_without_translation' END,
  CASE WHEN a <> '' AND b <> '' AND NOT length(b)::DOUBLE / length(a) BETWEEN 0.2 AND 4 THEN 'abnormal_length_ratio' END], lambda x: x IS NOT NULL), ',') AS issues, CASE WHEN c <> '' THEN round({_edits('c', 'b')}::DOUBLE / length(c), 6) END AS disagreement FROM w),
details AS (SELECT *, issues <> '' OR coalesce(disagreement >= 0.45, false) AS needs_review FROM k)"""


def details(spark: SparkSession, d: str) -> DataFrame:
    captions, heard, base = tracks(spark, d)
    return E.translation_rows(captions, heard, base, blocking)


@query("j15_translation_signals", f"""{_ROWS} SELECT media_id, CASE WHEN sum(length(c)) > 0 THEN round(sum(CASE WHEN c <> '' THEN {_edits('c', 'b')} END)::DOUBLE / sum(length(c)), 6) END AS disagreement, sum(CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, ',')) END)::BIGINT AS n_issues,
  count(*) FILTER (WHERE contains(issues, 'abnormal_length_ratio')) AS n_abnormal, count(disagreement) AS n_comparable, count(*) FILTER (WHERE needs_review) AS n_review FROM details GROUP BY media_id""")
def translation_signals(spark: SparkSession, d: str) -> DataFrame:
    return E.translation_signals(details(spark, d))


@query("j29_review_items", f"""{_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY pos) AS place FROM details WHERE needs_review)
SELECT media_id, place, pos, 'source: ' || source || chr(10) || 'burned: ' || target || chr(10) || 'baseline: ' || translation || chr(10) || 'one: ' || p.text || CASE WHEN pos % 2 = 0 THEN chr(10) || 'two: ' || upper(replace(p.text, 'ß', 'ss')) ELSE '' END AS lines FROM n JOIN plain p USING (media_id, pos) WHERE place <= 20""")
def review_items(spark: SparkSession, d: str) -> DataFrame:
    """Twenty of a recording at most: the report's size."""
    captions, *_ = tracks(spark, d)
    one = captions.select("media_id", "pos", F.lit("one").alias("name"), "text")
    two = captions.where("pos % 2 = 0").select("media_id", "pos", F.lit("two").alias("name"), F.upper("text").alias("text"))
    return E.review_items(details(spark, d), one.unionByName(two))


@query("u16_judged", f"""{_ROWS}, q AS (SELECT sha256(media_id || '/' || pos) AS key, translation AS a, upper(replace(target, 'ß', 'ss')) AS b, media_id * 100000 + pos AS place, pos FROM details WHERE needs_review AND translation <> upper(replace(target, 'ß', 'ss'))),
c AS (SELECT key, 'TIE' AS preference FROM q WHERE pos % 5 = 0), o AS (SELECT key, row_number() OVER (ORDER BY place, key) AS n FROM q ANTI JOIN c USING (key))
SELECT key, CASE WHEN c.key IS NOT NULL THEN c.preference WHEN o.n <= 40 THEN CASE WHEN length(a) > length(b) THEN 'A' WHEN length(b) > length(a) THEN 'B' ELSE 'TIE' END END AS preference,
  CASE WHEN c.key IS NOT NULL THEN 'cache' WHEN o.n <= 40 THEN 'judge' ELSE 'over budget' END AS origin FROM q LEFT JOIN c USING (key) LEFT JOIN o USING (key)""")
def judged(spark: SparkSession, d: str) -> DataFrame:
    """All captions that need a review are candidates; a cache knows some, and a judge (a stand-in that likes the longer text) has forty questions."""
    key = F.sha2(F.concat(F.col("media_id").cast("string"), F.lit("/"), F.col("pos").cast("string")), 256)
    rows = details(spark, d).where("needs_review and translation <> upper(target)")
    questions = rows.select(key.alias("key"), F.col("translation").alias("a"), F.upper("target").alias("b"), (F.col("media_id") * 100_000 + F.col("pos")).alias("place"), "pos")
    cache = questions.where("pos % 5 = 0").select("key", F.lit("TIE").alias("preference"))
    return E.judged(questions.drop("pos"), cache, lambda: lambda a, b: "A" if len(a) > len(b) else "B" if len(b) > len(a) else "TIE", 40)


_FRAMES = "frames AS (SELECT media_id, (pos - 1) // 4 AS scene, pos, CASE WHEN pos % 9 = 0 THEN NULL ELSE role END AS text, first_value(role) OVER (PARTITION BY media_id, (pos - 1) // 4 ORDER BY pos) AS expected, pos % 5 <> 0 AS boxed FROM cues)"


@query("a26_temporal_stability", rf"""WITH {CUES_SQL}, {_FRAMES}, p AS (SELECT *, coalesce(text, '') AS t, lag(coalesce(text, '')) OVER w AS was, lag(pos) OVER w AS lp FROM frames WINDOW w AS (PARTITION BY media_id, scene ORDER BY pos)),
h AS (SELECT *, t <> '' AND t = expected AS hit FROM p), g AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY media_id, scene ORDER BY pos) AS run FROM h),
longest AS (SELECT media_id, scene, max(n) AS longest FROM (SELECT media_id, scene, run, count(*) AS n FROM g WHERE hit GROUP BY ALL) GROUP BY ALL),
b AS (SELECT media_id, scene, avg(CASE WHEN pos % 2 = was % 2 THEN 1::DOUBLE ELSE 90::DOUBLE / 110 END) AS iou FROM (SELECT media_id, scene, pos, lag(pos) OVER (PARTITION BY media_id, scene ORDER BY pos) AS was FROM frames WHERE boxed) WHERE was IS NOT NULL GROUP BY ALL),
n AS (SELECT media_id, scene, avg(CASE WHEN t <> '' AND was <> '' THEN (t = was)::INT * 1::DOUBLE + (t <> was)::INT * r END) AS near, avg((t <> '')::INT) AS present, max(expected) AS want FROM (
  SELECT *, CASE WHEN least(t, was) = 'assistant' AND greatest(t, was) = 'user' THEN 2::DOUBLE * 1 / 13 WHEN least(t, was) = 'assistant' AND greatest(t, was) = 'system' THEN 2::DOUBLE * 3 / 15 WHEN least(t, was) = 'system' AND greatest(t, was) = 'user' THEN 2::DOUBLE * 2 / 10 END AS r FROM p) GROUP BY ALL)
SELECT media_id, scene, CASE WHEN present > 0 AND want <> '' THEN round(0.4 * coalesce(near, 0) + 0.3 * present + 0.2 * coalesce(iou, 0) + 0.1 * least(1, coalesce(longest, 0) / 3::DOUBLE), 6) END AS score FROM n LEFT JOIN b USING (media_id, scene) LEFT JOIN longest USING (media_id, scene)""")
def temporal_stability(spark: SparkSession, d: str) -> DataFrame:
    """Four cues as the frames of a caption, their roles as what is read, boxes a tenth apart."""
    from pyspark.sql import Window

    scene = F.floor((F.col("pos") - 1) / 4)
    rows = cues(spark, d).withColumn("scene", scene)
    expected = F.first("role").over(Window.partitionBy("media_id", "scene").orderBy("pos"))
    number = lambda x: x.cast("double")
    box = F.struct(number(F.when(F.col("pos") % 2 == 0, 1).otherwise(0)).alias("left"), number(F.lit(0)).alias("top"), number(F.lit(10)).alias("width"), number(F.lit(5)).alias("height"))
    frames = rows.select("media_id", "scene", "pos", F.when(F.col("pos") % 9 != 0, F.col("role")).alias("text"), expected.alias("expected"), F.when(F.col("pos") % 5 != 0, box).alias("box"))
    return E.temporal_stability(frames, ["media_id", "scene"])


_GLOSSARY = [(1, "the", ["a la", "una"]), (2, "La", None), (3, "der", ["das ", "LA"]), (4, "ne", ["xx"]), (5, "zz", [""])]
_NAMES = ", ".join(f"({p}, {k}, '{n.strip()}')" for p, s, more in _GLOSSARY for k, n in enumerate([s, *(more or [])]) if n.strip())


@query("j22_terms_near", f"""WITH {CUES_SQL}, numbered AS (SELECT media_id, pos, lower(text) AS said, row_number() OVER (PARTITION BY media_id ORDER BY pos) AS k FROM cues), w AS (SELECT media_id, pos, start_ms - 1000 AS start_ms, end_ms + 1000 AS end_ms FROM cues WHERE (media_id * 3 + pos) % 6 = 0),
names(place, k2, name) AS (VALUES {_NAMES}),
near AS (SELECT DISTINCT w.media_id, w.pos, y.said FROM w JOIN cues c ON c.media_id = w.media_id AND c.start_ms < w.end_ms AND c.end_ms > w.start_ms JOIN numbered x ON x.media_id = c.media_id AND x.pos = c.pos JOIN numbered y ON y.media_id = x.media_id AND abs(y.k - x.k) <= 2),
found AS (SELECT DISTINCT media_id, pos, place FROM near, names WHERE contains(said, lower(name))),
f AS (SELECT media_id, pos, lower(name) AS low, arg_min(name, place * 100 + k2) AS name, min(place * 100 + k2) AS o FROM found JOIN names USING (place) GROUP BY ALL)
SELECT media_id, pos, string_agg(name, ', ' ORDER BY o) AS terms FROM f GROUP BY ALL""")
def terms_near(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d)
    flagged = rows.where((F.col("media_id") * 3 + F.col("pos")) % 6 == 0)
    windows = flagged.select("media_id", "pos", (F.col("start_ms") - 1000).alias("start_ms"), (F.col("end_ms") + 1000).alias("end_ms"))
    return E.terms_near(rows, windows, spark.createDataFrame(_GLOSSARY, "place int, source string, aliases array<string>"))
