"""Queries over settings, names and keys. Cases stand beside what they mean, worked out by hand; the SQL is that list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.bridge import CUES_SQL, cues, table
from cuelake.functions import similarity as S
from cuelake.functions import structured as N
from cuelake.functions import text as T
from cuelake.functions import time as P
from cuelake.plans import settings as C
from cuelake.queries.registry import query


def _cell(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def _cases(name: str, made: Callable[..., Column], fields: list[str], cases: list[tuple[tuple, tuple]]) -> None:
    """Over the events, each a case in turn: the fields of the struct that is made of the case's values."""
    sql = ", ".join(f"[{', '.join(_cell(want[k]) for _, want in cases)}][event_id % {len(cases)} + 1] AS {f}" for k, f in enumerate(fields))

    def run(spark: SparkSession, d: str) -> DataFrame:
        k = (F.col("event_id") % len(cases) + 1).cast("int")
        values = [F.element_at(F.array(*[F.lit(given[i]).cast("string") for given, _ in cases]), k) for i in range(len(cases[0][0]))]
        rows = table(spark, d, "events").select("event_id", made(*values).alias("s"))
        return rows.select("event_id", *[F.col(f"s.{f}").alias(f) for f in fields])

    query(name, f"SELECT event_id, {sql} FROM events")(run)


_cases("c01_asr_request", C.asr_request, ["mode", "language", "error"], [
    ((None, None), ("auto", None, None)), ((" ", "FR "), ("fixed", "fr", None)), (("Fixed", "en"), ("fixed", "en", None)), (("fixed", "auto"), (None, None, "language_needed")), (("auto", "auto"), ("auto", None, None)),
    (("auto", "fr"), (None, None, "language_not_accepted")), (("MULTILINGUAL", ""), ("multilingual", None, None)), (("multilingual", "de"), (None, None, "language_not_accepted")), (("mixed", None), (None, None, "mode")),
])
_cases("c03_translation_strategy", C.translation_strategy, ["mode", "gap", "error"], [
    ((None, None), ("standard", 30.0, None)), (("Three-Pass", "12.5"), ("three_pass", 12.5, None)), (("semantic_wenyi_review", "600"), ("semantic_wenyi_review", 600.0, None)), (("two_pass", "30"), (None, None, "mode")),
    (("standard", "0.5"), (None, None, "gap_range")), (("standard", "601"), (None, None, "gap_range")), (("standard", "soon"), (None, None, "gap_no_number")), ((" wenyi-review ", "1"), ("wenyi_review", 1.0, None)),
])
_cases("c04_reliability", C.reliability, ["mode", "limit", "error"], [
    ((None, None), ("off", 12, None)), (("preview", "0"), ("preview", 0, None)), ((" preview ", "50"), ("preview", 50, None)), (("preview", ""), ("preview", 12, None)), (("on", "3"), (None, None, "mode")),
    (("off", "51"), (None, None, "limit_range")), (("off", "-1"), (None, None, "limit_range")), (("off", "many"), (None, None, "limit_no_integer")),
])
_cases("u19_candidate", C.candidate, ["strategy", "version", "error"], [
    (("vad-balanced-v1", "off", "small"), ("decode", 1, None)), ((" local-retry-selective-v2", "dry_run", "large-v3"), ("local_retry_selective", 2, None)), (("mixed-route-v1", "dry_run", "small"), ("mixed_route", 1, None)),
    (("vad-balanced-v2", "off", "small"), (None, None, "candidate")), (("local-retry-v1", "apply", "small"), (None, None, "mode_not_allowed")), (("local-retry-v1", "run", "small"), (None, None, "mode")),
    (("previous-text-off-v1", "off", "tiny"), (None, None, "model")), ((None, "off", "small"), (None, None, "candidate")), (("decode-repeat-guard-v1", None, "small"), (None, None, "mode")),
])
_cases("k24_formats", lambda x: F.struct(F.array_join(T.subtitle_formats(x), ",").alias("formats")), ["formats"], [
    ((None,), ("srt",)), (("",), ("srt",)), (("ASS",), ("srt,ass",)), (("ass; srt",), ("ass,srt",)), (("srt,srt, ",), ("srt",)), ((" , ",), ("srt",)),
])
_cases("t37_source_language", lambda x: F.struct(T.is_source_language(x).alias("is_source")), ["is_source"], [
    (("Film.eng.srt",), (True,)), (("film.EN.ass",), (True,)), (("film.english.sub",), (False,)), (("film.fre.srt",), (False,)), (("film.srt",), (False,)), (("eng.txt",), (False,)), (("a.en.b.srt",), (False,)),
])
_cases("t44_safe_member", lambda x: F.struct(T.safe_member(x).alias("member")), ["member"], [
    (("a/b.wav",), ("a/b.wav",)), (("a\\b.wav",), ("a/b.wav",)), (("/a.wav",), (None,)), (("a/../b.wav",), (None,)), (("C:/a.wav",), (None,)), (("",), (None,)), (("..",), (None,)), (("a..b/c",), ("a..b/c",)),
])
_cases("t45_target_language", lambda a, b: F.struct(T.target_language(a, b).alias("language")), ["language"], [
    (("out/x.m.translated.zh-CN.srt", None), ("zh-CN",)), ((None, "x.bilingual.de.srt"), ("de",)), (("x.srt", "y.bilingual.fr.srt"), ("fr",)), (("x.translated.z.srt", None), ("",)), ((None, None), ("",)), (("a.translated.en.srt", "b.bilingual.fr.srt"), ("en",)),
])
_cases("t28_sanitized", lambda x: F.struct(T.sanitized(x).alias("document")), ["document"], [
    (('{"api_key":"s3cr3t","n":[{"token":1},"C:\\\\Users\\\\x","/home/ann/a"],"ok":true}',), ('{"api_key":"[redacted]","n":[{"token":"[redacted]"},"[path]","[path]"],"ok":true}',)), (('["a",2.5,null]',), ('["a",2.5,null]',)), (("{",), (None,)),
    (('{"Authorization":{"a":1},"deep":{"deeper":{"password":"x","y":"see /Users/b/c now"}}}',), ('{"Authorization":"[redacted]","deep":{"deeper":{"password":"[redacted]","y":"see [path] now"}}}',)), ((None,), (None,)),
])
_cases("t30_public_safe", lambda x: F.struct(T.public_safe(x).alias("problem")), ["problem"], [
    (('{"a":{"b":[1,{"c":"text"}]}}',), (None,)), (('{"a":{"source_text":"x"}}',), ("forbidden_key",)), (('[{"Local_Path":1}]',), ("forbidden_key",)), (('{"a":["/home/x"]}',), ("private_path",)),
    (('{"a":"https://x.org/home/"}',), (None,)), (('{"a":"D:\\\\x"}',), ("private_path",)), (("no json",), ("not_json",)), (('{"a_textual":1}',), (None,)),
])


_cases("p13_p14_fractions", lambda n, given: F.struct(F.array_join(P.interior_fractions(n.cast("int")).cast("array<string>"), ",").alias("interior"), F.array_join(P.parse_fractions(given).cast("array<string>"), ",").alias("parsed")), ["interior", "parsed"], [
    (("1", "0.5"), ("0.5", "0.5")), (("3", "0.1, 0.25 ,0.9"), ("0.25,0.5,0.75", "0.1,0.25,0.9")), (("2", "0.5,0.5"), ("0.333333,0.666667", None)), (("4", "0,0.5"), ("0.2,0.4,0.6,0.8", None)), (("1", "0.2,x"), ("0.5", None)), (("1", "0.9,0.1"), ("0.5", None)), (("1", "0.3,1"), ("0.5", None)),
])
_cases("n02_n03_n05_loose_json", lambda x: F.struct(N.loose_json(x).alias("document")), ["document"], [
    (('```json\n{"b": 1, "a": [2]}\n```',), ('{"a": [2], "b": 1}',)), (('Here you are: {"a": "x"} as asked',), ('{"a": "x"}',)), (('{"a": 1, // a note\n "url": "http://x//y"}',), ('{"a": 1, "url": "http://x//y"}',)),
    (('{"a": "he said "no" to me"}',), ('{"a": "he said \\"no\\" to me"}',)), (("no object at all",), (None,)), (('{"a": [1, 2}',), (None,)), ((None,), (None,)), (('{"é": "\\u00e9"}',), ('{"é": "é"}',)),
])
_cases("m02_matching_ratio", lambda a, b: F.struct(F.round(S.matching_ratio(a, b), 6).alias("ratio")), ["ratio"], [
    (("abcd", "bcde"), (0.75,)), (("same", "same"), (1.0,)), (("abc", "xyz"), (0.0,)), (("", "abc"), (0.0,)), (("qabxcd", "abycdf"), (0.666667,)), (("aab", "aba"), (0.666667,)), ((None, "a"), (0.0,)),
])
_cases("m04_j12_word_errors", lambda a, b: S.word_errors(a, b), ["substitutions", "insertions", "deletions", "words"], [
    (("a b c", "a b c"), (0, 0, 0, 3)), (("a b c", "a x c"), (1, 0, 0, 3)), (("a b c", "a c"), (0, 0, 1, 3)), (("a c", "a b c d"), (0, 2, 0, 2)), (("", "a"), (0, 1, 0, 0)), (("a b", None), (0, 0, 2, 2)),
])
_cases("t19_two_lines", lambda x: T.two_lines(x), ["source", "target", "error"], [
    (("one\ntwo",), ("one", "two", None)), ((" one \n\n two \n",), ("one", "two", None)), (("one",), (None, None, "two lines are needed")), (("a\nb\nc",), (None, None, "two lines are needed")), ((None,), (None, None, "two lines are needed")), ((" \n ",), (None, None, "two lines are needed")),
])
_cases("t23_wrapped", lambda x: F.struct(T.wrapped(x, F.lit(20)).alias("text")), ["text"], [
    (("short",), ("short",)), (("this text is too long for a line",), ("this text is too\nlong for a line",)), ((None,), (None,)), (("",), ("",)),
])


@query("f35_formal_references", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS n_formal, count(*) AS n FROM documents GROUP BY source")
def formal_references(spark: SparkSession, d: str) -> DataFrame:
    """Languages stand for kinds of references: English ones are gold."""
    kind = F.when(F.col("lang") == "en", "gold_verbatim").otherwise("production_subtitle")
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(T.is_formal_reference(kind)).alias("n_formal"), F.count("*").alias("n"))


@query("t43_source_groups", r"""WITH m AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/' WHEN 2 THEN 'c/' ELSE '' END || 'film' || p_size || '_seg' || p_partkey || '.wav' AS member FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN ['a', 'b', 'c'][p_partkey % 4 + 1] ELSE 'film' || p_size END AS source_group FROM part JOIN m USING (p_partkey)
UNION ALL SELECT -1 - p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'talk' ELSE NULL END FROM part""")
def source_groups(spark: SparkSession, d: str) -> DataFrame:
    """Members below three folders go by folder; flat ones by their names without segments; names that are ids, or have no segment, have none."""
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    folder = F.when(k % 4 == 0, "a/").when(k % 4 == 1, "b/").when(k % 4 == 2, "c/").otherwise("")
    deep = part.select("p_partkey", F.concat(folder, F.lit("film"), F.col("p_size").cast("string"), F.lit("_seg"), k.cast("string"), F.lit(".wav")).alias("member"))
    name = F.when(k % 3 == 0, "01234567-89ab-cdef-0123-456789abcdef.wav").when(k % 3 == 1, F.concat(F.lit("talk-clip_"), k.cast("string"), F.lit(".wav"))).otherwise("talk.wav")
    flat = part.select((-1 - k).alias("p_partkey"), name.alias("member"))
    return T.source_groups(deep).select("p_partkey", "source_group").unionByName(T.source_groups(flat).select("p_partkey", "source_group"))


@query("k22_outputs", "SELECT doc_id, 'out/source/d' || doc_id || '.small.srt' AS source, 'out/zh/d' || doc_id || '.small.translated.' || lang || '.srt' AS translated, CASE WHEN doc_id % 2 = 0 THEN 'out/zh/d' || doc_id || '.small.translated.' || lang || '.srt' ELSE 'out/bilingual/d' || doc_id || '.small.bilingual.' || lang || '.srt' END AS final, 'out/reports/d' || doc_id || '.small.quality_report.json' AS report FROM documents")
def outputs(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("doc_id") % 2 == 0, "translated").otherwise("bilingual")
    rows = table(spark, d, "documents").select("doc_id", C.outputs(F.lit("out"), F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("small"), F.col("lang"), mode).alias("o"))
    return rows.select("doc_id", "o.source", "o.translated", "o.final", "o.report")


@query("c09_fingerprints", "SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'cache' ELSE 'content' END AS origin FROM documents WHERE text <> ''")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Texts as files; the cache knows a third, half of which have been touched since."""
    raw = F.col("text").cast("binary")
    files = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.length(raw).alias("size"), (F.col("doc_id") % 7).alias("mtime"), raw.alias("content"))
    cached = files.where("path % 3 = 0 and size > 0").select("path", "size", F.when(F.col("path") % 2 == 0, F.col("mtime")).otherwise(F.col("mtime") + 1).alias("mtime"), F.sha2("content", 256).alias("sha256"))
    return C.fingerprints(files, cached).select(F.col("path").alias("doc_id"), "sha256", "origin")


_SETTING = """'{"api_provider":"p","effective_prompt":"' || c_mktsegment || '","input":"' || c_custkey || '","llm_model":"m",'"""


@query("c10_cache_key", f"""SELECT c_custkey, left(sha256({_SETTING} || CASE c_nationkey % 3 WHEN 0 THEN '"target_language":"zh","translation_mode":"b"}}'
  WHEN 1 THEN '"scene_gap_seconds":"30","target_language":"zh","translation_mode":"b","translation_strategy":"v2","translation_strategy_mode":"three_pass"}}'
  ELSE '"profile_glossary":"g","scene_gap_seconds":"30","target_language":"zh","translation_mode":"b","translation_strategy":"v2","translation_strategy_mode":"wenyi_review"}}' END), 24) AS key FROM customer""")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    """Scene gap, strategy and glossary are part of the key where the strategy uses them alone; a null setting never is."""
    k = F.col("c_nationkey") % 3
    mode = F.when(k == 0, "standard").when(k == 1, "three_pass").otherwise("wenyi_review")
    given = {
        "input": F.col("c_custkey").cast("string"), "api_provider": F.lit("p"), "llm_model": F.lit("m"), "target_language": F.lit("zh"), "translation_mode": F.lit("b"), "effective_prompt": F.col("c_mktsegment"), "profile_glossary": F.lit("g"),
        "scene_gap_seconds": F.lit("30"), "translation_strategy": F.lit("v2"), "translation_strategy_mode": mode, "max_cps_zh": F.lit(None).cast("string"), "unknown": F.lit("x"),
    }
    return table(spark, d, "customer").select("c_custkey", C.cache_key(F.create_map(*[x for n, v in given.items() for x in (F.lit(n), v)])).alias("key"))


@query("c11_records_fingerprint", f"""WITH {CUES_SQL} SELECT media_id, sha256('context=3' || chr(30) || 'model=m' || chr(30) || string_agg(sha256(pos || chr(31) || text), '' ORDER BY pos)) AS fingerprint FROM cues GROUP BY media_id""")
def records_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return C.records_fingerprint(cues(spark, d), {"model": "m", "context": "3"})
