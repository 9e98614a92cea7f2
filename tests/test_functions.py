"""Scalars on single values, the traps of each language's defaults among them."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuelake.functions import similarity as S
from cuelake.functions import structured as N
from cuelake.functions import text as T
from cuelake.functions import time as P


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("line", "want"),
    [("00:00:01,000 --> 00:00:02,500", (1000, 2500)), ("00:00:01.000 --> 00:00:02.500 extra", (1000, 2500)), ("junk", (0, 0)), ("00:00:03,000 --> 00:00:01,000", (3000, 1000)), ("01:02:03,004 --> 01:02:03,005", (3723004, 3723005))],
)
def test_lenient_times(spark, line, want):
    assert tuple(one(spark, P.bounds_or_zero(F.col("l")), l=line)) == want


@pytest.mark.parametrize("line", ["junk", "00:00:03,000 --> 00:00:01,000", "00:00:01,000 --> 00:00:02,500 extra"])
def test_strict_times_fail(spark, line):
    with pytest.raises(PySparkException):
        one(spark, P.bounds_or_fail(F.col("l"))["start_ms"], l=line)


def test_long_hours_are_strict_times(spark):
    assert tuple(one(spark, P.bounds_or_fail(F.col("l")), l="100:00:01,000 --> 100:00:02,000")) == (360001000, 360002000)


@pytest.mark.parametrize(("ms", "want"), [(0, "00:00:00,000"), (-5, "00:00:00,000"), (3723004, "01:02:03,004"), (360_000_000, "100:00:00,000")])
def test_format(spark, ms, want):
    assert one(spark, P.format_ms(F.col("m")), m=ms) == want


def test_format_rounds_half_to_even(spark):
    assert one(spark, P.format_seconds(F.col("s")), s=0.0025) == "00:00:00,002"
    assert one(spark, P.format_seconds(F.col("s")), s=0.0035) == "00:00:00,004"


@pytest.mark.parametrize(("text", "want"), [("90", 90.0), ("01:30", 90.0), ("1:00:01.5", 3601.5), ("x", None), ("1:2:3:4", None)])
def test_campaign_seconds(spark, text, want):
    assert one(spark, P.campaign_seconds(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "ok"), [("0.2,0.5,0.8", True), ("0.5,0.5", False), ("0,0.5", False), ("a", False)])
def test_fractions(spark, text, ok):
    assert (one(spark, P.parse_fractions(F.col("t")), t=text) is not None) == ok


def test_folding_and_classes(spark):
    assert one(spark, T.letters_only(F.col("t")), t="Straße, É_好 42!") == "strasseé好42"
    assert one(spark, T.word_characters(F.col("t")), t="É_好 42!") == "é_好42"
    assert one(spark, T.normalize_spoken(F.col("t")), t="  L’ÉTAT—c'est  42…  ") == "l'état c'est 42"
    assert one(spark, T.normalize_spoken(F.col("t")), t="ﬁne 'quoted' well-known") == "fine quoted well known"


def test_scripts(spark):
    assert one(spark, T.detect_script(F.col("t")), t="你好世界") == "zh"
    assert one(spark, T.detect_script(F.col("t")), t="これはテスト") == "ja"
    assert one(spark, T.detect_script(F.col("t")), t="안녕하세요") == "ko"
    assert one(spark, T.detect_script(F.col("t")), t="a long latin text with one 好") == "mixed"
    assert one(spark, T.target_length(F.col("t")), t="好的 abc") == 2
    assert one(spark, T.wide_lines_only(F.col("t")), t="Hello\n你好\nworld") == "你好"
    assert one(spark, T.reading_units(F.col("t")), t="ab 好.") == 2 * 2 + 2 + 4 + 1


def test_tokens_and_lines(spark):
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    assert one(spark, T.join_tokens(words(" Je", " c", "'est", "!"))) == "Je c'est!"
    assert one(spark, T.join_tokens(words("你", "好", "ok", "ok"))) == "你好ok ok"
    assert one(spark, T.best_line(words("ab", "longer one", "the longest"))) == "the longest"
    assert one(spark, T.best_line(words("1", "22"))) == ""
    assert one(spark, T.distinct_terms(F.col("t")), t="A, b , a,,B,c") == "A, b, c"


def test_redaction(spark):
    assert one(spark, T.redact(F.col("t")), t="api_key=abc Bearer xyz /home/me/file.srt") == "api_key=[redacted] Bearer [redacted] [path]"
    assert one(spark, T.mask_key(F.col("t")), t="sk-123456789") == "sk-...6789"
    assert one(spark, T.mask_key(F.col("t")), t="short") == "***"
    assert one(spark, T.safe_name(F.col("t")), t=' a<b>: "c"  d.. ') == "a-b-c-d"
    assert one(spark, T.safe_name(F.col("t")), t="???") == "media"


@pytest.mark.parametrize(("text", "want"), [("one two three one two three", True), ("one two one two", False), ("a b c d e f", False), ("", False)])
def test_repeated_phrase(spark, text, want):
    assert one(spark, T.repeated_phrase(F.col("t")), t=text) == want


def test_edit_counts():
    assert S.edit_counts("a b c".split(), "a x c d".split()) == (1, 1, 0)
    assert S.edit_counts("a b c".split(), []) == (0, 0, 3)
    assert S.edit_counts([], ["a"]) == (0, 1, 0)


def test_similarity(spark):
    assert one(spark, S.matching_ratio("a", "b"), a="hello world", b="hello word") == pytest.approx(0.952, abs=1e-3)
    assert one(spark, S.matching_ratio("a", "b"), a="", b="x") == 0
    assert one(spark, S.ngram_f1(F.col("a"), F.col("b")), a="", b="") == 1
    assert one(spark, S.ngram_f1(F.col("a"), F.col("b")), a="aaaa", b="aaa") == pytest.approx(0.8)


def test_bleu_of_equal_texts(spark):
    row = S.bleu_chrf(spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("", "x")], "candidate string, reference string")).collect()
    assert row[0].bleu == pytest.approx(100) and row[0].chrf == pytest.approx(100) and row[1].bleu == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": "x"} done', '{"a": "x"}'), ('{"a": 1 // note\n}', '{"a": 1}'), ('{"a": "say "hi" now"}', '{"a": "say \\"hi\\" now"}'), ("nothing", None), ('{"u": "http://x"}', '{"u": "http://x"}')],
)
def test_loose_json(spark, text, want):
    assert one(spark, N.loose_json("t"), t=text) == want


def test_answers(spark):
    assert one(spark, N.json_object(F.col("t")), t="[1]") is None
    assert one(spark, N.confidence(F.col("t")), t="0.5") == "medium"
    assert one(spark, N.id_set_error(F.array(F.lit(1), F.lit(1)), F.array(F.lit(1)))) == "duplicate"
    assert one(spark, N.drop_secrets(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("name"), F.lit("y")))) == {"name": "y"}


def test_subtitle_formats(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " ASS; srt,ass"), (4, "ass"), (5, "vtt,srt")], "k int, x string")
    made = rows.select("k", T.subtitle_formats(F.col("x")).alias("f"))
    assert [r.f for r in made.where("k < 5").orderBy("k").collect()] == [["srt"], ["srt"], ["ass", "srt"], ["srt", "ass"]]
    with pytest.raises(Exception, match="Unsupported subtitle format: vtt"):
        made.where("k = 5").collect()
