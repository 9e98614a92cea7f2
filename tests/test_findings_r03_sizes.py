"""What the findings of round 3 found to grow too fast."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuelake.functions import answers as S
from cuelake.functions import similarity
from cuelake.operators import campaign as C
from cuelake.operators import evidence as E
from cuelake.operators import sequences as W
from cuelake.plans import planning as P
from cuelake.plans import stages as G
from cuelake.queries.registry import QUERIES

TRACK = "media_id long, pos long, text string, start_ms long, end_ms long"


def test_f8_a_word_costs_the_same_in_long_texts(spark, tmp_path):
    texts = [" ".join(f"w{k}x{i}" for i in range(2000)) for k in range(60)]
    spark.createDataFrame([(k, 1, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    began = time.time()
    got = QUERIES["w12_w13_w14_resegment"](spark, str(tmp_path)).collect()
    assert {r.fallback for r in got} == {None} and sorted(w for r in got for w in r.text.split()) == sorted(w for t in texts for w in t.split())
    assert time.time() - began < 40  # each word split its whole text anew


def test_f8_words_without_a_length_stay_cheap(spark):
    words = spark.createDataFrame([(1, k, f" w{k}" if k % 3 else ",", 5, 5) for k in range(20_000)], TRACK)
    began = time.time()
    (cue,) = W.resegment(words).collect()
    assert cue.n_words == 20_000 and cue.text == "".join(f" w{k}" if k % 3 else "," for k in range(20_000))
    assert time.time() - began < 20


def test_f8_units_of_joined_words_are_those_of_the_text():
    rng = random.Random(8)
    for _ in range(500):
        text, units, inside, latin = "", 0, False, False
        for _ in range(rng.randrange(1, 6)):
            token = rng.choice(["", " "]) + "".join(rng.choice("aZé1.,好 -") for _ in range(rng.randrange(1, 5))) + "x"
            word, n, begins, goes_on, blank, closing, first, last, *_ = W._token(token)
            gap = bool(text) and not closing and (blank or (latin and first))
            text += " " + word if gap else word
            units += n - 2 * (inside and begins and not gap)
            inside, latin = goes_on, last
        assert units == W._units(text)


@pytest.mark.parametrize("printed", [4, 1024])
def test_f8_prints_do_not_depend_on_cuts(spark, monkeypatch, printed):
    monkeypatch.setattr(W, "PRINTED", printed)
    one = spark.createDataFrame([(1, 1, "Eins, zwei. Drei vier!"), (2, 1, "ab"), (3, 1, "?!")], "media_id long, pos long, text string")
    two = spark.createDataFrame([(1, 1, "eins"), (1, 2, "-"), (1, 3, "zweidrei vie"), (1, 4, "R"), (2, 1, "b"), (2, 2, "a"), (3, 1, "")], "media_id long, pos long, text string")
    a, b = W._text_print(one, "p", "media_id"), W._text_print(two, "q", "media_id")
    got = {r.media_id: (r.p, r.q) for r in a.join(b, "media_id", "full").collect()}
    assert got[1][0] == got[1][1] and got[1][0].n == 16 and got[2][0] != got[2][1] and 3 not in got


def test_f16_f20_islands_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(W, "FOLDED", 5)
    rows = spark.range(0, 60_000).selectExpr("id % 3 as media_id", "id as pos", "concat('line ', id div 6) as text", "id * 1000 as start_ms", "id * 1000 + 500 as end_ms", "0 as logprob_milli")
    began = time.time()
    got = W.merge_similar(rows).collect()
    assert time.time() - began < 30  # a call for each of 60,000 islands
    assert len(got) == 60_000 and all(sorted(r.pos for r in got if r.media_id == m) == list(range(1, 20_001)) for m in range(3))
    touching = rows.withColumn("end_ms", F.col("start_ms") + 3000)
    assert sorted((r.media_id, r.pos, r.text) for r in W.merge_similar(touching, gap_ms=10, similarity=0.999).collect())[:2] == [(0, 1, "line 0"), (0, 2, "line 1")]


def test_f15_altered_rows_are_counted_in_one_pass(spark):
    a = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k long, t string")
    b = spark.createDataFrame([(1, "a"), (2, None), (2, None), (2, None), (4, "c")], "k long, t string")
    got = P.altered(a, b, ["k", "t"])
    assert sorted(map(str, map(tuple, got.collect()))) == ["(1, 'a', 'before')", "(2, None, 'after')", "(2, None, 'after')", "(3, 'c', 'before')", "(4, 'c', 'after')"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.count("Aggregate") == 1  # two differences read both sides twice


def test_f15_the_query_reads_its_cues_from_where_they_are_kept(spark):
    assert "Window" not in QUERIES["f32_altered"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("schema", [S.video_analysis, S.typed_glossary, S.speakers, S.semantic_review])
def test_f19_f22_answers_are_parsed_once(spark, schema):
    rows = spark.range(3).withColumn("t", F.concat(F.lit('{"video_summary": "'), F.col("id").cast("string"), F.lit('"}')))
    plan = rows.select(schema(F.col("t"), F.array("id")).alias("a"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") == 1


def test_f13_f14_questions_are_handed_over_a_few_at_a_time(spark):
    def watched(questions, *args):
        def sizes(batches):
            for pdf in batches:
                yield pdf.assign(answer=str(len(pdf)))

        return questions.mapInPandas(sizes, "media_id long, question string, answer string")

    rows = spark.range(0, 500, 1, 1).selectExpr("id as media_id", "concat('{', repeat('x', 100000), '}') as question")
    was = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(G, "ask", watched)
        made = G.request(rows, None, "review", lambda a: F.struct(F.lit(None).cast("string").alias("error"))).collect()
    assert len(made) == 500 and max(int(r.answer) for r in made) <= 64 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == was


def test_f21_grams_that_both_sides_have():
    rng = random.Random(21)
    for letters, most in (("ab", 6), ("abcdefgh é", 6), ("".join(map(chr, range(200, 9000))), 6)):
        left = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(40)] + ["", letters]
        right = [x[:5] + x[8:] if k % 2 else "".join(rng.choice(letters) for _ in range(rng.randrange(30))) for k, x in enumerate(left)]
        grams = lambda x, n: Counter(x[k : k + n] for k in range(len(x) - n + 1))
        want = [[(grams(a, n) & grams(b, n)).total() for a, b in zip(left, right, strict=True)] for n in range(1, most + 1)]
        assert similarity.gram_hits(left, right, most).tolist() == want
    assert similarity.gram_hits([], [], 4).shape == (4, 0) and similarity.gram_hits([[]], [[]], 4).tolist() == [[0]] * 4


def test_f21_grams_of_long_texts_are_fast():
    rng = random.Random(22)
    left = ["".join(rng.choice("abcdefghijklmnop") for _ in range(600)) for _ in range(640)]
    began = time.time()
    for at in range(0, 640, 64):
        similarity.gram_hits(left[at : at + 64], left[at : at + 64], 6)
    took, began = time.time() - began, time.time()
    for x in left[:64]:
        for n in range(1, 7):
            Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1))
    assert took / 10 < (time.time() - began)


def test_f17_clips_are_made_once_for_all_pairs(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(x):
        made.add(1)
        return x

    rows = spark.range(40).selectExpr("concat('s', id % 4) as sample", "'g' as source_group", "concat('p', id % 2) as profile", "id div 2 as clip", "cast(id % 5 as int) as s", "0 as deletions", "1 as insertions", "9 as words")
    clips = rows.select("*", seen("s").alias("substitutions"))
    clips = clips.withColumn("sample", F.lit("s"))
    pairs = spark.createDataFrame([("p0", "p1"), ("p1", "p0")], "left string, right string")
    assert {r.n for r in C.intervals(clips, pairs, "x", 50).collect()} == {20}
    assert made.value == 40


def test_f23_questions_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x

    questions = spark.range(30).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), seen(F.repeat(F.lit("a"), F.col("id").cast("int"))).alias("a"), F.lit("aaaaa").alias("b"), F.col("id").alias("place"))
    cache = questions.where("place % 5 = 0").select("key", F.lit("TIE").alias("preference"))
    got = E.judged(questions, cache, lambda: lambda a, b: "A" if len(a) > len(b) else "B", 7).collect()
    assert sorted((o, sum(r.origin == o for r in got)) for o in {r.origin for r in got}) == [("cache", 6), ("judge", 7), ("over budget", 17)]
    assert made.value == 30
