"""What the findings of round 3 found wrong."""

from __future__ import annotations

import difflib
import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.functions import similarity as S
from cuelake.functions import text as T
from cuelake.llm import substring_dedup
from cuelake.plans import stages as P
from cuelake.queries import streams
from cuelake.queries.registry import QUERIES
from cuelake.sources import archives, late


@pytest.mark.parametrize("keys", [0, 1_000_000])
def test_f1_long_lists_of_places_are_not_sent(spark, monkeypatch, keys):
    shared = " ".join(f"s{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"{shared} end{k}") for k in range(5)] + [(9, None), (8, "alone")], "doc_id long, text string")
    want = {r.doc_id: tuple(r) for r in substring_dedup.repeats_report(docs).collect()}
    assert want[3][1:3] == (61, 60) and want[9][1:3] == (0, 0)
    monkeypatch.setattr(substring_dedup, "BROADCAST_PLACES", 0)
    monkeypatch.setattr(substring_dedup, "BROADCAST_KEYS", keys)
    assert {r.doc_id: tuple(r) for r in substring_dedup.repeats_report(docs).collect()} == want
    # ten places of one document: the list itself is joined by shuffle, and at most its node is sent
    places = spark.createDataFrame([(1, [(k, k + 1) for k in range(10)])], "node long, _spans array<struct<start:int,end:int>>")
    plan = substring_dedup._by_node(docs.withColumn("node", F.col("doc_id")), places, "_spans", "left")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and (keys > 0) == ("BroadcastHashJoin" in plan)


def test_f2_repeated_phrases_of_long_texts(spark):
    def plain(w):
        return any(w[i : i + n] == w[i + n : i + 2 * n] for n in (3, 4, 5) for i in range(len(w) - 2 * n + 1))

    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(300)] + ["", "a b c a b c", "a b c a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in rows.select(T.repeated_phrase(F.col("t")).alias("x")).collect()] == [plain(t.split()) for t in texts]
    long = [" ".join(f"w{i * i % 9973}" for i in range(2500 + k)) for k in range(40)]
    began = time.time()
    rows = spark.createDataFrame([(t,) for t in [*long, f"{long[0]} x y z x y z"]], "t string")
    assert [r.x for r in rows.select(T.repeated_phrase(F.col("t")).alias("x")).collect()] == [False] * 40 + [True]
    assert time.time() - began < 20  # each place split the whole text anew


def test_f3_likeness_is_that_of_difflib():
    rng = random.Random(3)
    for _ in range(600):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(rng.choice([6, 40, 300]))))
        b = "".join(rng.choice(letters) if rng.random() < 0.1 else c for c in a) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        b = b[len(b) // 2 :] + b[: len(b) // 2] if rng.random() < 0.3 else b
        ratio = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert S.likeness(a, b) == ratio and S.alike(a, b, 0.78) == (ratio >= 0.78)


def test_f3_likeness_of_long_texts_is_fast():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ein", "ver", "heit", "be", "sch", "ung", "er"]) for _ in range(500)) for _ in range(6)]
    began = time.time()
    fast = [S.likeness(a, b) for a in texts for b in texts if a != b]
    took, began = time.time() - began, time.time()
    assert fast[:5] == [difflib.SequenceMatcher(None, texts[0], b, autojunk=False).ratio() for b in texts[1:]]
    assert took / 30 < (time.time() - began) / 5 / 2


def test_f4_rows_are_numbered_through_all_files(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(10 * k + i, 100 * i) for i in range(7)], "doc_id long, n_chars long").coalesce(1).write.mode("append").parquet(str(tmp_path / f"{k}"))
    table = tmp_path / "documents.parquet"
    table.mkdir()
    for k in range(3):
        next((tmp_path / f"{k}").glob("*.parquet")).rename(table / f"part-{k}.parquet")
    assert sorted((r.doc_id, r.row_index) for r in late.numbered(spark, str(table), ["doc_id"]).collect()) == [(10 * k + i, 7 * k + i) for k in range(3) for i in range(7)]
    got = QUERIES["s20_row_addresses"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.row_index) for r in got) == [(10 * k + i, 7 * k + i) for k in range(3) for i in range(4)]


def test_f5_a_call_that_fails_is_no_unsound_answer(spark):
    def model():
        def say(stage, q):
            if any("zz" in x["text"] for x in q["items"]):
                raise ValueError("no answer")
            return "what?" if any("??" in x["text"] for x in q["items"]) else json.dumps({"items": [{"id": x["id"], "translation": x["text"]} for x in q["items"]]})

        return say

    rows = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(["a", "zz", "??", "b"], 1)], "media_id long, scene long, pos long, text string")
    assert {r.pos: r.error for r in P.translated(rows, model).collect()} == {1: None, 2: "failed", 3: "not_json", 4: None}


@pytest.mark.parametrize("name, case, of, want", [("n17_review", 2, 9, "id"), ("n12_semantic_review", 4, 12, "ids")])
def test_f6_unknown_ids_are_no_event_s(spark, tmp_path, name, case, of, want):
    ids = sorted({k for around in (3_000_000, 5_000_000) for k in range(around - of, around + of + 1) if k % of == case})
    spark.createDataFrame([(k,) for k in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    assert {r.error for r in QUERIES[name](spark, str(tmp_path)).collect()} == {want}


def test_f10_f12_members_are_handed_over_a_few_at_a_time(spark, tmp_path):
    made = spark.createDataFrame([("a.zip", f"m{k:03}", bytes([k % 251]) * 100_000) for k in range(200)], "archive string, member string, content binary")
    archives.write_archives(made, str(tmp_path / "z"))
    reader = archives.ArchiveReader({"path": str(tmp_path / "z")})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(isinstance(b, pa.RecordBatch) and b.column("content").nbytes < archives.OUT_BYTES + 200_000 for b in batches)
    assert sorted((r.member, r.size, bytes(r.content)) for r in archives.read_archives(spark, str(tmp_path / "z")).collect()) == sorted((r.member, 100_000, bytes(r.content)) for r in made.collect())


def test_f11_f18_batches_do_not_grow_with_the_files_of_the_table(spark, tmp_path):
    import pathlib

    rows = spark.range(0, 1200, 1, 8).selectExpr("id as event_id", "timestamp_seconds(1700000000 + id * 2160) as ts", "id % 7 as user_id", "'click' as event_type", "1.0D as value", "'{}' as props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    path, parts = streams.arriving(spark, str(tmp_path))
    found = list(pathlib.Path(path.removeprefix("file://")).glob("*.json"))
    assert parts == 1 and len(found) == streams.BATCHES
