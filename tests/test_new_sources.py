"""Archives as a data source, late columns, streams of task states, terms, edits, medoids, campaigns and cleaned captions."""

from __future__ import annotations

import datetime
import difflib
import glob
import json
import os
import random
import tarfile
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuelake.functions import similarity as S
from cuelake.operators import campaign as C
from cuelake.operators import metrics as A
from cuelake.operators import terms as N
from cuelake.plans import cleaning as L
from cuelake.sources import archives, late
from cuelake.streaming import stage_events as E
from cuelake.streaming import task_states as T

# archives


def members(spark, path, **options):
    return sorted((r.archive, r.member, r.size, None if r.content is None else bytes(r.content)) for r in archives.read_archives(spark, str(path), **options).collect())


def test_members_of_archives_are_read_in_several_tasks(spark, tmp_path):
    want = []
    for name in ("a.zip", "sub/b.zip"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k in range(40):
                z.writestr(f"d/{k}.txt", f"{name} {k}" * 50)
                want.append((name, f"d/{k}.txt", len(f"{name} {k}" * 50), (f"{name} {k}" * 50).encode()))
            z.writestr("d/empty/", "")
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as t, tarfile.open(tmp_path / "e.tar", "w") as u:
        (tmp_path / "x").write_text("hello")
        for tar, name in ((t, "c.tar.gz"), (u, "e.tar")):
            for k in range(9):
                tar.add(tmp_path / "x", f"y{k}")
                want.append((name, f"y{k}", 5, b"hello"))
    (tmp_path / "_hidden.zip").write_text("no archive")
    assert members(spark, tmp_path) == sorted(want)
    rows = archives.read_archives(spark, str(tmp_path), split_bytes=2000)
    assert rows.rdd.getNumPartitions() > 8 and sorted((r.archive, r.member, r.size, bytes(r.content)) for r in rows.collect()) == sorted(want)
    assert members(spark, tmp_path / "a.zip") == sorted(w for w in want if w[0] == "a.zip")
    assert members(spark, tmp_path, content=False, suffix="1.TXT") == sorted((*w[:3], None) for w in want if w[1].endswith("1.txt"))


def test_filters_are_pushed_down(spark, tmp_path, capsys):
    for name in ("a.zip", "b.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k in range(20):
                z.writestr(f"{k}.{'wav' if k % 2 else 'txt'}", "x" * k)
    rows = archives.read_archives(spark, str(tmp_path))
    some = rows.where((F.col("archive") == "b.zip") & F.col("member").endswith(".wav") & (F.col("size") >= 7) & ~F.col("member").isin("9.wav"))
    assert sorted(r.member for r in some.collect()) == ["11.wav", "13.wav", "15.wav", "17.wav", "19.wav", "7.wav"]
    reader = archives.ArchiveReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([archives.ds.EqualTo(("archive",), "b.zip"), archives.ds.StringEndsWith(("member",), ".wav"), archives.ds.Not(archives.ds.EqualTo(("member",), "9.wav"))]))
    assert len(left) == 1 and isinstance(left[0], archives.ds.Not)
    assert [p[0] for part in reader.partitions() for p in part.parts] == ["b.zip"]
    # names alone decide: the broken member is never unpacked
    raw = bytearray((tmp_path / "b.zip").read_bytes())
    raw[raw.index(b"4.txt") + 5 : raw.index(b"4.txt") + 9] = b"\xff" * 4
    (tmp_path / "b.zip").write_bytes(bytes(raw))
    assert rows.where(F.col("member").endswith(".wav")).count() == 20
    with pytest.raises(PySparkException):
        rows.where(F.col("member") == "4.txt").collect()


def test_unsafe_members_fail_and_names_are_repaired(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        info = zipfile.ZipInfo("x")
        info.filename = "字幕.srt".encode("gb18030").decode("cp437")
        info.flag_bits = 0
        z.writestr(info, "x")
    raw = (tmp_path / "a.zip").read_bytes()
    flagged = raw.replace("字幕.srt".encode("gb18030").decode("cp437").encode(), "字幕.srt".encode("gb18030"))
    if flagged != raw:  # the library wrote the name as UTF-8: no such archive can be made with it
        assert archives._member_name(info) == "字幕.srt"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(PySparkException, match="unsafe"):
        archives.read_archives(spark, str(tmp_path / "b.zip")).collect()


def test_archives_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{k % 3}.zip", f"m/{k}", f"content {k}".encode()) for k in range(30)], "archive string, member string, content binary")
    (tmp_path / "out").mkdir()
    archives.write_archives(rows, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["n0.zip", "n1.zip", "n2.zip"]
    assert [(m[1], m[3]) for m in members(spark, tmp_path / "out")] == [(m, c) for _, m, c in sorted((a, m, bytes(c)) for a, m, c in rows.collect())]
    with pytest.raises(PySparkException):
        archives.write_archives(rows, str(tmp_path / "out"))
    archives.write_archives(rows.where("archive = 'n1.zip'"), str(tmp_path / "out"), "overwrite")
    assert sorted(os.listdir(tmp_path / "out")) == ["n1.zip"]
    with pytest.raises(PySparkException):
        archives.write_archives(rows.withColumn("member", F.lit("../x")), str(tmp_path / "bad"))
    assert not glob.glob(str(tmp_path / "bad" / "*"))


# late columns


def test_late_columns_by_address(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") / 4).cast("long").alias("key"), (F.col("id") % 7).alias("kind"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("heavy"))
    rows.repartitionByRange(5, "key").sortWithinPartitions("key").write.option("parquet.block.size", 1 << 18).parquet(str(tmp_path / "t"))
    for condition in ("key = 77", "key between 100 and 120 and kind = 3", "kind = 2 and key % 1000 = 1", "key < 0", "kind >= 0"):
        got = late.read_late(spark, str(tmp_path / "t"), ["key", "kind"], ["heavy"], F.expr(condition), "key")
        want = rows.where(condition)
        assert sorted((r.key, r.kind, r.heavy) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
        assert got.columns == ["key", "kind", "heavy", "file", "row_index"]


def test_late_scan_reads_the_chosen_rows_files_and_ranges(spark, tmp_path):
    spark.range(40_000).select(F.col("id").alias("key"), F.repeat(F.md5(F.col("id").cast("string")), 10).alias("heavy")).repartitionByRange(4, "key").sortWithinPartitions("key").write.option("parquet.block.size", 1 << 16).parquet(str(tmp_path / "t"))
    got = late.read_late(spark, str(tmp_path / "t"), ["key"], ["heavy"], F.expr("key in (5, 6, 12000)"), "key")
    assert got.count() == 3
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(key,5)" in plan and "LessThanOrEqual(key,6)" in plan
    some = late._ranges(spark.createDataFrame([(k,) for k in (1, 2, 3, 10_000, 10_001, 50_000)], "key long"), "key", 3)
    assert some == [(1, 3), (10_000, 10_001), (50_000, 50_000)]
    assert late._ranges(spark.createDataFrame([], "key long"), "key", 3) == []
    nulls = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "key long, heavy string")
    nulls.write.parquet(str(tmp_path / "n"))
    assert late.read_late(spark, str(tmp_path / "n"), ["key"], ["heavy"], F.lit(True), "key").count() == 3


# streams


def stage(k, task, name, status, minute):
    return (datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute), f"{k:03}", task, name, "e", status, 1.0, "x")


def transitions(spark, tmp_path, parts, name):
    for part in parts:
        E.write_events(spark.createDataFrame(part, E.SCHEMA).coalesce(1), str(tmp_path / name / "in"))  # a file, and so a batch, each
    stream = T.task_transitions(E.read_events(spark, str(tmp_path / name / "in"), "2 hours", 1), 600, 3600)
    T.write_once(stream, str(tmp_path / name / "out"), str(tmp_path / name / "check")).awaitTermination()
    rows = T.read_written(spark, str(tmp_path / name / "out"), "task_id string, from_stage string, stage string, status string, at timestamp, recovery string").collect()
    return sorted((r.task_id, (r.at - datetime.datetime(2024, 1, 1)).total_seconds() / 60, r.from_stage, r.stage, r.status, r.recovery) for r in rows)


def test_states_do_not_depend_on_batches(spark, tmp_path):
    rows = [stage(0, "a", "asr", "running", 0), stage(1, "a", "asr", "running", 5), stage(2, "a", "mt", "running", 9), stage(3, "a", "mt", "running", 30), stage(4, "a", "done", "completed", 31), stage(5, "a", "asr", "running", 120)]
    rows += [stage(6, "b", "asr", "running", 3), stage(7, "b", "asr", "failed", 4), stage(8, "b", "asr", "running", 20), stage(9, "c", "asr", "running", 400)]
    want = [
        ("a", 0, None, "asr", "running", "wait"), ("a", 9, "asr", "mt", "running", "wait"), ("a", 19, "mt", "mt", "stale", "resume"), ("a", 30, "mt", "mt", "running", "wait"), ("a", 31, "mt", "done", "completed", "none"),
        ("a", 120, None, "asr", "running", "wait"), ("a", 130, "asr", "asr", "stale", "resume"), ("b", 3, None, "asr", "running", "wait"), ("b", 30, "asr", "asr", "stale", "resume"),
    ]
    assert transitions(spark, tmp_path, [rows[:4], rows[4:]], "one") == want
    assert transitions(spark, tmp_path, [rows[:8:2], rows[1:8:2], rows[8:]], "other") == want


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    rows = [stage(k, f"t{k % 5}", "asr", "running", k) for k in range(40)]
    E.write_events(spark.createDataFrame(rows, E.SCHEMA).coalesce(1), str(tmp_path / "in"))
    for _ in range(2):
        stream = E.read_events(spark, str(tmp_path / "in"), files_at_once=1).select("task_id", "run_id")
        T.write_once(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert T.read_written(spark, str(tmp_path / "out"), "task_id string, run_id string").count() == 40
        # as after a crash between the write and its commit
        for f in glob.glob(str(tmp_path / "check" / "commits" / "*")) + glob.glob(str(tmp_path / "check" / "commits" / ".*.crc")):
            os.remove(f)


# terms


def test_terms_are_counted_in_one_pass(spark):
    rng = random.Random(6)
    texts = [(k, "".join(rng.choice("abß é") for _ in range(rng.randrange(60)))) for k in range(60)] + [(90, None), (91, "")]
    terms = sorted({"".join(rng.choice("abß é") for _ in range(rng.randrange(1, 4))) for _ in range(40)})
    want = {(k, t, (x or "").count(t)) for k, x in texts for t in terms if (x or "").count(t)}
    rows, low = spark.createDataFrame(texts, "k long, said string"), spark.createDataFrame([(t,) for t in [*terms, "", None]], "low string")
    for block in (N.BLOCK, 7):
        got = N.count_terms(rows, ["k"], "said", low, block).collect()
        assert {(r.k, r.low, r.n) for r in got} == want and len(got) == len(want)
        total = N.count_terms(rows, [], "said", low, block).groupBy("low").agg(F.sum("n").alias("n")).collect()
        assert {(r.low, r.n) for r in total} == {(t, sum(n for _, u, n in want if u == t)) for t in {t for _, t, _ in want}}
    assert N.count_terms(rows, ["k"], "said", low.where("low = ''")).count() == 0


# edits


def table_counts(reference, candidate):
    """The table of edit distances, cell by cell: of equal costs a substitution, then a deletion."""
    row = [(j, 0, j) for j in range(len(candidate) + 1)]
    for i, r in enumerate(reference, 1):
        before, row = row, [(i, 0, 0)]
        for j, c in enumerate(candidate, 1):
            d, s, n = before[j - 1]
            best = (d + (r != c), s + (r != c), n)
            best = best if before[j][0] + 1 >= best[0] else (before[j][0] + 1, *before[j][1:])
            row.append(best if row[-1][0] + 1 >= best[0] else (row[-1][0] + 1, row[-1][1], row[-1][2] + 1))
    return row[-1]


@pytest.mark.parametrize("kept", [1, 3, 256])
def test_edits_agree_with_the_table(monkeypatch, kept):
    monkeypatch.setattr(S, "_KEPT", kept)
    rng = random.Random(kept)
    for _ in range(1500):
        a, b = ([rng.choice("abé"[: rng.choice([1, 2, 3])]) for _ in range(rng.randrange(13))] for _ in range(2))
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        e = 0
        while e < min(len(a), len(b)) - k and a[-1 - e] == b[-1 - e]:
            e += 1
        cost, s, n = table_counts(a[k : len(a) - e], b[k : len(b) - e])
        assert S.edit_counts(a, b) == (s, n, cost - s - n) and S.edit_distance_of(a, b) == cost


def test_edits_of_long_texts_in_any_alphabet(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdéèñ你 好") for _ in range(20_000))
    changed = list(long)
    for at in rng.sample(range(0, 19_000, 3), 300):
        changed[at] = "Ω"
    pairs = [(long, "".join(changed)), (long, long[7:] + "xyz"), ("é" * 200, "è" * 200), ("kitten", "sitting"), ("", "abc"), (None, "a"), ("a" * 500, ""), ("", "")]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k long, a string, b string")
    got = {r.k: r.d for r in rows.select("k", S.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {0: 300, 1: 10, 2: 200, 3: 3, 4: 3, 5: None, 6: 500, 7: 0}


# medoids


def plain_medoid(texts, weights, first):
    like = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0
    return max(range(len(texts)), key=lambda k: (round(sum(w * like(texts[k], t) for t, w in zip(texts, weights, strict=True)), 9), len(texts[k]), -first[k]))


def test_medoids_agree_with_all_pairs():
    rng = random.Random(4)
    for _ in range(150):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 25)))
        texts = {"".join(rng.choice("abxyz") if rng.random() < 0.1 else c for c in base) if rng.random() < 0.8 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20))) for _ in range(rng.randrange(1, 12))}
        texts, first = sorted(texts), list(range(len(texts)))
        rng.shuffle(first)
        weights = [rng.randrange(1, 4) for _ in texts]
        assert A.medoid(texts, weights, first)[0] == plain_medoid(texts, weights, first)


def test_a_scene_of_a_thousand_readings_needs_few_comparisons():
    rng = random.Random(5)
    said = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))
    texts = {said}
    while len(texts) < 1000:
        read = list(said)
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 5])):
            read[rng.randrange(40)] = rng.choice("abcdefghijklmnopqrstuvwxyz0123456789")
        texts.add("".join(read))
    texts = sorted(texts)
    at, _, compared = A.medoid(texts, [1] * 1000, list(range(1000)))
    assert texts[at] == said and compared <= 100_000


# campaigns


def clip(sample, profile, k, errors, words=20, insertions=0, empty=False):
    return (sample, f"g{sample[-1]}", profile, k, errors, insertions, 0, words, empty)


CLIPS = "sample string, source_group string, profile string, clip long, substitutions long, insertions long, deletions long, words long, empty boolean"


def test_promotion_and_its_reasons(spark):
    rows = [clip(f"s{s}", p, k, e) for s in range(5) for k in range(30) for p, e in (("old", 4), ("new", 2), ("same", 4))]
    rows += [clip(f"s{s}", "worse", k, 8 if s == 0 else 1, insertions=5 if k == 0 else 0, empty=k == 1) for s in range(5) for k in range(30)]
    clips = spark.createDataFrame(rows, CLIPS)
    pairs = spark.createDataFrame([("old", "new"), ("old", "same"), ("old", "worse"), ("new", "old")], "left string, right string")
    got = {(r.left, r.right): (r.decision, r.reasons) for r in C.promotion(clips, pairs, C.intervals(clips, pairs, "s", 300)).collect()}
    assert got == {("old", "new"): ("promote", ""), ("old", "same"): ("keep", "interval,gain"), ("old", "worse"): ("keep", "severe,insertions,hallucinations,empty"), ("new", "old"): ("keep", "interval,gain,samples,severe")}
    none = C.promotion(clips, pairs, C.intervals(clips, pairs, "s", 10).where("false")).where("right = 'new'").first()
    assert (none.decision, none.reasons) == ("keep", "interval")


def test_campaign_metrics_by_level(spark):
    clips = spark.createDataFrame([clip("s1", "p", 0, 3), clip("s1", "p", 1, 1), clip("s2", "p", 0, 4, 10, 4), clip("s2", "q", 0, 0, 0)], CLIPS)
    runs = spark.createDataFrame([("s1", "p", 2.5, 100), ("s2", "p", 1.0, 300)], "sample string, profile string, seconds double, memory_mib long")
    got = {(r.level, r.sample, r.profile, r.metric): r.value for r in C.metrics(clips, runs).collect()}
    assert got["sample", "s1", "p", "wer"] == 0.1 and got["corpus", None, "p", "wer"] == round(12 / 50, 8) and got["corpus", None, "p", "seconds"] == 3.5 and got["corpus", None, "p", "memory_mib"] == 300
    assert got["sample", "s2", "p", "hallucinations"] == 1 and got["corpus", None, "q", "wer"] == 0 and ("corpus", None, "q", "seconds") not in got
    assert C.retry_decision(spark.createDataFrame([(True, True, False), (True, False, None)], "planned boolean, executed boolean, accepted boolean")).first().decision == "dry_run"
    a = spark.createDataFrame([("s1", 1, "ab"), ("s1", 2, "c"), ("s2", 1, "x")], "sample string, pos long, plain string")
    b = spark.createDataFrame([("s1", 1, "a"), ("s1", 2, "bc"), ("s2", 1, "y")], "sample string, pos long, plain string")
    assert {(r.sample, r.text_preserved, r.decision) for r in C.preserved(a, b).collect()} == {("s1", True, "reject"), ("s2", False, "reject")}


# cleaned captions


def test_captions_are_cleaned_once_and_merged(spark):
    captions = spark.createDataFrame([(1, k, k * 1000, k * 1000 + 900, t) for k, t in enumerate(["un\none", "deux\ntwo", "\nthree", "quatre\n", "cinq\nfive", "cinq\nfive!", "", "huit\neight"], 1)], "media_id long, pos long, start_ms long, end_ms long, text string")
    heard = spark.createDataFrame([(1, 1, 2900, 3200, "trois"), (1, 2, 3100, 3300, "trois"), (1, 3, 7000, 7500, "sept")], "media_id long, pos long, start_ms long, end_ms long, text string")
    asked = []

    def model():
        def say(name, q):
            ids = [x["id"] for x in q["items"]]
            if 8 in ids:
                return json.dumps({"items": [{"id": 8, "translation": "one line"}]})
            if 2 in ids:
                assert [x["id"] for x in q["context_before"]] == [1] and [x["id"] for x in q["context_after"]] == [4, 5]
                return json.dumps({"items": [{"id": x["id"], "translation": f" {x['ocr_source'] or x['heard']} \n\n{x['ocr_target']}."} for x in q["items"]]})
            raise ValueError("out of order")

        return say

    done = spark.createDataFrame([(1, 1, "un\nONE"), (1, 6, "cinq\nfive")], "media_id long, pos long, text string")
    got = L.cleaned(captions, heard, model, done, size=2)
    assert [(r.pos, r.source, r.target, r.origin) for r in got.orderBy("pos").collect()] == [
        (1, "un", "ONE", "saved"), (2, "deux", "two.", "model"), (3, "trois", "three.", "model"), (4, "quatre", "", "incomplete"), (5, "cinq", "five", "ocr"), (6, "cinq", "five", "saved"), (7, "sept", "", "incomplete"),
        (8, "huit", "eight", "ocr"),
    ]
    assert [(r.pos, r.start_ms, r.end_ms, r.source, r.n) for r in L.merged(got).orderBy("pos").collect()][4:6] == [(5, 5000, 6900, "cinq", 2), (6, 7000, 7900, "sept", 1)]
    row = L.summary(got, {}).first()
    assert (row.source_cues, row.cues, row.n_merged, row.n_model, row.n_ocr, row.n_incomplete, row.n_repeated) == (8, 7, 1, 4, 2, 2, 1) and not asked
