"""Readers, writers and the stream of stage events."""

from __future__ import annotations

import datetime
import io
import time
import wave
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuelake.sources import archives, files, subtitles
from cuelake.streaming import stage_events as E

SRT = "\ufeff1\r\n00:00:01,000 --> 00:00:02,000\r\nHello\r\n  there \r\n\r\nx\r\n00:00:03,000 --> 00:00:04,000\r\nno number\r\n\r\n3\n00:00:05,000\nbad time\n\n4\n00:00:06,000 --> 00:00:07,000\n"


def content(spark, text):
    return spark.createDataFrame([("m", text)], "media_id string, content string")


def test_lenient_scan(spark):
    got = [(r.pos, r.number, r.text, r.start_ms) for r in subtitles.parse(content(spark, SRT)).orderBy("pos").collect()]
    assert got == [(1, 1, "Hello\nthere", 1000), (2, 3, "bad time", 0)]
    assert subtitles.parse(content(spark, SRT), least_lines=2).count() == 3
    assert subtitles.parse(content(spark, "")).count() == 0


def test_strict_scan_fails(spark):
    with pytest.raises(PySparkException):
        subtitles.parse(content(spark, SRT), subtitles.STRICT).collect()


def test_round_trip_through_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("7\n00:00:01,000 --> 00:00:02,000\nHi\n\n9\n00:00:03,000 --> 00:00:04,000\nYo\n")
    cues = subtitles.read(spark, str(tmp_path / "in"))
    assert [(r.number, r.text) for r in cues.orderBy("pos").collect()] == [(7, "Hi"), (9, "Yo")]
    made = subtitles.render(cues.withColumn("target", F.when(F.col("pos") == 1, "Salut")), "target").first().content
    assert made == "1\n00:00:01,000 --> 00:00:02,000\nHi\nSalut\n\n2\n00:00:03,000 --> 00:00:04,000\nYo\n"
    subtitles.write(cues.withColumn("media_id", F.lit("one")), str(tmp_path / "out"))
    assert "Hi" in spark.read.text(str(tmp_path / "out"), wholetext=True).first().value


def test_tables_with_loose_headers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Path,Sentence,other\na.wav,hello,1\n")
    got = files.read_table(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["audio", "transcript", "other"] and got.first().transcript == "hello"
    with pytest.raises(ValueError, match="transcript"):
        files.read_table(spark, str(tmp_path / "t.csv"), aliases={"transcript": ("nothing",)})
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"id": "x", "extra": 1}')
    (tmp_path / "j" / "b.json").write_text("{broken")
    assert [r.id for r in files.read_json(spark, str(tmp_path / "j"), "id string").collect()] == ["x"]


def wav(seconds, amplitude):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.full(int(8000 * seconds), int(32768 * amplitude), "<i2").tobytes())
    return out.getvalue()


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("g1/clip.wav", wav(4, 0.5))
        z.writestr("g1/clip.txt", "two words")
        z.writestr("g1/short.wav", wav(1, 0.5))
        z.writestr("g1/short.txt", "too short")
        z.writestr("g1/broken.wav", b"no")
        z.writestr("g1/broken.txt", "words")
    members = archives.read_archives(spark, str(tmp_path / "a.zip"))
    got = files.clip_candidates(members, members).collect()
    assert [(r.audio, r.transcript, r.group, r.seconds, round(r.rms, 3), r.words) for r in got] == [("g1/clip.wav", "two words", "g1", 4.0, 0.5, 2)]
    assert files.unsafe("../x") and files.unsafe("C:\\x") and files.unsafe("/x") and not files.unsafe("a/b..c")


def test_decoding(spark):
    rows = spark.createDataFrame([("\ufeffhi".encode(),), ("你好".encode("gb18030"),), (b"\xff\xfe\xff",), (None,)], "content binary")
    assert [r.x for r in rows.select(files.decoded("content").alias("x")).collect()] == ["hi", "你好", "ÿþÿ", None]


def event(k, task, stage, status, minute):
    return (datetime.datetime(2024, 1, 1, 10, minute), "run", task, stage, f"e{k}", status, 1.5, "token=abc")


def test_stage_events_as_a_stream(spark, tmp_path):
    rows = [event(0, "a", "extracting", "running", 0), event(1, "a", "transcribing", "running", 5), event(2, "b", "extracting", "failed", 7), event(3, "a", "completed", "completed", 59)]
    E.write_events(spark.createDataFrame(rows, E.SCHEMA), str(tmp_path / "e"))
    stream = E.read_events(spark, str(tmp_path / "e"))
    q = E.stage_counts(stream).writeStream.format("memory").queryName("stage_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.stage, r.status, r.n) for r in spark.table("stage_counts").collect()}
    batch = spark.read.schema(E.SCHEMA).json(str(tmp_path / "e"))
    assert got == {(r.stage, r.status, r.n) for r in E.stage_counts(batch).collect()} and len(got) == 4
    assert batch.first().summary == "token=[redacted]"
    assert {(r.task_id, r.stage) for r in E.latest_state(batch).collect()} == {("a", "completed"), ("b", "extracting")}
    q = E.track_tasks(stream).writeStream.format("memory").queryName("tasks").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        for _ in range(240):
            time.sleep(0.5)
            if spark.table("tasks").count() >= 2:
                break
    finally:
        q.stop()
    assert {(r.task_id, r.stage) for r in spark.table("tasks").collect()} == {("a", "completed"), ("b", "extracting")}


def test_logs(spark):
    lines = F.array(*[F.lit(x) for x in ["start", "error: one", "transcribing", "translating now", "ok"]])
    row = spark.range(1).select(E.stage_from_log(lines, {"transcrib": "asr", "translat": "mt"}).alias("s"), E.last_error(lines).alias("e")).first()
    assert (row.s, row.e) == ("mt", "error: one")


def test_windows_1252_transcripts_are_decoded(spark):
    raw = ["a\u2019b \u20ac5".encode("cp1252"), "\ufeffcaf\u00e9".encode(), b"", None]
    rows = spark.createDataFrame([(x and bytearray(x),) if x else (x,) for x in raw], "content binary")
    assert [r.x for r in rows.select(files.decoded_transcript("content").alias("x")).collect()] == ["a\u2019b \u20ac5", "caf\u00e9", "", None]
    with pytest.raises(Exception, match="neither UTF-8 nor Windows-1252"):
        spark.createDataFrame([(bytearray(b"\x81\xff"),)], "content binary").select(files.decoded_transcript("content")).collect()


def test_fingerprint_hashes_whole_files_up_to_two_pieces(spark):
    from hashlib import sha256

    from pyspark.sql import functions as F

    m = 1 << 20
    raw = [b"a" * 200 + b"x" + b"a" * 200, b"a" * 200 + b"y" + b"a" * 200, b"b" * m + b"c" * m, b"b" * m + b"-" + b"c" * m, b""]
    rows = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(raw)], "k int, content binary")
    got = [r.x for r in rows.select("k", files.fingerprint(F.col("content")).alias("x")).orderBy("k").collect()]
    assert got == [sha256(x if len(x) <= 2 * m else x[:m] + x[-m:]).hexdigest() for x in raw] and got[0] != got[1]
