"""Queries that write inputs of the driver's tables (documents of JSON, tables, archives, logs) and read them back."""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.bridge import table
from cuelake.functions import text as T
from cuelake.queries.registry import query
from cuelake.sources import archives, files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{files.scratch(spark)}/{name}-{uuid.uuid4().hex}"


_STATE = "task_id string, status string, quality double, created_at double"


@query("s13_s27_s28_states", "SELECT c_custkey::VARCHAR AS task_id, CASE WHEN c_nationkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal::DOUBLE END AS quality, NULL::DOUBLE AS created_at FROM customer WHERE c_custkey % 5 <> 0")
def states(spark: SparkSession, d: str) -> DataFrame:
    """State documents, a file each in tests' sizes and many a file at large ones; a fifth is corrupt, unknown keys go, absent ones are null."""
    k = F.col("c_custkey")
    good = F.to_json(F.struct(k.cast("string").alias("task_id"), F.when(F.col("c_nationkey") % 2 == 0, "completed").otherwise("failed").alias("status"), F.when(k % 3 != 0, F.col("c_acctbal").cast("double")).alias("quality"), F.lit(1).alias("unknown")))
    path = _folder(spark, "states")
    table(spark, d, "customer").select(F.when(k % 5 == 0, F.lit('{"task_id": "x", ')).otherwise(good)).write.text(path)
    return files.read_json_lines(spark, path, _STATE)


@query("k08_k09_k10_s19_tables", "SELECT n_name AS audio, 'of ' || n_name || chr(10) || 'two' AS transcript, n_regionkey::VARCHAR AS region, NULL AS size, ',' AS separator FROM nation UNION ALL SELECT p_name, 'a \"quoted\", ' || p_brand, NULL, p_size::VARCHAR, chr(9) FROM part")
def tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two kinds, as a CSV and a TSV with the union of their columns, read by what their headers mean."""
    a = table(spark, d, "nation").select(F.col("n_name").alias("FileName"), F.concat(F.lit("of "), "n_name", F.lit("\ntwo")).alias("Sentence"), F.col("n_regionkey").alias("region"))
    b = table(spark, d, "part").select(F.col("p_name").alias("FileName"), F.concat(F.lit('a "quoted", '), "p_brand").alias("Sentence"), F.col("p_size").alias("size"))
    out = []
    for rows, other, separator in ((a, b, ","), (b, a, "\t")):
        path = _folder(spark, "table")
        files.write_table(rows.unionByName(other.limit(0), allowMissingColumns=True), path, separator)
        out.append(files.read_table(spark, path, separator).withColumn("separator", F.lit(separator)))
    return out[0].unionByName(out[1])


def _tone(n: int) -> bytes:
    """A WAV file of so many seconds at a quarter of the full level."""
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes((8192).to_bytes(2, "little", signed=True) * (4000 * n) + (-8192).to_bytes(2, "little", signed=True) * (4000 * n))
    return raw.getvalue()


def tones(rows: DataFrame) -> DataFrame:
    """rows (archive, member, seconds) with content, a tone, instead of seconds; a few at a time, whatever the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, files.CONTENTS):
                some = batch.slice(at, files.CONTENTS)
                content = pa.array([_tone(n) for n in some.column("seconds").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("archive"), some.column("member"), content], names=["archive", "member", "content"])

    return rows.select("archive", "member", "seconds").mapInArrow(run, "archive string, member string, content binary")


def clip_archives(spark: SparkSession, d: str) -> str:
    """A folder with an archive for each nation, with a clip and a text for each of its suppliers."""
    rows = table(spark, d, "supplier").select(F.concat(F.lit("a"), F.col("s_nationkey").cast("string"), F.lit(".zip")).alias("archive"), F.concat(F.lit("set/"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string")).alias("stem"), (F.col("s_suppkey") % 7 + 1).cast("int").alias("seconds"), F.when(F.col("s_suppkey") % 4 == 0, " ").otherwise(F.col("s_name")).alias("text"))
    sound = tones(rows.withColumn("member", F.concat("stem", F.lit(".wav"))))
    name = F.when(F.col("seconds") % 2 == 1, F.concat(F.upper("stem"), F.lit(".TXT"))).otherwise(F.concat("stem", F.lit(".txt")))
    said = rows.select("archive", name.alias("member"), files.encoded("text", F.lit("utf-8-sig")).alias("content"))
    path = _folder(spark, "clips")
    archives.write_archives(sound.unionByName(said), path)
    return path


@query("s18_s22_s23_clips", "SELECT 'set/' || s_nationkey || '/s' || s_suppkey || '.wav' AS audio, s_name AS transcript, 'set/' || s_nationkey AS \"group\", (s_suppkey % 7 + 1)::DOUBLE AS seconds, 0.25::DOUBLE AS rms, 1 AS words FROM supplier WHERE s_suppkey % 7 + 1 >= 3 AND s_suppkey % 4 <> 0")
def archive_clips(spark: SparkSession, d: str) -> DataFrame:
    path = clip_archives(spark, d)
    return files.clip_candidates(archives.read_archives(spark, path, ".wav"), archives.read_archives(spark, path, ".txt")).drop("sha256")


@query("s18_members", "SELECT 'a' || s_nationkey || '.zip' AS archive, 'set/' || s_nationkey || '/s' || s_suppkey || '.wav' AS member, 44 + 16000 * (s_suppkey % 7 + 1) AS size FROM supplier WHERE s_nationkey IN (3, 11, 20) AND 44 + 16000 * (s_suppkey % 7 + 1) > 50000")
def archive_listing(spark: SparkSession, d: str) -> DataFrame:
    """Members of some archives by name and size; nothing is unpacked."""
    rows = archives.read_archives(spark, clip_archives(spark, d), content=False, split_bytes=1 << 16)
    return rows.where(F.col("archive").isin("a3.zip", "a11.zip", "a20.zip") & F.col("member").endswith(".wav") & (F.col("size") > 50_000)).select("archive", "member", "size")


@query("s26_subtitles_of_archives", "SELECT 'r' || n_regionkey || '.zip' AS archive, 'sub/' || n_name || '.srt' AS member, 'é ' || n_name AS text FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 1")
def subtitles_of_archives(spark: SparkSession, d: str) -> DataFrame:
    """The .srt members of archives, without those that are there already (a quarter)."""
    nation = table(spark, d, "nation").withColumn("member", F.concat(F.lit("sub/"), "n_name", F.when(F.col("n_nationkey") % 3 == 0, ".txt").otherwise(".srt")))
    packed = nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".zip")).alias("archive"), "member", F.concat(F.lit("é "), "n_name").cast("binary").alias("content"))
    path = _folder(spark, "subtitles")
    archives.write_archives(packed, path)
    return files.subtitles_to_add(archives.read_archives(spark, path, ".srt"), nation.where("n_nationkey % 4 = 1")).select("archive", "member", files.decoded("content").alias("text"))


@query("s14_media_files", "SELECT extension, count(*) AS n FROM (SELECT ['mp4', 'mkv', 'wmv', 'opus', NULL, NULL][p_partkey % 6 + 1] AS extension FROM part) WHERE extension IS NOT NULL GROUP BY extension")
def media_files(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("MP4", "mkv", "Wmv", "opus", "txt", "srt")])
    path = F.concat("p_name", F.lit("."), F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")))
    rows = files.only_media(table(spark, d, "part").select(path.alias("path")))
    return rows.groupBy(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension")).agg(F.count("*").alias("n"))


@query("s42_log_tail", "SELECT user_id AS run, place, event_type || ' ' || CASE WHEN event_id % 4 = 0 THEN 'token=[redacted]' ELSE event_id::VARCHAR END AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last five lines of each run, cleaned; the tail's length is the operator's."""
    line = F.concat_ws(" ", "event_type", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("token="), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string")))
    rows = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("ts"), "event_id", line.alias("line"))
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("ts"), F.desc("event_id")))
    return rows.withColumn("place", place).where("place <= 5").select("run", "place", T.redact(F.col("line")).alias("line"))


@query("s35_search", "SELECT doc_id, n_chars FROM documents WHERE lang = 'fr' AND n_chars > 500 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 ORDER BY n_chars DESC, doc_id LIMIT 50")
def search(spark: SparkSession, d: str) -> DataFrame:
    """A search's answers without those that a machine translated, the best first; the search's limit is the operator's."""
    k = F.col("doc_id")
    found = table(spark, d, "documents").where("lang = 'fr' and n_chars > 500").select("doc_id", F.col("n_chars").cast("double").alias("rating"), F.when(k % 3 == 0, F.lit(True)).alias("ai_translated"), (k % 5 == 0).alias("machine_translated"))
    return files.best_answers(found, 50, "doc_id").select("doc_id", F.col("rating").cast("long").alias("n_chars"))


@query("m18_fingerprint", "SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Whole contents (those of two MiB or less; of longer ones both ends, in a test)."""
    raw = F.col("text").cast("binary")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.octet_length(raw).cast("long").alias("size"), files.fingerprint(raw).alias("sha256"))
