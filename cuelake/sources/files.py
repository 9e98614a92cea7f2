"""Other inputs and outputs: JSON documents, tables with loose headers, archives, media listings."""

from __future__ import annotations

import io
import tempfile
import uuid
import wave
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

#: Extensions of media files.
VIDEO = ("mp4", "mkv", "mov", "avi", "wmv", "flv", "webm", "m4v")
AUDIO = ("mp3", "m4a", "aac", "flac", "ogg", "opus", "wma", "wav")
#: Header names that mean the same, in lower case.
ALIASES = {"audio": ("audio", "path", "file", "filename", "wav"), "transcript": ("transcript", "text", "sentence", "transcription")}


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents, each a row of the schema; unknown keys go, unreadable files are left out."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = spark.read.schema(StructType([*kind.fields]).add("_corrupt_record", "string")).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def read_table(spark: SparkSession, path: str, separator: str = ",", aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """A CSV or TSV with a header, columns renamed to what their aliases mean, case ignored."""
    rows = spark.read.csv(path, header=True, sep=separator, multiLine=True, escape='"')
    found = {c.strip().lower().lstrip("\ufeff"): c for c in rows.columns}
    picked = {name: next((found[a] for a in names if a in found), None) for name, names in aliases.items()}
    if missing := [name for name, c in picked.items() if c is None]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return rows.select(*[F.col(f"`{c}`").alias(name) for name, c in picked.items()], *[F.col(f"`{c}`") for c in rows.columns if c not in picked.values()])


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A document a line, each a row of the schema; unknown keys go, unreadable lines are left out."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType([*kind.fields, StructField("_corrupt_record", StringType())])
    made = spark.read.text(path).select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("s"))
    return made.where("s is not null and s._corrupt_record is null").select("s.*").drop("_corrupt_record")


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: ``spark.checkpoint.dir``; a temporary one in local mode alone, as in tests."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="cuelake-")
        context.setCheckpointDir(path)
    return path


#: Contents of files that Python is handed at a time at most.
CONTENTS = 64


def kept(rows: DataFrame) -> DataFrame:
    """rows, written to the shared folder and read again, so that loops do not run what came before anew."""
    path = f"{scratch(rows.sparkSession)}/kept-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Bytes that Python is handed at a time, about, where rows are large.
HANDED = 4 << 20


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands Python so many rows at a time at most, and HANDED bytes about, for contents that are large; the session's settings come back after."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": HANDED}
    was = {name: spark.conf.get(name) for name in names}
    for name, most in names.items():
        now = int(was[name].removesuffix("b"))
        spark.conf.set(name, str(most if now <= 0 else min(most, now)))
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


def only_media(listing: DataFrame, extensions: tuple[str, ...] = VIDEO + AUDIO) -> DataFrame:
    """The rows of a listing (path) that are media by their extension, whatever its case."""
    return listing.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))


def media_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = VIDEO + AUDIO) -> DataFrame:
    """path, size and modification time of media files below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return only_media(rows, extensions).select("path", F.col("length").alias("size"), "modificationTime")


def best_answers(found: DataFrame, most: int, key: str) -> DataFrame:
    """The ``most`` best-rated answers of a search (rating, ai_translated, machine_translated) that no machine translated."""
    by_machine = F.coalesce("ai_translated", F.lit(False)) | F.coalesce("machine_translated", F.lit(False))
    return found.where(~by_machine).orderBy(F.desc("rating"), key).limit(most)


def subtitles_to_add(members: DataFrame, present: DataFrame) -> DataFrame:
    """The .srt members (archive, member, content) that are not there already (member)."""
    return members.where(F.lower("member").endswith(".srt")).join(present.select("member").distinct(), "member", "left_anti").select("archive", "member", "content")


def unsafe(name: str) -> bool:
    """Absolute, with a drive, or upwards."""
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or (len(parts[0]) == 2 and parts[0][1] == ":")


@F.pandas_udf(StructType([StructField("seconds", DoubleType()), StructField("rms", DoubleType())]))
def wave_metrics(content: pd.Series) -> pd.DataFrame:
    """Duration and root mean square (0 to 1) of PCM WAV files; null for anything else."""
    out = []
    for raw in content:
        try:
            with wave.open(io.BytesIO(raw)) as w:
                width, n, rate = w.getsampwidth(), w.getnframes(), w.getframerate()
                data = np.frombuffer(w.readframes(n), np.uint8)
            if width == 1:
                x = data.astype(float) - 128
            else:
                data = data.reshape(-1, width)
                x = data[:, -1].astype(np.int8).astype(float)
                for k in range(width - 2, -1, -1):
                    x = x * 256 + data[:, k]
            scale = float(1 << (8 * width - 1))
            out.append((n / rate, float(np.sqrt(np.mean((x / scale) ** 2))) if len(x) else 0.0))
        except (wave.Error, EOFError, TypeError, ValueError, ZeroDivisionError):
            out.append((None, None))
    return pd.DataFrame(out, columns=["seconds", "rms"])


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 (a byte order mark dropped), else GB 18030, else Latin-1."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ("utf-8-sig", "gb18030"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                pass
        return raw.decode("latin-1")

    return content.map(one)


@F.pandas_udf(StringType())
def decoded_transcript(content: pd.Series) -> pd.Series:
    """UTF-8 (a byte order mark dropped), else Windows-1252; fails on anything else."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ("utf-8-sig", "cp1252"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                pass
        raise ValueError("transcript is neither UTF-8 nor Windows-1252")

    return content.map(one)


@F.pandas_udf(BinaryType())
def encoded(text: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes of the charset if it has the text and they are not UTF-8 for another text; otherwise UTF-8 with a byte order mark."""

    def one(x: str | None, name: str) -> bytes | None:
        if x is None:
            return None
        try:
            raw = x.encode(name)
            if raw.decode("utf-8-sig", "replace") == x or "\ufffd" in raw.decode("utf-8-sig", "replace"):
                return raw
        except UnicodeEncodeError:
            pass
        return x.encode("utf-8-sig")

    return pd.Series([one(x, c) for x, c in zip(text, charset, strict=True)], dtype=object)


#: Bytes hashed at each end of a file that is longer than two such pieces.
PIECE = 1 << 20


def fingerprint(content: Column) -> Column:
    """SHA-256 of all bytes up to two pieces, of the first and last piece beyond."""
    ends = F.concat(F.substring(content, 1, PIECE), F.substring(content, -PIECE, PIECE))
    return F.sha2(F.when(F.octet_length(content) <= 2 * PIECE, content).otherwise(ends), 256)


def clip_candidates(audio: DataFrame, texts: DataFrame, least: float = 3.0, most: float = 15.0) -> DataFrame:
    """Members .wav with the .txt of the same stem in the same archive: audio, transcript, group (its
    folder), seconds, rms, words, sha256; clips of ``least`` to ``most`` seconds with a word. Contents are measured before they meet and do not travel."""
    stem = F.lower(F.regexp_replace("member", r"\.[^./]*$", ""))
    sound = audio.where(F.lower("member").endswith(".wav")).select("archive", stem.alias("stem"), F.col("member").alias("audio"), wave_metrics("content").alias("m"), F.sha2("content", 256).alias("sha256"))
    with batches_of(audio.sparkSession, CONTENTS):
        sound = kept(sound)
    text = texts.where(F.lower("member").endswith(".txt")).select("archive", stem.alias("stem"), F.trim(decoded_transcript("content")).alias("transcript"))
    words = F.size(F.filter(F.split("transcript", r"\s+"), lambda x: x != ""))
    out = sound.where(f"m.seconds between {least} and {most}").join(text, ["archive", "stem"])
    out = out.select("audio", "transcript", F.regexp_extract("audio", r"^(.*)/[^/]*$", 1).alias("group"), "m.seconds", "m.rms", words.alias("words"), "sha256")
    return out.where("words >= 1")


def write_table(rows: DataFrame, path: str, separator: str = ",") -> None:
    """CSV or TSV with a header, columns by name; quotes are doubled."""
    rows.select(*sorted(rows.columns)).write.csv(path, header=True, sep=separator, mode="overwrite", escape='"')


def write_report(rows: DataFrame, path: str, keys: list[str]) -> None:
    """JSON lines, a nested document for each key."""
    rest = [c for c in rows.columns if c not in keys]
    rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows")).write.json(path, mode="overwrite")
