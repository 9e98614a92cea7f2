"""Subtitle files: SRT to cues and back, with the readers' ways of taking errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions.time import bounds_or_fail, bounds_or_zero, time_line

LENIENT, STRICT, RAW = "lenient", "strict", "raw"


def blocks(text: Column) -> Column:
    """Blocks between blank lines, without a byte order mark, line ends unified."""
    t = F.regexp_replace(F.regexp_replace(text, r"^\x{feff}", ""), r"\r\n?", "\n")
    return F.filter(F.split(t, r"\n\s*\n"), lambda b: F.trim(b) != "")


def parse(files: DataFrame, mode: str = LENIENT, least_lines: int = 3) -> DataFrame:
    """files (media_id, content) to media_id, pos, number, time_line, text, start_ms, end_ms.

    lenient skips blocks of too few lines or without a number, and takes an
    unreadable time as 0; strict fails at either; raw keeps blanks in text lines."""
    rows = files.select("media_id", F.posexplode(blocks(F.col("content"))).alias("k", "block"))
    split = F.split("block", r"\n")
    cleaned = split if mode == RAW else F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("l", cleaned).withColumn("number", F.trim(F.get("l", F.lit(0))).try_cast("long"))
    good = (F.size("l") >= least_lines) & F.col("number").isNotNull()
    if mode == STRICT:
        rows = rows.withColumn("number", F.when(good, F.col("number")).otherwise(F.raise_error(F.concat(F.lit("malformed block: "), F.col("block"))).cast("long")))
    else:
        rows = rows.where(good)
    line = F.trim(F.get("l", F.lit(1)))
    text = F.array_join(F.slice("l", F.lit(3), F.greatest(F.size("l") - 2, F.lit(0))), "\n")
    bounds = bounds_or_fail(line) if mode == STRICT else bounds_or_zero(line)
    rows = rows.select("media_id", "k", "number", line.alias("time_line"), text.alias("text"), bounds.alias("b"))
    pos = F.row_number().over(Window.partitionBy("media_id").orderBy("k")).cast("long")
    return rows.select("media_id", pos.alias("pos"), "number", "time_line", "text", "b.start_ms", "b.end_ms")


def last_of_number(cues: DataFrame) -> DataFrame:
    """Where a number comes twice in a file, its last cue."""
    rank = F.row_number().over(Window.partitionBy("media_id", "number").orderBy(F.desc("pos")))
    return cues.withColumn("_r", rank).where("_r = 1").drop("_r")


def render(cues: DataFrame, translation: str | None = None) -> DataFrame:
    """cues to media_id, content: a file each, numbered from 1, with the
    translation (where there is one) below the text."""
    text = F.col("text") if translation is None else F.when(F.coalesce(F.trim(translation), F.lit("")) == "", F.col("text")).otherwise(F.concat_ws("\n", "text", translation))
    rows = cues.select("media_id", "pos", time_line(F.col("start_ms"), F.col("end_ms")).alias("line"), text.alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line", "text")))
    block = F.transform(ordered, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["line"], F.lit("\n"), x["text"], F.lit("\n")))
    return rows.groupBy("media_id").agg(F.array_join(block, "\n").alias("content"))


def read(spark: SparkSession, path: str, mode: str = LENIENT, least_lines: int = 3) -> DataFrame:
    """SRT files below a path; media_id is the file's path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.srt").select(F.col("_metadata.file_path").alias("media_id"), F.col("value").alias("content"))
    return parse(files, mode, least_lines)


def write(cues: DataFrame, path: str, translation: str | None = None) -> None:
    """Rendered files as rows of text, a folder for each media id."""
    made = render(cues, translation)
    made.select("media_id", F.col("content").alias("value")).write.partitionBy("media_id").option("lineSep", "\n").mode("overwrite").text(path)


def bilingual_targets(content: Column, wide: str) -> Column:
    """struct(source, target): the first line, and the later lines with the wide script."""
    lines = F.filter(F.transform(F.split(content, r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike(wide))
    return F.struct(F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("source"), F.array_join(rest, "\n").alias("target"))
