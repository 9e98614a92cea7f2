"""Late materialization: light columns decide, heavy ones are read where they are needed.

Rows are known by their address (file and row index), so ids need not be unique. The
second scan reads the chosen files alone, and of these the row groups and pages that can hold a
chosen row by the statistics of a key column; the addresses decide the rest. Files sorted by the key gain most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.sources.files import kept

#: Files named in the second scan, and ranges of the key it asks for, at most.
FILES, RANGES = 10_000, 64


def addressed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of Parquet files, with file and row_index of each row."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))


def numbered(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """addressed, with row_index counted through all files in the order of their names."""
    rows = addressed(spark, path, columns)
    files = addressed(spark, path, []).groupBy("file").agg(F.count("*").alias("n"))  # a row for each file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(files.select("file", before.alias("_before"))), "file").withColumn("row_index", F.col("row_index") + F.col("_before")).drop("_before")


def _ranges(chosen: DataFrame, key: str, most: int) -> list[tuple]:
    """(least, most) of the key in runs of chosen rows: cut at the widest gaps between ``8 * most`` buckets of it."""
    ends = chosen.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    if ends["a"] is None:
        return []
    if not isinstance(ends["a"], int) or ends["b"] - ends["a"] < most:
        return [(ends["a"], ends["b"])]
    width = (ends["b"] - ends["a"]) // (8 * most) + 1
    found = chosen.where(F.col(key).isNotNull()).groupBy(F.floor((F.col(key) - ends["a"]) / width).alias("k")).agg(F.min(key).alias("a"), F.max(key).alias("b")).orderBy("a").collect()  # 8 * most rows
    gaps = sorted(((y["a"] - x["b"], n) for n, (x, y) in enumerate(zip(found, found[1:], strict=False))), reverse=True)[: most - 1]
    cuts = sorted(n + 1 for _, n in gaps)
    return [(found[a]["a"], found[b - 1]["b"]) for a, b in zip([0, *cuts], [*cuts, len(found)], strict=True)]


def read_late(spark: SparkSession, path: str, light: list[str], heavy: list[str], condition: Column, key: str, files: int = FILES, ranges: int = RANGES) -> DataFrame:
    """light, heavy, file, row_index of the rows that meet the condition on light columns (key is one of them, an integer gains most)."""
    chosen = kept(addressed(spark, path, light).where(condition))
    names = [r["file"] for r in chosen.select("file").distinct().limit(files + 1).collect()]
    rows = addressed(spark, path, sorted({key, *heavy} - {"file", "row_index"}))
    found = [F.col(key).between(a, b) for a, b in _ranges(chosen, key, ranges)]
    if chosen.where(F.col(key).isNull()).isEmpty():
        rows = rows.where(reduce(Column.__or__, found)) if found else rows.where(F.lit(False))
    if len(names) <= files:
        rows = rows.where(F.col("file").isin(names))
    late = rows.select(F.col("file").alias("_file"), F.col("row_index").alias("_row"), *heavy)
    joined = chosen.join(late, (F.col("file") == F.col("_file")) & (F.col("row_index") == F.col("_row")))
    return joined.select(*light, *[c for c in heavy if c not in light], "file", "row_index")
