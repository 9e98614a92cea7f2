"""Benchmark decontamination (operator 9).

A broadcast hash set of the normalised n-grams (windows) of the benchmark;
tasks scan the token windows of whole documents against it, verify each hit
word by word, and mark the words. Documents are then dropped, or the spans cut.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window
is ``n`` consecutive words of an item; an item of fewer words, but not none,
is one window. Null and empty texts have no words and no windows; items that
repeat (same id, or same text) count once each by id; items without an id mark
words but are not listed. Documents that repeat are each scanned and kept; very long texts are scanned whole. Columns of
docs may have any names and come back as they are. An empty table gives none; an empty benchmark hits nothing.

The benchmark is broadcast in blocks of at most BLOCK windows: one scan of the
documents per block, each adding its marks, so that a benchmark of any size is
searched with bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cuelake.llm.common import arrow_task, materialize, restored, sheltered
from cuelake.llm.words import ALNUM, Words, words

N = 10
#: Windows in one broadcast (about 600 bytes each on the driver).
BLOCK = 250_000

_SPANS = "array<struct<start:int,end:int>>"


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """item_id, window (its words joined by a blank), size; distinct."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)).alias("w"))
    found = found.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    return (
        found.select("item_id", "w", F.explode(starts).alias("at"))
        .select("item_id", F.slice("w", F.col("at"), n).alias("w"))
        .select("item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("size"))
        .distinct()
    )


class _Block:
    """Windows of one broadcast: sorted hashes for the scan, words for the verification."""

    def __init__(self, rows: list[Row]):
        self.items: dict[bytes, list[str | None]] = {}
        for r in rows:
            self.items.setdefault(r["window"].encode(), []).append(r["item_id"])
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = {w: w.count(b" ") + 1 for w in self.items}
        for size in sorted(set(lengths.values())):
            texts = pa.array([w.decode() for w in self.items if lengths[w] == size])
            hashes = np.concatenate([s.grams(size)[0][s.grams(size)[1]] for s in words(texts, ALNUM)])
            hit = np.zeros(1 << 20, bool)
            hit[hashes >> np.uint64(44)] = True
            self.sizes[size] = np.unique(hashes), hit

    def scan(self, s: Words) -> Iterator[tuple[int, int, list[str | None]]]:
        """(first word, words, items) of each occurrence."""
        for size, (hashes, hit) in self.sizes.items():
            grams, valid = s.grams(size)
            at = np.flatnonzero(valid & hit[grams >> np.uint64(44)])
            at = at[np.isin(grams[at], hashes)]
            for i in at:
                text = b" ".join(s.data[a:b].tobytes() for a, b in zip(s.starts[i : i + size], s.ends[i : i + size], strict=True))
                if items := self.items.get(text):
                    yield int(i), size, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = N, block: int = BLOCK) -> DataFrame:
    """All rows and columns of docs (which needs ``text``), with _words (int),
    _spans (hit words from..to, merged) and _items (ids found, sorted)."""
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, n)
    # the check of the size: so many windows are in one broadcast at most
    blocks = max(1, -(-windows.count() // block))
    out = docs.withColumns({"_words": F.lit(0), "_spans": F.array().cast(_SPANS), "_items": F.array().cast("array<string>")})
    for k in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(_Block(part.collect()))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts = np.zeros(batch.num_rows, np.int32)
                spans, items = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
                for s in words(batch.column("text"), ALNUM):
                    counts[s.first : s.last] = np.diff(s.offsets)
                    found: dict[int, list] = {}
                    for at, size, ids in shared.value.scan(s):
                        found.setdefault(int(np.searchsorted(s.offsets, at, "right")) - 1, []).append((at, size, ids))
                    for row, hits in found.items():
                        base = int(s.offsets[row])
                        old = [(x["start"], x["end"]) for x in spans[s.first + row]]
                        spans[s.first + row] = [{"start": a, "end": b} for a, b in _merge(old + [(at - base, at - base + size) for at, size, _ in hits])]
                        items[s.first + row] = sorted({*items[s.first + row], *(x for *_, ids in hits for x in ids if x is not None)})
                made = {"_words": pa.array(counts), "_spans": pa.array(spans, batch.schema.field("_spans").type), "_items": pa.array(items, batch.schema.field("_items").type)}
                yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in batch.schema.names], schema=batch.schema)

        out = out.mapInArrow(arrow_task(scan), out.schema)
        if k + 1 < blocks:
            out = materialize(out, "decontamination")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, action: str = "drop") -> DataFrame:
    """docs without contaminated documents ("drop"), or with the hit spans cut
    from their texts ("cut": the words left, joined by blanks, lower-cased as
    compared). Clean documents stay as they are."""
    found = find_benchmark(sheltered(docs, "text"), benchmark, n)
    clean = F.size("_spans") == 0
    if action == "drop":
        return restored(found.where(clean), docs, "text")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    all_words = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    left = F.filter(all_words, lambda w, i: ~F.exists("_spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    return restored(found.withColumn("text", F.when(clean, F.col("text")).otherwise(F.array_join(left, " "))), docs, "text")


def contamination_report(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark, n)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda t, s: t + (s["end"] - s["start"]))
    return found.select(
        "doc_id", F.col("_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"),
    )


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
