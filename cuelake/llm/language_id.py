"""Language identification by a string kernel (operator 4).

The blended-spectrum presence kernel counts the n-grams (of 2 to 4 bytes of the lower-cased text,
other ASCII than letters read as blanks) that two texts both have, whatever their number, and divides by the
geometric mean of how many of the alphabet each has. LANDMARKS documents of the learning rows, dealt evenly over the languages and two of each at least,
give the alphabet of n-grams (for each language those that most of its landmarks have) and the Nyström map; one-versus-rest kernel ridge
regression is solved on that map for about TRAIN_ROWS learning rows at most, dealt evenly
over the languages. A batch of texts is scored by two matrix products:
presence by landmarks, and that by weights.

A whole text counts, of any length (long ones in pieces that overlap). A text
that is null or has no letter is ``und`` with score 0; so is every text if there
is nothing to learn from. Rows with a null or empty lang teach nothing. Documents
that repeat are each predicted. Ties between languages go to the first by name. An empty table gives an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from cuelake.llm.common import arrow_task, materialize
from cuelake.llm.words import _buffers

SIZES = (2, 3, 4)
LANDMARKS = 128
TRAIN_ROWS = 6_000
#: n-grams of the landmarks that are kept: so many in all, or so many of each language if that is more.
ALPHABET, OF_EACH = 16_384, 512
RIDGE = 1e-3
#: Texts in one matrix product, and bytes of text looked at together.
ROWS, PIECE = 128, 1 << 20
_SLOTS = 20
_FACTOR = np.uint32(0x9E3779B1)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """The n-gram at each byte as a number; no two n-grams share one."""
    k = max(0, len(data) - n + 1)
    out = data[:k].astype(np.uint32)
    for i in range(1, n):
        out |= data[i : i + k].astype(np.uint32) << np.uint32(8 * i)
    return out


@dataclass
class Model:
    """alphabet: n-gram codes; landmarks: presence (n-gram, landmark); weights: (landmark, language)."""

    languages: list[str]
    alphabet: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    mean: np.ndarray

    def __post_init__(self):
        self.slot = np.full(1 << _SLOTS, -1, np.int32)
        self.slot[slots(self.alphabet)] = np.arange(len(self.alphabet))
        self.columns = self.landmarks.astype(np.float32)
        self.norms = np.sqrt(np.maximum(self.landmarks.sum(0), 1)).astype(np.float32)

    def kernel(self, texts: pa.Array) -> np.ndarray:
        """Kernel values (text, landmark)."""
        texts = texts.fill_null("")
        off, whole = _buffers(texts)
        has = np.zeros((len(texts), len(self.alphabet)), np.uint8)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(off, off[a] + PIECE, "right")) - 1)
            for start in range(int(off[a]), int(off[b]), PIECE):
                # pieces of one long text overlap by what an n-gram needs
                data = _FOLD[whole[start : min(int(off[b]), start + PIECE + SIZES[-1] - 1)]]
                row = np.repeat(np.arange(a, b), np.diff(off[a : b + 1])) if b - a > 1 else np.full(len(data), a)
                for n in SIZES:
                    c = codes(data, n)
                    at = self.slot[(c * _FACTOR) >> np.uint32(32 - _SLOTS)]
                    hit = np.flatnonzero(at >= 0)
                    at = at[hit]
                    ok = self.alphabet[at] == c[hit]
                    hit, at = hit[ok], at[ok]
                    inside = row[hit] == row[hit + n - 1]
                    has[row[hit[inside]], at[inside]] = 1
            a = b
        x = has.astype(np.float32)
        return (x @ self.columns) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) / self.norms

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.kernel(texts).astype(np.float64) @ self.weights + self.mean


def slots(alphabet: np.ndarray) -> np.ndarray:
    return (alphabet * _FACTOR) >> np.uint32(32 - _SLOTS)


def learns(doc_id: str = "doc_id", folds: int = 4, held: int = 2) -> Column:
    """The rows to learn from: crc32(doc_id as text) mod folds is not ``held``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) != held


def _alphabet(found: list[np.ndarray], languages: list[str]) -> np.ndarray:
    """n-grams of landmarks (each a sorted array) by language: those that most of its landmarks have, an equal share of each; an n-gram
    of one landmark alone only where nothing else is there."""
    share, kept, seen = max(OF_EACH, ALPHABET // len(set(languages))), [], []
    for name in sorted(set(languages)):
        every, count = np.unique(np.concatenate([x for x, own in zip(found, languages, strict=True) if own == name]), return_counts=True)
        if (count > 1).any():
            every, count = every[count > 1], count[count > 1]
        first = np.lexsort((every, -count))[:share]
        kept.append(every[first])
        seen.append(count[first])
    every, count = np.concatenate(kept), np.concatenate(seen)
    every, at = np.unique(every, return_inverse=True)
    count = np.bincount(at, count)
    every = every[np.lexsort((every, -count))]
    # one n-gram for each slot of the lookup: the more common
    _, first = np.unique(slots(every), return_index=True)
    return np.sort(every[first])


def train(docs: DataFrame, use: Column, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """A model of docs.lang, learned from texts of rows where ``use`` holds."""
    spark = docs.sparkSession
    able = docs.where(use & F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in docs.where(use & F.col("lang").isNotNull() & (F.col("lang") != "")).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = max(1, rows // len(counts))
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, share / n) * (1 << 30)))])
    picked = able.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= limit[F.col("lang")])
    sample = materialize(picked.select("text", "lang", F.xxhash64("doc_id", F.lit(1)).alias("h")), "language-sample")

    each = max(2, -(-landmarks // len(counts)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    chosen = sample.withColumn("rank", rank).where(F.col("rank") <= each).orderBy("rank", "lang").limit(max(landmarks, 2 * len(counts))).select("text", "lang")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, whole = _buffers(batch.column("text"))
            made = []
            for a, b in zip(off[:-1], off[1:], strict=True):
                data, held = _FOLD[whole[a:b]], np.zeros(0, np.uint32)
                for start in range(0, len(data), PIECE):
                    piece = data[start : start + PIECE + SIZES[-1] - 1]
                    held = np.union1d(held, np.concatenate([codes(piece, n) for n in SIZES]))
                made.append(held.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(made, pa.binary())], names=["lang", "codes"])

    got = sorted((r["lang"], bytes(r["codes"])) for r in chosen.mapInArrow(arrow_task(grams), "lang string, codes binary").collect())
    if not got:
        return None
    found = [np.frombuffer(x, np.uint32) for _, x in got]
    alphabet = _alphabet(found, [lang for lang, _ in got])
    presence = np.stack([np.isin(alphabet, x) for x in found], 1).astype(np.uint8)
    model = Model(sorted(counts), alphabet, presence, np.zeros((len(found), len(counts))), np.zeros(len(counts)))
    shared = spark.sparkContext.broadcast(model)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                k = shared.value.kernel(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in k], pa.binary())], names=["lang", "k"])

    got = sample.select("text", "lang").mapInArrow(arrow_task(kernels), "lang string, k binary").toArrow()
    order = sorted(zip(got["lang"].to_pylist(), got["k"].to_pylist(), strict=True))
    k = np.stack([np.frombuffer(x, np.float32) for _, x in order]).astype(np.float64)
    y = np.array([[float(lang == x) for x in model.languages] for lang, _ in order])
    # Nyström: features K W^(-1/2), with W the landmarks' own kernel
    p = presence.astype(np.float64)
    w = (p.T @ p) / np.outer(model.norms, model.norms)
    value, vector = np.linalg.eigh(w)
    keep = value > 1e-8 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    phi, mean = k @ root, y.mean(0)
    solved = np.linalg.solve(phi.T @ phi + RIDGE * len(y) * np.eye(phi.shape[1]), phi.T @ (y - mean))
    return Model(model.languages, alphabet, presence, root @ solved, mean)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (with text; without lang_pred and score) and these two."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, "und"], dtype=object) if shared.value else np.array(["und"], dtype=object)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                letter = np.array(batch.column("_letter").to_pylist(), bool)
                best, score = np.full(len(letter), len(names) - 1), np.zeros(len(letter))
                if shared.value:
                    s = shared.value.scores(batch.column("text"))
                    best, score = np.where(letter, s.argmax(1), best), np.where(letter, s.max(1).clip(0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    rows = docs.withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([*docs.schema.fields, StructField("_letter", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(arrow_task(run), schema).drop("_letter")


def language_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = train(docs.select("doc_id", "text", "lang"), learns())
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(~learns(), F.lit(False)).alias("held_out"), "lang_pred", "score")
