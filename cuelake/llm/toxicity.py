"""Toxicity by FTRL-proximal logistic regression (operator 5).

Features are the words of a whole text (A-Z lower-cased, letters, digits and
all non-ASCII), their bigrams and skip-grams (a word and the second after it),
hashed to ``2**BITS`` coordinates; each counts once in a document. FTRL-proximal
gives every coordinate its own rate and, by its L1 term, leaves most weights
at zero, so that the weights are a short list that is broadcast.

The model learns from about TRAIN_ROWS labelled rows at most (a hash of the id
picks them evenly), whose features are extracted over all tasks, and of those from so many that they
have about TRAIN_FEATURES features at most; FTRL, which is
sequential, then passes over this bounded sample in one task. Coordinates in
fewer than LEAST_ROWS of its rows are left out. Last, scale and intercept of the sparse model are
refitted to the sample (Platt), since L1 shrinks all weights.

Null and empty texts have no features and get the score of the intercept;
labelled rows with a null label are not learned from; a document with labels of
both kinds is learned from with each; rows equal in id, text and label are learned from once, and each scored. Very long
texts are scored as a whole. Without
labelled rows every score is PRIOR. Documents that are null in other columns,
or have more columns, make no difference.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cuelake.llm.common import arrow_task, materialize, restored, sheltered
from cuelake.llm.words import ALNUM, Words, mix, words

BITS = 22
TRAIN_ROWS = 20_000
#: Features of all rows to learn from (4 bytes each in the one task of FTRL, and about 30 while it begins).
TRAIN_FEATURES = 12_000_000
LEAST_ROWS = 4
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 0.01
#: The score when there is nothing to learn from.
PRIOR = 0.0
#: The intercept's coordinate.
INTERCEPT = 1 << BITS


def features(s: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of each word, bigram and skip-gram of a slice, with repeats."""
    h, row = s.hashes, s.row_of_word()
    two, in_two = s.grams(2)
    skip = mix(h[:-2] * np.uint64(0xD6E8FEB86659FD93) + h[2:])
    in_skip = row[:-2] == row[2:]
    rows = np.concatenate([row, row[:-1][in_two], row[:-2][in_skip]]) if len(h) > 2 else np.concatenate([row, row[:-1][in_two]]) if len(h) > 1 else row
    every = np.concatenate([h, two[in_two], skip[in_skip]]) if len(h) > 2 else np.concatenate([h, two[in_two]]) if len(h) > 1 else h
    return rows, (every >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Ftrl:
    """FTRL-proximal state: z and n of each coordinate; the last is the intercept."""

    z: np.ndarray
    n: np.ndarray

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        # the intercept is not held back
        w[-1] = -self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


@dataclass
class Model:
    """Non-zero weights by coordinate, in order, and the intercept."""

    at: np.ndarray
    w: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.w
        return out


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, y of about ``rows`` labelled documents at most, where ``use`` holds."""
    able = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_d"), (F.col("toxic") > 0).cast("int").alias("y"))
    able = able.where(use).distinct()  # two rows of an id at most
    rate = rows / max(rows, able.count())
    picked = able.where(F.pmod(F.xxhash64("_d"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    # the bound on the picked rows is the size check of this broadcast
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_d")).select("text", "y", F.xxhash64("doc_id", F.lit(2)).alias("h"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for s in words(batch.column("text"), ALNUM):
            row, at = features(s)
            key = np.unique(row << 32 | at)
            cut = np.searchsorted(key >> 32, np.arange(s.last - s.first + 1))
            found += [(key[a:b] & 0xFFFFFFFF).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        sizes = pa.array([len(x) // 4 for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("h"), sizes, pa.array(found, pa.binary())], names=["y", "h", "n", "at"])


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and intercept of sigmoid(scale * z + intercept), by Newton's method."""
    x = np.array([1.0, 0.0])
    for _ in range(40):
        q = 1.0 / (1.0 + np.exp(-np.clip(x[0] * z + x[1], -35, 35)))
        g, h = q - y, q * (1 - q) + 1e-6
        grad = np.array([(g * z).sum() + 0.1 * (x[0] - 1), g.sum() + 1e-3 * x[1]])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        x = x - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(x[0]), float(x[1])


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """FTRL over rows (each its coordinates, in any order of rows) and their labels.

    All rows' coordinates are one array, so that a task's memory is that and the state."""
    # the sample comes in no fixed order: by content first, for equal reruns
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), zlib.crc32(rows[i]), zlib.adler32(rows[i]), y[i]))
    flat, sizes, y = np.concatenate([rows[i] for i in order]), np.array([len(rows[i]) for i in order]), y[order]
    rows.clear()
    often = (np.bincount(flat, minlength=1 << BITS) >= LEAST_ROWS)[flat]
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(often, dtype=np.int32)])[np.cumsum(sizes)]
    flat = flat[often]
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    model = Ftrl(np.zeros(INTERCEPT + 1), np.zeros(INTERCEPT + 1))
    for k in range(PASSES):
        for i in np.random.default_rng(k).permutation(len(y)):
            model.learn(np.append(flat[begins[i] : ends[i]], INTERCEPT), int(y[i]))
    w = model.weights(slice(0, INTERCEPT))
    scale, bias = platt(np.array([w[flat[a:b]].sum() for a, b in zip(begins, ends, strict=True)]), y)
    at = np.flatnonzero(w)
    return Model(at, w[at] * scale, bias)


def train(docs: DataFrame, labels: DataFrame, use: Column, rows: int = TRAIN_ROWS) -> Model:
    """A model of labels.toxic, learned from documents where ``use`` (on _d, the id) holds."""
    sample = materialize(training_rows(docs, labels, use, rows).mapInArrow(arrow_task(_extract), "y int, h long, n long, at binary"), "toxicity-sample")
    same = ["y", "h", "n", F.xxhash64("at")]
    if not sample.groupBy(*same).count().where("count > 1").isEmpty():
        sample = materialize(sample.dropDuplicates(["y", "h", "at"]), "toxicity-sample")
    total = sample.agg(F.sum("n")).first()[0] or 0
    if total > TRAIN_FEATURES:
        sample = sample.where(F.pmod("h", F.lit(1 << 30)) < int(TRAIN_FEATURES / total * (1 << 30)))
    sample = sample.select("y", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, y = [], []
        for batch in batches:
            y += batch.column("y").to_pylist()
            made += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("at")]
        if made:
            m = fit(made, np.array(y))
            yield pa.RecordBatch.from_arrays([pa.array([*m.at, INTERCEPT], pa.int32()), pa.array([*m.w, m.bias], pa.float64())], names=["k", "w"])

    got = sample.coalesce(1).mapInArrow(arrow_task(run), "k int, w double").toArrow().sort_by("k")
    if not got.num_rows:
        return Model(np.zeros(0, np.int32), np.zeros(0), -np.inf if PRIOR == 0 else float(np.log(PRIOR / (1 - PRIOR))))
    k, w = got["k"].to_numpy(), got["w"].to_numpy()
    return Model(k[:-1], w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with text; without a score) and score (double): 0 to 1, higher where label 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast((model.at, model.w.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Model(*shared.value).table()
        bias = shared.value[2]
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for s in words(batch.column("text"), ALNUM):
                row, at = features(s)
                hit = np.flatnonzero(table[at])
                key = np.unique(row[hit] << 32 | at[hit])
                total[s.first : s.last] += np.bincount(key >> 32, table[key & 0xFFFFFFFF].astype(np.float64), s.last - s.first)
            p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(np.isneginf(total), PRIOR, p))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(arrow_task(run), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def learns(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """The rows to learn from: crc32(doc_id as text) mod folds is not 0."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) != 0


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, learns("_d"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(~learns(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; all columns stay as they are."""
    model = train(docs, labels, learns("_d"))
    return restored(score(sheltered(docs, "text"), model).where("score < 0.5"), docs, "text")
