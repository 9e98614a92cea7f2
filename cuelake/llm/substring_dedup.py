"""Substring deduplication (operator 13).

A window is ``n`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged) of one
document. Words go that are covered by a window whose words also stand in a
document with a smaller id. All windows are judged on the input.

1. *Pieces.* A window's key is the least hash of its ``GRAM``-word sequences, so
   equal windows have equal keys wherever they stand. Neighbouring windows of
   one key are a piece: some 4 rows for each 100 words, without their text.
2. Keys that only one document has go: no window of theirs repeats. Pieces are
   then told apart by a hash of all their windows. All but the first document
   of a piece lose it whole. Keys with a single piece need nothing more.
3. *Reference shards.* Of other keys, each distinct piece is read once, from its
   first document, and dealt to shards of about ``SHARD_WORDS`` words by its
   key. A shard's task streams the pieces, by document, through the suffix
   automaton of what came before: the matching statistics say which windows
   stood in a smaller document; the windows that did not are added to the automaton.
4. A key with more than ``HOT`` distinct pieces (a phrase in ever other
   surroundings) would fill a shard: its windows are counted by their MD5 instead.

An automaton is not sent to all tasks: that would stream the whole corpus through
every shard. It stays where the pieces that can match it are. What is sent
to tasks are lists of ``BROADCAST_PLACES`` places at most; longer ones are joined by shuffle,
before which the nodes alone (``BROADCAST_KEYS`` at most) say which texts have a place.

Null texts have no words. Documents without an id lose nothing and nothing is lost
for them. Rows that repeat an id do not see each other; rows equal in id and text get
the same result. Repeats within a document alone stay. Very long texts are read
whole; a text in which one window repeats is cut in pieces of ``LONGEST`` windows. Other columns may have any
names and come back as they are from ``dedup_passages``. An empty table gives none.
Words are compared by 64-bit hashes in order: a wrong match needs a collision at
the one place where two windows of 50 words differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import BROADCAST_KEYS, arrow_task, materialize, restored, sheltered
from cuelake.llm.words import BASE, UNCHANGED, Words, mix, words

N = 50
#: Words of the sequences whose least hash is a window's key.
GRAM = 8
#: Windows in a piece at most.
LONGEST = 64
#: Words of the pieces in a shard, on average.
SHARD_WORDS = 100_000
#: Distinct pieces of a key that go to a shard at most.
HOT = 1000
#: Places (of some 60 bytes) that are sent to tasks at most; the driver holds them too.
BROADCAST_PLACES = 20_000


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * BASE + b)


def _grams(h: np.ndarray, n: int, made: dict[int, np.ndarray]) -> np.ndarray:
    """The hash of the n words from each word on, from hashes of twice as many words at a time (kept in made)."""
    size, out, at = 1, None, 0
    made.setdefault(1, h)
    while size <= n:
        if size not in made:
            half = made[size // 2]
            made[size] = _joined(half[: len(half) - size // 2], half[size // 2 :]) if len(half) > size // 2 else half[:0]
        if n & size:
            part = made[size][at:]
            out = part if out is None else _joined(out[: len(part)], part[: len(out)])
            at += size
        size *= 2
    return out[: max(0, len(h) - n + 1)]


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each place on."""
    size, m = 1, x
    while size * 2 <= n:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    k = len(x) - n + 1
    return np.minimum(m[:k], m[n - size : n - size + k])


def _pieces(s: Words, n: int) -> tuple[np.ndarray, ...]:
    """row, key, hash, first word (in the slice), windows of each piece."""
    gram = min(GRAM, n)
    k = len(s.hashes) - n + 1
    nothing = np.zeros(0, np.int64)
    if k <= 0:
        return nothing, nothing, nothing, nothing, nothing
    made: dict[int, np.ndarray] = {}
    window, key = _grams(s.hashes, n, made), _least(_grams(s.hashes, gram, made), n - gram + 1)
    row = s.row_of_word()
    start = np.flatnonzero(row[:k] == row[n - 1 :])
    if not len(start):
        return nothing, nothing, nothing, nothing, nothing
    key, row, window = key[start], row[start], window[start]
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    since = np.arange(len(start)) - np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))
    at = np.flatnonzero(since % LONGEST == 0)
    size = np.diff(np.append(at, len(start)))
    sums = np.zeros(len(start) + 1, np.uint64)
    np.cumsum(window, out=sums[1:])
    known = mix((sums[at + size] - sums[at]) * BASE + mix(window[at])) + size.astype(np.uint64)
    return row[at], key[at].view(np.int64), known.view(np.int64), start[at], size


def _marks(docs: DataFrame, n: int) -> DataFrame:
    """key, piece, doc_id, node, start (word), size (windows) of all pieces of docs (doc_id, text, node)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in words(batch.column("text"), UNCHANGED):
                row, key, piece, start, size = _pieces(s, n)
                if len(row):
                    of = pa.array(s.first + row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(piece), batch.column("doc_id").take(of), batch.column("node").take(of), pa.array((start - s.offsets[row]).astype(np.int32)), pa.array(size.astype(np.int32))],
                        names=["key", "piece", "doc_id", "node", "start", "size"],
                    )

    long_enough = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * n - 1))
    return long_enough.mapInArrow(arrow_task(run), f"key long, piece long, doc_id {id_type}, node long, start int, size int")


def _by_node(docs: DataFrame, places: DataFrame, listed: str, how: str) -> DataFrame:
    """docs joined (inner or left) with a list of places for each node: sent to all tasks while there are few places in all, else by shuffle. Then only
    nodes are sent, so that texts without a place are not shuffled; beyond BROADCAST_KEYS nodes all are."""
    size = places.agg(F.count("*").alias("nodes"), F.sum(F.size(listed)).alias("places")).first()
    if (size["places"] or 0) <= BROADCAST_PLACES:
        return docs.join(F.broadcast(places), "node", how)
    if size["nodes"] > BROADCAST_KEYS:
        return docs.join(places.hint("merge"), "node", how)
    nodes = F.broadcast(places.select("node"))
    found = docs.join(nodes, "node", "left_semi").join(places.hint("merge"), "node")
    return found.unionByName(docs.join(nodes, "node", "left_anti"), allowMissingColumns=True) if how == "left" else found


def _contents(docs: DataFrame, n: int, hot: int) -> DataFrame:
    """key, piece, doc_id, content (64-bit hashes of its words) of the pieces that docs list (_places); of hot keys
    offset and window (MD5) of each window instead."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["key", "piece", "doc_id", "content", "offset", "window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # rows equal in id and text are read once in a batch
            _, once = np.unique(batch.column("node").to_numpy(), return_index=True)
            batch = batch.take(pa.array(np.sort(once)))
            for s in words(batch.column("text"), UNCHANGED):
                out: list[tuple] = []
                ids, places = batch.column("doc_id")[s.first : s.last].to_pylist(), batch.column("_places")[s.first : s.last].to_pylist()
                for k, listed in enumerate(places):
                    for p in listed:
                        a = int(s.offsets[k]) + p["start"]
                        h = s.hashes[a : a + p["size"] + n - 1]
                        if p["n"] > hot:
                            out += [(p["key"], p["piece"], ids[k], None, i, hashlib.md5(h[i : i + n].tobytes()).digest()) for i in range(p["size"])]
                        else:
                            out.append((p["key"], p["piece"], ids[k], h.tobytes(), None, None))
                if out:
                    kinds = [pa.int64(), pa.int64(), batch.schema.field("doc_id").type, pa.binary(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.mapInArrow(arrow_task(run), f"key long, piece long, doc_id {id_type}, content binary, offset int, window binary")


class SuffixAutomaton:
    """The substrings of all word sequences added. A state is a set of substrings that end at the same places;
    ``length`` is that of the longest, ``link`` leads to the longest suffix of another state."""

    def __init__(self) -> None:
        self.after: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, after: dict[int, int], link: int, length: int) -> int:
        self.after.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _exact(self, p: int, c: int) -> int:
        """The state of p's longest substring and c, split off its state if that has longer ones."""
        q = self.after[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(dict(self.after[q]), self.link[q], self.length[p] + 1)
        self.link[q] = own
        while p >= 0 and self.after[p].get(c) == q:
            self.after[p][c] = own
            p = self.link[p]
        return own

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.after[last]:
                last = self._exact(last, c)
                continue
            made = self._state({}, 0, self.length[last] + 1)
            p, last = last, made
            while p >= 0 and c not in self.after[p]:
                self.after[p][c] = made
                p = self.link[p]
            if p >= 0:
                self.link[made] = self._exact(p, c)

    def matching(self, sequence: list[int]) -> list[int]:
        """Matching statistics: for each word, the length of the longest substring that ends with it and is in the automaton."""
        after, link, length = self.after, self.link, self.length
        state = n = 0
        out = []
        for c in sequence:
            while state and c not in after[state]:
                state = link[state]
                n = length[state]
            if c in after[state]:
                state, n = after[state][c], n + 1
            out.append(n)
        return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _shard(n: int):
    """A shard's pieces to key, piece, gone: runs of windows that stand in a document before the piece's first."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["key", "piece"]).sort_values(["doc_id", "key", "piece"], kind="stable")
        automaton, waiting, out, now = SuffixAutomaton(), [], [], None
        for key, piece, doc, content in rows[["key", "piece", "doc_id", "content"]].itertuples(index=False):
            if doc != now:  # what one document has does not count against itself
                for sequence in waiting:
                    automaton.add(sequence)
                waiting, now = [], doc
            sequence = np.frombuffer(content, np.uint64).tolist()
            known = np.array(automaton.matching(sequence))[n - 1 :] >= n
            if known.any():
                out.append((key, piece, [{"start": a, "end": b} for a, b in _runs(known)]))
            waiting += [sequence[a : b + n - 1] for a, b in _runs(~known)]
        return pd.DataFrame(out, columns=["key", "piece", "gone"])

    return run


def find_repeats(docs: DataFrame, n: int = N, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text, others) with _spans: (start, end) word places that windows of documents with smaller ids cover; null: none."""
    docs = docs.withColumn("node", F.xxhash64("doc_id", "text"))
    marks = materialize(_marks(docs.select("doc_id", "text", "node"), n), "passages")
    classes = materialize(marks.groupBy("key", "piece").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "passage-classes")
    keys = classes.groupBy("key").agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    repeated = materialize(marks.join(classes.drop("last").join(keys, "key"), ["key", "piece"]), "passages-repeated")

    # one document's place of each distinct piece of keys that have several
    place = F.struct("key", "piece", "start", "size", "n")
    firsts = repeated.where("n > 1 and doc_id = first").groupBy("key", "piece", "n").agg(F.min(F.struct("node", "start", "size")).alias("f")).select("key", "piece", "n", "f.*")
    firsts = materialize(firsts.groupBy("node").agg(F.collect_list(place).alias("_places")), "passage-places")
    contents = materialize(_contents(_by_node(docs.select("doc_id", "text", "node"), firsts, "_places", "inner"), n, hot), "passage-contents")

    cold = contents.where("content is not null").select("key", "piece", "doc_id", "content")
    total = cold.agg(F.sum(F.length("content") / 8)).first()[0] or 0
    shards = max(1, int(total // shard_words) + 1)
    dealt = cold.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    gone = dealt.groupBy("shard").applyInPandas(_shard(n), "key long, piece long, gone array<struct<start:int,end:int>>").select("key", "piece", F.explode("gone").alias("g")).select("key", "piece", "g.*")
    single = contents.where("content is null").select("key", "piece", "doc_id", "offset", "window")
    lowest = single.groupBy("window").agg(F.min("doc_id").alias("lo"))
    known = single.join(lowest, "window").where("lo < doc_id").select("key", "piece", F.col("offset").alias("start"), (F.col("offset") + 1).alias("end"))
    gone = gone.unionByName(known).withColumnsRenamed({"start": "from", "end": "to"})

    whole = repeated.where("doc_id > first").select("node", "start", (F.col("start") + F.col("size") + (n - 1)).alias("end"))
    part = repeated.where("n > 1 and doc_id = first").join(gone, ["key", "piece"]).select("node", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to") + (n - 1)).alias("end"))
    spans = whole.unionByName(part).groupBy("node").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    return _by_node(docs, materialize(spans, "passage-spans"), "_spans", "left").drop("node")


def _left(text: bytes, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the others joined by a blank."""
    found = text.split()
    if not spans:
        return len(found), 0, b" ".join(found)
    kept, at = [], 0
    for s in spans:  # sorted by start
        if s["start"] > at:
            kept += found[at : s["start"]]
        at = max(at, s["end"])
    kept += found[at:]
    return len(found), len(found) - len(kept), b" ".join(kept)


def dedup_passages(docs: DataFrame, n: int = N) -> DataFrame:
    """docs without the words that repeat. Texts that lose none stay as they are; of others the words left are joined by a blank."""
    found = find_repeats(sheltered(docs, "doc_id", "text"), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("_spans").to_pylist()
            cut = [t if not s else _left(t.encode(), s)[2].decode() for t, s in zip(texts, spans, strict=True)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type))

    return restored(found.mapInArrow(arrow_task(run), found.schema), docs, "doc_id", "text")


def repeats_report(docs: DataFrame, n: int = N) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    found = find_repeats(docs.select("doc_id", "text"), n)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_left((t or "").encode(), s) for t, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
            columns = [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.mapInArrow(arrow_task(run), f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string")
