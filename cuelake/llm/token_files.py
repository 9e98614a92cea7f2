"""Token-id output in wavelet-matrix shards (operator 3).

Documents are range-partitioned and sorted by id (null ids last; equal ids by
a hash of the text), encoded with a public tokenizer, and packed into shards
of about SHARD_TOKENS tokens that end at a document's end. A shard is a
wavelet matrix (``cuelake.llm.wavelet``) with the ids and ends of its
documents: token access, counts and occurrences come from the one compressed
file it is in. The files are Parquet with zstd, written by Spark, so that a lost
executor's or a repeated task's output never counts twice.

Null and empty texts give the end id alone. Ids may be null or repeat: each row is a document of its own, in the order above. A very long text is
encoded whole and is never cut between shards, so that a shard is as long as its last text makes it. Other columns
are not read, whatever their names. An empty table gives no shards.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import arrow_task, small_batches
from cuelake.llm.wavelet import WaveletMatrix
from cuelake.llm.words import SLICE, _buffers

SHARD_TOKENS = 1 << 20
END_ID = 1
#: Distinct pieces encoded in one call of the tokenizer.
CALL = 16_384
#: Distinct pieces whose ids a Python worker keeps, from task to task (about 200 bytes each); beyond, the less used half goes.
KEEP = 500_000
#: Bytes of text encoded at once where a tokenizer cannot be given pieces.
WHOLE = 1 << 18

SHARD = (
    "part int, seq int, n_tokens long, bits int, doc_ids array<long>, doc_ends array<long>, "
    "zeros array<int>, planes array<binary>, ranks array<binary>"
)

#: The form of tokenizer that pieces are cut for.
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}
#: What ends each word's last token there.
WORD_END = "</w>"

# kinds of bytes: white space, ASCII letters, digits, apostrophe, other ASCII; last "|" (of <|endoftext|>) and non-ASCII, beside which nothing is cut
_KIND = np.full(256, 4, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[ord("'")] = 3
_KIND[ord("|")] = _KIND[128:] = 5
#: Between which kinds a text may be cut: the tokenizer splits there whatever follows (an apostrophe may go with the letters after it).
_CUT = np.zeros((6, 6), bool)
for _pair in ((1, 2), (2, 1), (2, 2), (1, 4), (4, 1), (2, 4), (4, 2), (1, 3), (2, 3)):
    _CUT[_pair] = True
_CUT[0, 1:] = True
_CUT = _CUT.ravel()
_loaded: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        from tokenizers import Tokenizer

        _loaded[path] = Pieces(Tokenizer.from_file(path))
    return _loaded[path]


class Pieces:
    """Ids of pieces of text, each encoded once. Of more than KEEP pieces, those used most stay.

    ``cuts``: whether the tokenizer has the FORM for which a text's ids are those of its pieces."""

    def __init__(self, tokenizer, keep: int = KEEP):
        self.tokenizer, self.keep = tokenizer, keep
        said = json.loads(tokenizer.to_str())
        self.cuts = all(said[k] == v for k, v in FORM.items()) and said["model"].get("end_of_word_suffix") == WORD_END and all(re.fullmatch(r"<\|\w+\|>", x["content"]) for x in said["added_tokens"])
        words = tokenizer.get_vocab()
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[k for w, k in words.items() if w.endswith(WORD_END)]] = True
        self.kind = np.uint16 if len(self.ends_word) <= 1 << 16 else np.uint32
        self.place: dict[str, int] = {}
        self.first, self.size, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.n_ids = np.zeros(4096, self.kind), 0

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m, more = len(self.place), self.n_ids, len(pieces)
        grown = lambda a, least: a if len(a) >= least else np.concatenate([a, np.zeros(max(len(a), least - len(a)), a.dtype)])
        self.first, self.size, self.used, self.flat = grown(self.first, n + more), grown(self.size, n + more), grown(self.used, n + more), grown(self.flat, m + len(ids))
        self.flat[m : m + len(ids)] = ids
        self.first[n : n + more], self.size[n : n + more], self.used[n : n + more] = m + np.cumsum(sizes) - sizes, sizes, 0
        self.place.update(zip(pieces, range(n, n + more), strict=True))
        self.n_ids = m + len(ids)

    def _learn(self, new: list[str]) -> None:
        word = [x.isascii() and x.isalpha() for x in new]
        for k in range(0, len(new), CALL):
            # words of ASCII letters go as one text: each ends with the only token of its that ends a word
            some, is_word = new[k : k + CALL], word[k : k + CALL]
            plain = [x for x, w in zip(some, is_word, strict=True) if w]
            if plain:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.int64)
                self._add(plain, ids, np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0))
            rest = [x for x, w in zip(some, is_word, strict=True) if not w]
            if rest:
                got = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
                self._add(rest, np.fromiter(chain.from_iterable(got), np.int64), np.fromiter(map(len, got), np.int64, len(got)))

    def _shrink(self) -> None:
        """Half of the pieces at most stay: those used more often than the rest."""
        used = self.used[: len(self.place)]
        stay = np.flatnonzero(used > np.partition(used, len(used) // 2)[len(used) // 2])
        names, size = list(self.place), self.size[stay]
        ends = np.cumsum(size)
        self.flat = self.flat[np.arange(size.sum()) + np.repeat(self.first[stay] - (ends - size), size)]
        self.place = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.first, self.size, self.used, self.n_ids = ends - size, size, used[stay] // 2, len(self.flat)

    def look_up(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first, size): distinct[k] has the ids flat[first[k] : first[k] + size[k]], until the next call."""
        if len(self.place) > self.keep:
            self._shrink()
        at = np.fromiter((self.place.get(x, -1) for x in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            self._learn(new)
            at[missing] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        self.used[at] += 1
        return self.first[at], self.size[at]


def encode(texts: pa.Array, pieces: Pieces, end_id: int = END_ID) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids, ends) of slices of a batch of texts, each
    text followed by the end id.

    A tokenizer of the FORM gives a text the ids of its pieces one after the
    other; so each distinct piece (cut where _CUT says so, ASCII pieces
    in lower case) is encoded once, and the pieces' ids are put in place. Any other
    tokenizer encodes whole texts.
    """
    texts = texts.fill_null("")
    off, whole = _buffers(texts)
    first, most = 0, SLICE if pieces.cuts else WHOLE
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        if pieces.cuts:
            ids, ends = _encode(whole[off[first] : off[last]], off[first : last + 1] - off[first], pieces, end_id)
        else:
            got = pieces.tokenizer.encode_batch_fast(texts.slice(first, last - first).to_pylist(), add_special_tokens=False)
            ends = np.cumsum([len(e.ids) + 1 for e in got])
            ids = np.fromiter(chain.from_iterable((*e.ids, end_id) for e in got), np.int64, int(ends[-1]))
        yield first, last, ids, ends
        first = last


def _encode(data: np.ndarray, bounds: np.ndarray, pieces: Pieces, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    kind = _KIND[data]
    inside = kind != 0
    start = inside.copy()
    start[1:] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
    inner = bounds[bounds < n]
    start[inner] = inside[inner]
    starts = np.flatnonzero(start)
    if len(starts):
        kept = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)
        np.cumsum(inside, out=kept[1:])
        cuts = np.append(kept[starts], kept[-1:])
        body = data[inside]
        capital = (body >= 65) & (body <= 90)
        wide = np.zeros(len(starts), bool)
        wide[np.searchsorted(cuts, np.flatnonzero(body > 127), "right") - 1] = True
        capital &= ~np.repeat(wide, np.diff(cuts))
        body += capital.view(np.uint8) << 5
        kind_of = pa.StringArray if cuts.dtype == np.int32 else pa.LargeStringArray
        coded = kind_of.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(body)).dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        first, size = pieces.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        took, begin = size[index], first[index]
    else:
        took, begin = np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(took)])
    total, docs = int(before[-1]), len(bounds) - 1
    doc_piece = np.searchsorted(starts, bounds, "left")
    ends = before[doc_piece[1:]] + np.arange(1, docs + 1)
    ids = np.full(total + docs, end_id, pieces.kind if end_id < len(pieces.ends_word) else np.uint32)
    place = np.ones(total + docs, bool)
    place[ends - 1] = False
    ids[place] = pieces.flat[np.arange(total) + np.repeat(begin - before[:-1], took)]
    return ids, ends


def _shard(part: int, seq: int, ids: np.ndarray, doc_ids: list, ends: np.ndarray, bits: int) -> dict:
    w = WaveletMatrix.build(ids, bits)
    return {
        "part": part, "seq": seq, "n_tokens": len(ids), "bits": bits, "doc_ids": doc_ids, "doc_ends": ends.tolist(), "zeros": w.zeros,
        "planes": [p.tobytes() for p in w.planes], "ranks": [r.tobytes() for r in w.ranks],
    }


def shards(docs: DataFrame, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """docs (doc_id, text) to shard rows; (part, seq) is their order."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("_tie").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        bits = max(1, (max(pieces.tokenizer.get_vocab_size(), end_id + 1) - 1).bit_length())
        kind = np.uint16 if bits <= 16 else np.uint32
        part, seq = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids, ends, n = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, doc_ids, ends, n, seq
            row = _shard(part, seq, np.concatenate(held), doc_ids, np.array(ends, np.int64), bits)
            held, doc_ids, ends, n, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            every = batch.column("doc_id").to_pylist()
            for begin, stop_row, ids, last in encode(batch.column("text"), pieces, end_id):
                ids, own, row = ids.astype(kind), every[begin:stop_row], 0
                while row < len(own):
                    # as many documents as fill the shard, and the one that goes over
                    base = int(last[row - 1]) if row else 0
                    stop = min(len(own), int(np.searchsorted(last, base + shard_tokens - n, "left")) + 1)
                    held.append(ids[base : last[stop - 1]])
                    doc_ids += own[row:stop]
                    ends += (last[row:stop] - base + n).tolist()
                    n += int(last[stop - 1]) - base
                    row = stop
                    if n >= shard_tokens:
                        yield close()
        if doc_ids:
            yield close()

    schema = _arrow_schema()
    return rows.mapInArrow(arrow_task(pack), SHARD)


def _arrow_schema() -> pa.Schema:
    whole = {"part": pa.int32(), "seq": pa.int32(), "n_tokens": pa.int64(), "bits": pa.int32(), "doc_ids": pa.list_(pa.int64()), "doc_ends": pa.list_(pa.int64()), "zeros": pa.list_(pa.int32()), "planes": pa.list_(pa.binary()), "ranks": pa.list_(pa.binary())}
    return pa.schema(list(whole.items()))


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards to a folder; returns the folder's DataFrame."""
    made = shards(docs, vocabulary, end_id, shard_tokens)
    with small_batches(docs.sparkSession):
        made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(SHARD).parquet(path)


def matrix(row: dict) -> WaveletMatrix:
    """The wavelet matrix of a shard row."""
    planes = [np.frombuffer(p, np.uint8) for p in row["planes"]]
    return WaveletMatrix(row["n_tokens"], row["bits"], planes, row["zeros"], [np.frombuffer(r, np.uint32) for r in row["ranks"]])


def _per_shard(files: DataFrame, schema: str, rows_of) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield rows_of(batch.slice(k, 1).to_pylist()[0])

    return files.mapInArrow(arrow_task(read), schema)


def documents(files: DataFrame) -> DataFrame:
    """part, seq, doc_id, first (ids before it in its shard), n_tokens,
    tokens_crc32 of each document, decoded from the files."""

    def rows_of(row: dict) -> pa.RecordBatch:
        raw = memoryview(matrix(row).tokens().astype("<u4")).cast("B")
        ends = np.array(row["doc_ends"], np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        n = len(ends)
        return pa.RecordBatch.from_arrays(
            [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
            names=["part", "seq", "doc_id", "first", "n_tokens", "ids_crc32"],
        )

    return _per_shard(files, "part int, seq int, doc_id long, first long, n_tokens long, ids_crc32 long", rows_of)


def document_tokens(files: DataFrame) -> DataFrame:
    """doc_id, tokens (with the end id), decoded from the files."""

    def rows_of(row: dict) -> pa.RecordBatch:
        offsets = np.array([0, *row["doc_ends"]], np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix(row).tokens().astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], names=["doc_id", "tokens"])

    return _per_shard(files, "doc_id long, tokens array<int>", rows_of)


def count_token(files: DataFrame, token: int) -> DataFrame:
    """part, seq, count: a token's occurrences in each shard, by rank."""

    def rows_of(row: dict) -> pa.RecordBatch:
        n = matrix(row).rank(token, row["n_tokens"])
        return pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), pa.array([row["seq"]], pa.int32()), pa.array([n], pa.int64())], names=["part", "seq", "count"])

    return _per_shard(files, "part int, seq int, count long", rows_of)


def find_token(files: DataFrame, token: int) -> DataFrame:
    """doc_id, place (in the document): a token's occurrences, by select."""

    def rows_of(row: dict) -> pa.RecordBatch:
        at = np.array(matrix(row).occurrences(token), np.int64)
        ends = np.array(row["doc_ends"], np.int64)
        doc = np.searchsorted(ends, at, "right")
        base = np.concatenate([np.zeros(1, np.int64), ends])[doc]
        return pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][d] for d in doc], pa.int64()), pa.array(at - base)], names=["doc_id", "place"])

    return _per_shard(files, "doc_id long, place long", rows_of)


def token_report(files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32.

    A shard's own start is what its part's shards before it hold, and the parts
    before: sums by part are as many rows as tasks wrote."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes, none = files.select("part", "seq", "n_tokens"), F.lit(0).cast("long")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(upto(Window.orderBy("part"))), none).alias("_parts"))
    inside = F.coalesce(F.sum("n_tokens").over(upto(Window.partitionBy("part").orderBy("seq"))), none)
    starts = sizes.select("part", "seq", inside.alias("_inside")).join(parts, "part")
    start = F.col("_parts") + F.col("_inside") + F.col("first")
    return documents(files).join(starts, ["part", "seq"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
