"""Words of many texts at once, as numpy arrays over one Arrow buffer.

A word's 64-bit hash comes from prefix sums of a polynomial over the bytes,
so that no Python object is made per word. Used inside mapInArrow tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C55)
#: Its inverse modulo 2**64.
BACK = np.uint64(pow(int(BASE), -1, 2**64))
#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE = 1 << 20

_powers: list[np.ndarray] = []


def _lookup(separators: list[int]) -> np.ndarray:
    """Byte to lower-cased byte; separators become 0."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[separators] = 0
    return out


#: White space separates: [^\x20\x09-\x0D]+ (a NUL byte is a letter there, written as the free 0x20).
SPACED = _lookup([0x20, *range(0x09, 0x0E)])
SPACED[0] = 0x20
#: The same words, not lower-cased.
UNCHANGED = np.where((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A), np.arange(256), SPACED).astype(np.uint8)
#: Letters a-z, digits and all non-ASCII bytes: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
ALNUM = _lookup([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (xor-shift-multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(SLICE, b, np.uint64))]) for b in (BASE, BACK)]
    return _powers[0], _powers[1]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word, from prefix sums over SLICE bytes at a time, whatever the length of the text."""
    out, (up, back) = np.zeros(len(starts), np.uint64), _power()
    k = 0
    while k < len(starts):
        base = int(starts[k])
        last = max(k + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        if ends[last - 1] - base <= SLICE:
            part = data[base : ends[last - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            a = starts[k:last] - base
            out[k:last] = (sums[ends[k:last] - base] - sums[a]) * back[a]
        else:  # one word, longer than that
            total, scale = 0, 1
            for at in range(base, int(ends[k]), SLICE):
                part = data[at : min(at + SLICE, int(ends[k]))]
                total += scale * int(((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)]).sum())
                scale = scale * int(up[SLICE]) % 2**64
            out[k] = total % 2**64
        k = last
    return mix(out)


@dataclass
class Words:
    """Words of rows first..last of a batch. offsets[i]:offsets[i + 1] are row i's words."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), np.diff(self.offsets))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of n consecutive words from each word on; valid: they are of one row."""
        h, k = self.hashes, len(self.hashes) - n + 1
        if k <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.full(k, np.uint64(n * 0x632BE5AB))
        for i in range(n):
            out = mix(out * BASE + h[i : i + k])
        row = self.row_of_word()
        return out, row[:k] == row[n - 1 :]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(texts.type)
    raw = texts.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return off, data


def words(texts: pa.Array, lookup: np.ndarray) -> Iterator[Words]:
    """Slices of a batch of texts, in order; a null text has no words."""
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    off, whole = _buffers(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(off, off[first] + SLICE, "right")) - 1)
        base = off[first]
        data = lookup[whole[base : off[last]]]
        bounds = off[first : last + 1] - base
        n = len(data)
        inside = data != 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        inner = bounds[(bounds < n) & (bounds > 0)]
        start[inner] = inside[inner]
        starts = np.flatnonzero(start)
        # a word ends before a separator, before another row, or with the data
        end = np.zeros(n + 1, bool)
        end[1:] = inside
        end[1:n] &= ~inside[1:]
        end[inner] = inside[inner - 1]
        ends = np.flatnonzero(end)
        yield Words(first, last, data, starts, ends, _hashes(data, starts, ends), np.searchsorted(starts, bounds, "left"))
        first = last
