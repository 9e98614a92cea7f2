"""A wavelet matrix over token ids: bit-planes with rank directories, in numpy.

Plane k holds bit ``bits - 1 - k`` of every token, in the order in which the
planes before have stably sorted the sequence (zeros first). ``zeros[k]`` is
the number of zero bits in plane k, ``ranks[k]`` the number of one bits before
each block of 512.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPAN = 512


@dataclass
class WaveletMatrix:
    n: int
    bits: int
    planes: list[np.ndarray]
    zeros: list[int]
    ranks: list[np.ndarray]

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, ranks = [], [], []
        for k in range(bits - 1, -1, -1):
            bit = (tokens & tokens.dtype.type(1 << k)) != 0
            packed = np.packbits(bit, bitorder="little")
            low = tokens[np.flatnonzero(~bit)]
            tokens = np.concatenate([low, tokens[np.flatnonzero(bit)]])
            planes.append(packed)
            zeros.append(len(low))
            ranks.append(rank_directory(packed))
        return cls(len(tokens), bits, planes, zeros, ranks)

    def _rank(self, k: int, i: int) -> int:
        """One bits in plane k before i."""
        block = i // SPAN
        tail = self.planes[k][block * SPAN // 8 : -(-i // 8)]
        ones = np.unpackbits(tail, bitorder="little")[: i - block * SPAN].sum() if len(tail) else 0
        return int(self.ranks[k][block]) + int(ones) if block < len(self.ranks[k]) else int(self.ranks[k][-1])

    def _select(self, k: int, bit: int, j: int) -> int:
        """Where plane k has its j-th (from 0) bit of that kind."""
        ones = self.ranks[k].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * SPAN - ones
        block = int(np.searchsorted(before, j, "right")) - 1
        piece = np.unpackbits(self.planes[k][block * SPAN // 8 : (block + 1) * SPAN // 8], bitorder="little")
        piece = piece[: self.n - block * SPAN]
        return block * SPAN + int(np.flatnonzero(piece == bit)[j - int(before[block])])

    def access(self, i: int) -> int:
        """The token at i."""
        token = 0
        for k in range(self.bits):
            one = self.planes[k][i >> 3] >> (i & 7) & 1
            ones = self._rank(k, i)
            i = self.zeros[k] + ones if one else i - ones
            token = token << 1 | int(one)
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token before end lie after the last plane."""
        a, b = 0, end
        for k in range(self.bits):
            ra, rb = self._rank(k, a), self._rank(k, b)
            if token >> (self.bits - 1 - k) & 1:
                a, b = self.zeros[k] + ra, self.zeros[k] + rb
            else:
                a, b = a - ra, b - rb
        return a, b

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before end."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._range(token, end)
        return b - a

    def select(self, token: int, j: int) -> int:
        """The place of the j-th (from 0) occurrence; it must exist."""
        a, b = self._range(token, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for k in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - k) & 1:
                i = self._select(k, 1, i - self.zeros[k])
            else:
                i = self._select(k, 0, i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.rank(token, self.n))]

    def tokens(self) -> np.ndarray:
        """The whole sequence: the planes undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            up[np.flatnonzero(~bit)] = out[: self.zeros[k]]
            up[np.flatnonzero(bit)] = out[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            out = up
        return out


def rank_directory(packed: np.ndarray) -> np.ndarray:
    """One bits before each block of SPAN bits, and their number at the end."""
    ones = np.bitwise_count(packed).astype(np.uint32)
    sums = np.add.reduceat(ones, np.arange(0, len(ones), SPAN // 8)) if len(ones) else np.zeros(0, np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(sums, dtype=np.uint32)])
