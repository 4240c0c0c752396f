"""A wavelet matrix: a sequence of token ids as succinct bit planes.

Plane 0 holds the highest bit of every id in order. For the next plane the ids are
stably partitioned by that bit, zeros first, and so on down to the lowest bit. With
the number of ones before any place (rank) and its inverse (select), the planes give
any id of the sequence, the number of occurrences of an id in a stretch, and where its
k-th occurrence stands, without the ids themselves.

File: MAGIC, the length of a JSON head, the head, then zstandard frames: the user's
`meta` bytes, the ones before each block, and the planes in chunks that are unpacked
only when a query needs them.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"IDLWM1\n"
BLOCK = 512  # bits between two entries of the rank directory
CHUNK = 1 << 18  # bits of a plane in one frame; a multiple of BLOCK
LEVEL = 1


def build(ids: np.ndarray, bits: int, meta: bytes = b"") -> bytes:
    """The file of a sequence of ids below 2 ** bits."""
    pack = zstandard.ZstdCompressor(level=LEVEL)
    n = len(ids)
    zeros, frames, ranks = [], [], []
    for level in range(bits - 1, -1, -1):
        bit = (ids >> level & 1).astype(bool)
        zeros.append(int(n - np.count_nonzero(bit)))
        plane = np.packbits(bit)
        blocks = np.bitwise_count(np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)]).view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
        ranks.append(np.concatenate([[0], np.cumsum(blocks[:-1], dtype=np.uint32)]).astype(np.uint32) if n else np.zeros(0, np.uint32))
        raw = plane.tobytes()
        frames += [pack.compress(raw[i:i + CHUNK // 8]) for i in range(0, len(raw), CHUNK // 8)]
        ids = np.concatenate([ids[~bit], ids[bit]])
    parts = [pack.compress(meta), pack.compress(b"".join(r.tobytes() for r in ranks)), *frames]
    head = json.dumps({"n": n, "bits": bits, "zeros": zeros, "sizes": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *parts])


class WaveletMatrix:
    """Queries on a file. Positions count from 0, stretches exclude their end."""

    def __init__(self, file: bytes):
        if file[:len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = len(MAGIC) + 8
        size = int.from_bytes(file[len(MAGIC):at], "little")
        head = json.loads(file[at:at + size])
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        ends = at + size + np.cumsum([0, *head["sizes"]])
        self._frames = [memoryview(file)[a:b] for a, b in zip(ends, ends[1:])]
        unpack = zstandard.ZstdDecompressor()
        self.meta = unpack.decompress(self._frames[0])
        self._ranks = np.frombuffer(unpack.decompress(self._frames[1]), np.uint32).reshape(self.bits, -1)
        self._per_plane = -(-self.n // CHUNK)
        self._chunk = lru_cache(64)(lambda i: np.frombuffer(unpack.decompress(self._frames[2 + i]), np.uint8))

    def _bit(self, level: int, i: int) -> int:
        byte = self._chunk(level * self._per_plane + i // CHUNK)[i % CHUNK // 8]
        return int(byte) >> (7 - i % 8) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i == self.n:
            return self.n - self.zeros[level]
        block = i // BLOCK
        chunk = self._chunk(level * self._per_plane + i // CHUNK)
        lo, hi = block * BLOCK % CHUNK // 8, i % CHUNK // 8
        ones = int(self._ranks[level, block]) + int(np.bitwise_count(chunk[lo:hi]).sum())
        return ones + (int(chunk[hi]) >> (8 - i % 8)).bit_count() if i % 8 else ones

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value in a plane."""
        lo, hi = 0, self.n
        while hi - lo > 1:
            middle = (lo + hi) // 2
            before = self._ones(level, middle)
            if (before if bit else middle - before) <= k:
                lo = middle
            else:
                hi = middle
        return lo

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _narrow(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in [lo, hi)."""
        if symbol >> self.bits:
            return 0
        a, b = self._narrow(symbol, lo, self.n if hi is None else hi)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        first, end = self._narrow(symbol, 0, self.n) if not symbol >> self.bits else (0, 0)
        if not 0 <= k < end - first:
            raise IndexError(k)
        i = first + k
        for level in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def ids(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            packed = [self._chunk(level * self._per_plane + i) for i in range(self._per_plane)]
            bit = np.unpackbits(np.concatenate(packed) if packed else np.zeros(0, np.uint8), count=self.n).view(bool)
            lower, zeros = out, self.zeros[level]
            out = np.empty(self.n, kind)
            out[~bit] = lower[:zeros]
            out[bit] = lower[zeros:] | kind(1 << (self.bits - 1 - level))
        return out
