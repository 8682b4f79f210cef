"""A wavelet matrix over token ids as one compressed file.

File: the magic ``WMTX1``, a newline, a JSON line (counts, bits, part, number, sizes of the sections), then zstandard
sections: document ids (int64), ids of each document (int64), and for each bit from the highest a bit-plane (eight
positions a byte, first position highest) and its rank directory (uint32, ones before every 2,048 positions).

Each plane holds one bit of every token, in an order that puts tokens with a 0 in the plane before first. A token is read
by following its position down the planes with rank; count and occurrences of an id follow a whole range down, and
select goes back up.
"""

from __future__ import annotations

import json
from bisect import bisect_left

import numpy as np
import zstandard

MAGIC = b"WMTX1\n"
STEP = 2048
#: Positions that are worked on at once, so that they stay in the processor's cache.
BLOCK = 1 << 17
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Plane:
    """Bits with rank and select."""

    def __init__(self, packed: np.ndarray, n: int, ranks: np.ndarray):
        self.packed, self.n, self.ranks = packed, n, ranks

    @classmethod
    def of(cls, packed: np.ndarray, n: int) -> Plane:
        ones = _ONES[packed].astype(np.uint32)
        ends = np.add.reduceat(ones, np.arange(0, len(ones), STEP // 8)) if len(ones) else np.empty(0, np.uint32)
        return cls(packed, n, np.concatenate(([0], np.cumsum(ends))).astype(np.uint32))

    def bit(self, i: int) -> int:
        return int(self.packed[i >> 3]) >> (7 - (i & 7)) & 1

    def rank(self, i: int, bit: int = 1) -> int:
        """Positions before i with this bit."""
        block = i // STEP
        ones = int(self.ranks[block]) + int(_ONES[self.packed[block * (STEP // 8) : i >> 3]].sum())
        if i & 7:
            ones += bin(int(self.packed[i >> 3]) >> (8 - (i & 7))).count("1")
        return ones if bit else i - ones

    def select(self, k: int, bit: int) -> int:
        """The position of the k-th of these bits, from 0."""
        return bisect_left(range(self.n), k + 1, key=lambda i: self.rank(i + 1, bit))


class WaveletMatrix:
    def __init__(self, planes: list[Plane], n: int):
        self.planes, self.n = planes, n
        self.zeros = [p.rank(n, 0) for p in planes]

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, order, after, high = [], ids, np.empty_like(ids), np.empty_like(ids)
        for shift in range(bits - 1, -1, -1):
            bit, packed, z, o = order.dtype.type(1 << shift), [], 0, 0
            for i in range(0, len(ids), BLOCK):
                part = order[i : i + BLOCK]
                ones = part & bit != 0
                packed.append(np.packbits(ones))
                one, zero = np.compress(ones, part), np.compress(~ones, part)
                high[o : o + len(one)], after[z : z + len(zero)] = one, zero
                o, z = o + len(one), z + len(zero)
            after[z:] = high[:o]
            planes.append(Plane.of(np.concatenate(packed or [np.empty(0, np.uint8)]), len(ids)))
            order, after = after, np.empty_like(ids) if order is ids else order
        return cls(planes, len(ids))

    def access(self, i: int) -> int:
        value = 0
        for p, z in zip(self.planes, self.zeros, strict=True):
            b = p.bit(i)
            i = z + p.rank(i) if b else p.rank(i, 0)
            value = value << 1 | b
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token in [begin, end) are after the last plane."""
        if token >> len(self.planes):
            return 0, 0
        for k, (p, z) in enumerate(zip(self.planes, self.zeros, strict=True)):
            b = token >> (len(self.planes) - 1 - k) & 1
            begin, end = p.rank(begin, b) + z * b, p.rank(end, b) + z * b
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        end = self.n if end is None else min(end, self.n)
        if begin >= end:
            return 0
        a, b = self._range(token, begin, end)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """The position of the k-th occurrence, from 0; IndexError beyond the last."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self.planes[level].select(at - self.zeros[level] * bit, bit)
        return at

    def ids(self) -> np.ndarray:
        """All tokens in order, from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        values, out = np.zeros(self.n, kind), np.empty(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            packed, bit, z, o = self.planes[level].packed, kind(1 << (len(self.planes) - 1 - level)), 0, self.zeros[level]
            for i in range(0, self.n, BLOCK):
                part = out[i : i + BLOCK]
                ones = np.unpackbits(packed[i >> 3 : (i + BLOCK) >> 3], count=len(part)).view(bool)
                one, zero = np.flatnonzero(ones), np.flatnonzero(~ones)
                part[one], part[zero] = values[o : o + len(one)] | bit, values[z : z + len(zero)]
                o, z = o + len(one), z + len(zero)
            values, out = out, values
        return values


def to_bytes(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, part: int, number: int) -> bytes:
    matrix, pack = WaveletMatrix.of(ids), zstandard.ZstdCompressor(level=1).compress
    sections = [pack(doc_ids.astype("<i8").tobytes()), pack(lengths.astype("<i8").tobytes())]
    for p in matrix.planes:
        sections += pack(p.packed.tobytes()), pack(p.ranks.astype("<u4").tobytes())
    head = {"tokens": matrix.n, "documents": len(doc_ids), "bits": len(matrix.planes), "part": part, "number": number, "sections": [len(s) for s in sections]}
    return b"".join((MAGIC, json.dumps(head).encode(), b"\n", *sections))


class TokenFile:
    """A file read back. Planes are unpacked when asked for."""

    def __init__(self, data: bytes):
        if not data.startswith(MAGIC):
            raise ValueError("no wavelet-matrix file")
        end = data.index(b"\n", len(MAGIC))
        self.head = json.loads(data[len(MAGIC) : end])
        unpack, at, parts = zstandard.ZstdDecompressor().decompress, end + 1, []
        for size in self.head["sections"]:
            parts.append(unpack(data[at : at + size]))
            at += size
        self.doc_ids, self.lengths = (np.frombuffer(x, "<i8") for x in parts[:2])
        planes = [Plane(np.frombuffer(parts[i], np.uint8), self.head["tokens"], np.frombuffer(parts[i + 1], "<u4")) for i in range(2, len(parts), 2)]
        self.matrix = WaveletMatrix(planes, self.head["tokens"])
