"""Word shingles, their MinHash signatures and exact Jaccard similarity. Plain helpers that run inside tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
MASK = (1 << 64) - 1
#: A worker remembers the hashes of so many words at most.
MOST_WORDS = 300_000


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


class Shingler:
    """Texts to arrays of 64-bit shingle hashes; remembers word hashes between texts."""

    def __init__(self, width: int = 5):
        self.width, self.memo = width, {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MOST_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def shingles(self, words: list[str]) -> np.ndarray:
        """Sorted, distinct; a text of fewer words than the width is one shingle, one without words none."""
        if not words:
            return np.empty(0, np.uint64)
        h, w = self._hashes(words), min(self.width, len(words))
        mixed = np.full(len(h) - w + 1, w, np.uint64)
        for i in range(w):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - w + 1 + i]
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def text_key(words: list[str]) -> bytes:
    """Equal for equal sequences of words."""
    return hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()


class MinHasher:
    """Signatures of ``size`` 32-bit minima under fixed multiply-shift functions."""

    def __init__(self, size: int, seed: int = 20_240):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(1, MASK, size, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, MASK, size, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), MASK, np.uint64)
        for i in range(0, len(shingles), 1024):
            part = shingles[i : i + 1024, None] * self.a
            part += self.b
            np.minimum(low, part.min(axis=0), out=low)
        return (low >> np.uint64(32)).astype(np.uint32)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048, most_pairs: int = 1 << 21) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``; the sets are sorted and distinct.

    Elements that many sets have are counted as products of matrices, the others pair by pair; ``columns`` and
    ``most_pairs`` bound what is made at once.
    """
    total = np.zeros((len(left), len(right)), np.int32)
    if total.size <= 16:
        for i, a in enumerate(left):
            total[i] = [len(np.intersect1d(a, b, assume_unique=True)) for b in right]
        return total
    (la, ia), (lb, ib) = ((np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (left, right))
    common = np.intersect1d(la, lb)
    if not len(common):
        return total

    def by_column(elements: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The column and set of each element that is common, by column, and where each column begins."""
        at = np.searchsorted(common, elements)
        at[at == len(common)] = 0
        hit = common[at] == elements
        order = np.argsort(at[hit], kind="stable")
        at, of = at[hit][order], of[hit][order]
        return at, of, np.searchsorted(at, np.arange(len(common) + 1))

    (ca, sa, fa), (cb, sb, fb) = by_column(la, ia), by_column(lb, ib)
    pairs = np.diff(fa) * np.diff(fb)
    dense = pairs * 150 > total.size
    begin, reached = 0, np.cumsum(np.where(dense, 0, pairs))
    while begin < len(common):
        end = max(begin + 1, int(np.searchsorted(reached, (reached[begin - 1] if begin else 0) + most_pairs, "right")))
        mine = np.arange(fa[begin], fa[end])
        mine = mine[~dense[ca[mine]]]
        times = np.diff(fb)[ca[mine]]
        ends = np.cumsum(times)
        if len(ends):
            at = np.repeat(fb[ca[mine]] - (ends - times), times) + np.arange(ends[-1])
            np.add.at(total, (np.repeat(sa[mine], times), sb[at]), 1)
        begin = end
    number = np.cumsum(dense) - 1
    for begin in range(0, int(dense.sum()), columns):
        one, two = (np.zeros((len(x), columns), np.float32) for x in (left, right))
        for out, column, of in ((one, ca, sa), (two, cb, sb)):
            take = dense[column] & (number[column] >= begin) & (number[column] < begin + columns)
            out[of[take], number[column[take]] - begin] = 1
        total += (one @ two.T).astype(np.int32)
    return total


def spanning(left: list[int], right: list[int] | None, linked: Callable, linked_back: Callable | None = None) -> list[tuple[int, int]]:
    """Edges that connect what the links of ``left`` with ``right`` connect, or those inside ``left``; fewer than there are ids.

    ``linked(i, at)``: which of the columns ``at`` row i is linked with; ``linked_back(j, at)``: which rows column j is.
    What is connected already isn't asked about again, so that a dense group takes about one question a row.
    """
    sides = (left, right if right is not None else left)
    rest = [np.arange(len(x)) for x in sides]
    ask = (linked, linked_back or linked)
    out: list[tuple[int, int]] = []
    for start in range(len(left)):
        at = np.searchsorted(rest[0], start)
        if at == len(rest[0]) or rest[0][at] != start:
            continue
        rest[0] = np.delete(rest[0], at)
        stack = [(0, start)]
        while stack:
            side, i = stack.pop()
            other = 0 if right is None else 1 - side
            if len(rest[other]):
                hit = ask[side](i, rest[other])
                found, rest[other] = rest[other][hit], rest[other][~hit]
                out += [(sides[side][i], sides[other][j]) for j in found.tolist()]
                stack += [(other, j) for j in found.tolist()]
    return out
