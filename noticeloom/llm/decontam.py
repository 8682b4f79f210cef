"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ by k = floor(rate x m) edits. Cut into k + 1 pieces, one piece of any occurrence
is untouched: an Aho-Corasick automaton over all pieces finds exact hits, and Myers' bit-parallel algorithm verifies the
text around each hit and gives the distance. Both sides are lower-cased and runs of white space count as one space.

The benchmark is a stated query set and is run against all documents in blocks: a block has at most ``BLOCK_CHARS``
characters of items, which bounds what is sent to the tasks; a larger benchmark takes more blocks, each a job of its own
over all documents. A worker process makes the automaton of a block once. Documents are never shuffled.

Defined results: null and empty texts match nothing; null and empty items are never found; an item with a null id is
found like any other and reported with a null ``item_id``, and items that share an id each; an item too short for an edit must
occur exactly; of the occurrences of an item in a document the best is reported, the first of equals; repeated rows
are reported each; very long texts are searched whole; without documents or items the result is empty, or the documents
as they are; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import in_pandas, slices, table, written

#: Edits a character of an item.
RATE = 0.08
BLOCK_CHARS = 4_000_000
Item = tuple[int | None, str]
FOUND = "doc_id long, item_id long, distance int, budget int, match_start int, match_end int"
_TOKEN = re.compile(r"\S+")


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """Offset and text of k + 1 pieces of about equal length."""
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, anchored: bool = False) -> list[int]:
    """For each end in ``text`` the least edit distance of the pattern to a stretch that ends there (anchored: to all before)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    whole, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down, score, out = whole, 0, len(pattern), []
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (eq & up) + up ^ up | eq
        ph = down | whole & ~(xh | up)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        out.append(score)
        ph = ph << 1 | anchored
        up = mh << 1 & whole | whole & ~(xv | ph)
        down = ph & xv
    return out


def best_match(pattern: str, text: str, k: int) -> tuple[int, int, int] | None:
    """Distance, start and end of the best stretch of ``text`` within k edits."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    scores = myers(pattern, text)
    if not scores or (least := min(scores)) > k:
        return None
    end = scores.index(least) + 1
    back = myers(pattern[::-1], text[max(0, end - len(pattern) - k) : end][::-1], anchored=True)
    return least, end - (back.index(least) + 1 if least in back else 0), end


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """A span of the normal form as a span of the text."""
    at, first, last = 0, len(text), len(text)
    for m in _TOKEN.finditer(text):
        size = len(m[0].lower())
        if first == len(text) and start < at + size:
            first = m.start() + min(max(start - at, 0), len(m[0]))
        if end <= at + size:
            last = m.start() + min(max(end - at, 0), len(m[0]))
            break
        at += size + 1
    return first, max(first, last)


class Matcher:
    def __init__(self, items: list[Item], rate: float):
        # by place: ids may be null or repeat
        self.items = [(i, t, int(len(t) * rate)) for i, t in items]
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for at, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                by_piece.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in by_piece.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int, int]]:
        """Item, distance, budget, start and end of each item that the normal text has."""
        starts: dict[int, set[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for place, offset in uses:
                starts.setdefault(place, set()).add(end + 1 - size - offset)
        out = []
        for place, at in sorted(starts.items()):
            i, item, k = self.items[place]
            windows: list[list[int]] = []
            for s in sorted(at):
                a, b = max(0, s - k), min(len(text), s + len(item) + k)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(b, windows[-1][1])
                else:
                    windows.append([a, b])
            found = [(x[0], x[1] + a, x[2] + a) for a, b in windows if (x := best_match(item, text[a:b], k))]
            if found:
                distance, start, end = min(found)
                out.append((i, distance, k, start, end))
        return out


_LAST: dict[str, Matcher] = {}


def matcher_of(name: str, items: list[Item], rate: float) -> Matcher:
    """The automaton of a block, made once in a worker process and kept until the next block."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Matcher(items, rate)
    return _LAST[name]


def _searcher(items: list[Item], rate: float):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = matcher_of(name, items, rate)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if text:
                    for i, distance, k, start, end in matcher.find(normal(text)):
                        rows.append((doc_id, i, distance, k, *original_span(text, start, end)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")]).assign(item_id=pd.array([r[1] for r in rows], "Int64"))

    return run


def item_blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[Item]]:
    """The items in normal form, streamed through the driver a block at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("text <> ''").distinct().orderBy("item_id", "text").toLocalIterator():
        if text := normal(row["text"]):
            if block and size + len(text) > most:
                yield block
                block, size = [], 0
            block.append((row["item_id"], text))
            size += len(text)
    if block:
        yield block


def with_last(blocks: Iterator[list[Item]]) -> Iterator[tuple[list[Item], bool]]:
    """Each block, and whether it is the last."""
    before = next(blocks, None)
    while before is not None:
        after = next(blocks, None)
        yield before, after is None
        before = after


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance, budget, match_start, match_end`` (code points of the text), a row a document and item."""
    spark, found = docs.sparkSession, []
    for block, last in with_last(item_blocks(benchmark)):
        part = in_pandas(docs.select("doc_id", "text"), _searcher(block, rate), FOUND)
        # each block is a job of its own: no plan and no worker holds two
        found.append(part if last and not found else written(part, "contamination"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND)


def holds_any(items: list[Item], rate: float, text: Column) -> Column:
    """Whether a text holds an item of the block."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = matcher_of(name, items, rate)
        for batch in slices(batches):
            yield batch.map(lambda t: bool(t and matcher.find(normal(t)))).astype(bool)

    return F.pandas_udf(run, "boolean")(text)


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no item, with all their columns. Each row is judged by its own text."""
    for block, last in with_last(item_blocks(benchmark)):
        docs = docs.where(~holds_any(block, rate, docs["text"]))
        if not last:
            docs = written(docs, "decontaminated")
    return docs


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
