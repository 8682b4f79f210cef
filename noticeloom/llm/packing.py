"""Best-fit packing into bins of several permitted lengths.

Documents longer than the largest length are cut into pieces of that length and a rest; every piece is packed. Pieces are
dealt by a hash into groups of about ``GROUP`` pieces, and each group is packed by itself: decreasing best fit, where a
piece goes to the open bin it leaves the least room in. If none has room, a bin opens; its length is decided jointly for
all permitted lengths: each opening rule (any one length where pieces fit, the least cost for each unit of length, the
least length that fits) is tried and the packing with the least total cost is kept. At the end each bin shrinks to the
least permitted length that holds its contents. Costs count that final length.

A bin is lost at most at the end of each group, so the loss is about a part in a hundred of the bins at ``GROUP`` pieces
of usual lengths; no task ever holds more than its group of narrow rows.

``packed`` places lengths; ``packed_sequences`` encodes texts and makes the sequences themselves, with the spans that each
holds. Lengths are tokens, so that a cut never falls inside one.

Defined results: null, zero and negative lengths have no tokens and take no place in a bin; they come back as a piece of
length 0 with a null bin; equal lengths are packed in order of id and piece; repeated rows are packed each; very long texts
are cut; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import table, written
from noticeloom.llm.encoding import token_count, token_ids

#: Permitted lengths, in tokens.
LENGTHS = (1024, 2048, 4096, 8192, 16384)
GROUP = 2048
#: Equal rows are numbered in arrays of so many.
RUN = 4096
PACKED = "bin_id string, bin_length int, bin_used int, position int, doc_id long, piece int, start long, length int"


def cost(length: int) -> float:
    """Of a sequence: its tokens, a fixed part, and attention, which grows with the square."""
    return length + 32 + length * length / 131072


def _pack(sizes: np.ndarray, opening: list[int]) -> tuple[np.ndarray, list[int]]:
    """Bin of each size (decreasing), and the contents of each bin. ``opening``: the length of a bin opened by each size."""
    room: list[tuple[int, int]] = []
    used: list[int] = []
    where = np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = opening[i], len(used)
            used.append(0)
        where[i] = b
        used[b] += size
        if free > size:
            insort(room, (free - size, b))
    return where, used


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, list[int], list[int]]:
    """The cheapest of the packings under each opening rule: bin of each size, contents and final length of each bin."""
    lengths = tuple(sorted(lengths))
    fit = [lengths[bisect_left(lengths, s)] for s in sizes.tolist()]
    dear = {x: cost(x) / x for x in lengths}
    rules = [[max(f, x) for f in fit] for x in lengths]
    rules.append([min((x for x in lengths if x >= f), key=dear.get) for f in fit])
    best = None
    for rule in rules:
        where, used = _pack(sizes, rule)
        final = [lengths[bisect_left(lengths, u)] for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, where, used, final
    return best[1:]


def _packer(lengths: tuple[int, ...]):
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "unnamed", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        where, used, final = best_fit(group["length"].to_numpy(), lengths)
        out = group[["doc_id", "unnamed", "piece", "start", "length"]].assign(
            bin_id=[f"{key[0]}-{b}" for b in where], bin_length=np.array(final)[where], bin_used=np.array(used)[where], position=group.groupby(where).cumcount()
        )
        return out[[c.split()[0] for c in f"{PACKED}, unnamed boolean".split(", ")]]

    return pack


def pieces(docs: DataFrame, length: Column, most: int) -> DataFrame:
    """``doc_id`` and a length to ``doc_id, piece, start, length``."""
    # a column of its own first: an explode beside it would count the lengths twice
    lengths = docs.select("doc_id", F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n"))
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / most).cast("int") - 1, F.lit(0))))
    rows = lengths.select("doc_id", "n", cut.alias("piece"))
    start = F.col("piece").cast("long") * most
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(most)).cast("int").alias("length"))


def packed(docs: DataFrame, length: Column, lengths: tuple[int, ...] = LENGTHS, group: int = GROUP) -> DataFrame:
    """A row a piece: its bin, the bin's final length and contents, its position in the bin, and what it is of."""
    cut = written(pieces(docs, length, max(lengths)), "packing-pieces")  # lengths are counted once
    # equal rows are counted and numbered, so that rows that repeat an id are spread too; long runs in steps, as a run may be a large part of all
    groups = F.greatest(F.lit(1), F.ceil(F.lit(cut.where("length > 0").count()) / group)).cast("long")
    counted = cut.where("length > 0").groupBy("doc_id", "piece", "start", "length").agg(F.count("*").alias("n"))
    steps = counted.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))))
    numbered = steps.withColumn("copy", F.explode(F.sequence(F.col("step") * RUN, F.least(F.col("n"), (F.col("step") + 1) * RUN) - 1)))
    dealt = numbered.select("doc_id", "piece", "start", "length", F.pmod(F.xxhash64("doc_id", "piece", "length", "copy"), groups).alias("cell"))
    # pandas would make floats of ids with a null among them, and these don't hold 64 bits
    named = dealt.withColumn("unnamed", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long"))
    full = named.groupBy("cell").applyInPandas(_packer(tuple(lengths)), f"{PACKED}, unnamed boolean")
    full = full.withColumn("doc_id", F.when(~F.col("unnamed"), F.col("doc_id"))).drop("unnamed")
    none = cut.where("length = 0").select(*(F.lit(None).cast(t).alias(c) if c in ("bin_id", "bin_length", "bin_used", "position") else F.col(c) for c, t in (x.split() for x in PACKED.split(", "))))
    return full.unionByName(none)


SEQUENCE = "array<struct<position: int, doc_id: bigint, piece: int, start: bigint, length: int>>"


def packed_sequences(docs: DataFrame, tokenizer: str | None = None, lengths: tuple[int, ...] = LENGTHS, group: int = GROUP, pad: int = 0) -> DataFrame:
    """``doc_id, text`` to ``bin_id, bin_length, ids, spans``: the ids of each bin, filled up with ``pad``, and what of which document they are.

    ``spans`` are in order: position, doc_id, piece, first token in the document, number of tokens.
    """
    most = max(lengths)
    # equal rows have equal ids, so that a hash of the row is as good a key as a number of it
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").alias("of"), token_ids(F.col("text"), tokenizer).alias("ids"))
    coded = written(rows, "packing-ids")
    placed = packed(coded.select(F.col("row").alias("doc_id"), F.size("ids").alias("n")), F.col("n"), lengths, group).where("bin_id is not null")
    once = coded.where(F.size("ids") > 0).dropDuplicates(["row"])
    cuts = once.select(F.col("row").alias("doc_id"), "of", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("ids") - 1, F.lit(most)), lambda i: F.slice("ids", i + 1, F.lit(most)))).alias("piece", "part"))
    joined = placed.join(cuts, ["doc_id", "piece"])
    one = F.struct("position", F.col("of").alias("doc_id"), "piece", "start", "length", "part")
    bins = joined.groupBy("bin_id", "bin_length").agg(F.sort_array(F.collect_list(one)).alias("x"))
    ids = F.flatten(F.col("x.part"))
    spans = F.transform("x", lambda s: F.struct(*(s[c] for c in ("position", "doc_id", "piece", "start", "length")))).cast(SEQUENCE)
    return bins.select("bin_id", "bin_length", F.concat(ids, F.array_repeat(F.lit(pad), F.col("bin_length") - F.size(ids))).alias("ids"), spans.alias("spans"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packed(docs, token_count(docs["text"]))
