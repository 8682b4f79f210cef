"""A sparse document-term matrix in CSR shards, its words encoded by one global dictionary.

1. Each task counts the words of its documents and writes *shards* of about ``SHARD_BYTES`` of text: row pointers, column
   numbers and counts, with the shard's own vocabulary. A frequent word so leaves a task once a shard, not once a document.
2. The vocabularies meet once, dealt into buckets by a hash of the word; a word's bucket and its rank among the sorted
   different words of the bucket, nearly always the first, make its number, the same for all shards (:func:`dictionary`).
3. The numbers go back to their shards, packed, and each shard's columns are written anew with them (:func:`csr_shards`).

Words are the longest stretches without ``[\\x20\\x09-\\x0D]``, case-sensitive. A task holds one shard at a time; a longer
document is a shard of its own.

Defined results: a null text counts as empty and is a row without entries; equal rows are rows of their own; no order of
rows is promised, and the columns of a row stand in the order in which its words first occur; an empty table gives no
shards; very long texts count whole; only the columns named as carried pass, whatever further ones are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import Scratch, text_or_empty, utf8

SHARD_BYTES = 32 << 20
#: Of a word's number the low bits are its rank in its bucket, the others the bucket.
RANK_BITS = 16
#: Numbers that are packed at once on their way back to the shards.
PACKED = 500_000


class _Vocabulary(dict):
    """Words to numbers; a new word gets the next."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def squeezed(numbers: np.ndarray) -> bytes:
    """Integers as bytes by significance, compressed; the first byte tells their width, the next eight their count."""
    planes = numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()
    return bytes([numbers.itemsize]) + len(numbers).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unsqueezed(stored: bytes) -> np.ndarray:
    width, n = stored[0], int.from_bytes(stored[1:9], "little")
    planes = np.frombuffer(pa.decompress(stored[9:], width * n, "zstd"), np.uint8) if n else np.empty(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<i{width}").reshape(-1)


def _local_shards(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        vocabulary, columns, counts, ends, carried, size = _Vocabulary(), [], [], [0], [], 0

        def shard() -> pa.RecordBatch:
            rows = pa.concat_arrays(carried)
            packed = [squeezed(np.array(ends, "<i8")), squeezed(np.concatenate(columns)), squeezed(np.concatenate(counts))]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + made], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                    *(pa.array([x], pa.binary()) for x in packed),
                    pa.array([len(vocabulary)], pa.int32()),
                    pa.array([list(vocabulary)], pa.list_(pa.binary())),
                ],
                ["shard", "rows", "indptr", "indices", "data", "n_words", "words"],
            )

        for batch in batches:
            begin, row, texts = 0, batch.column("row"), batch.column("text")
            for i in range(len(batch)):
                found = Counter(texts[i].as_py().split())  # bytes: split() takes exactly the six characters
                columns.append(np.fromiter(map(vocabulary.__getitem__, found), "<i4", len(found)))
                counts.append(np.fromiter(found.values(), "<i4", len(found)))
                ends.append(ends[-1] + len(found))
                size += len(texts[i].as_buffer())
                if size >= shard_bytes:
                    carried.append(row.slice(begin, i + 1 - begin))
                    yield shard()
                    vocabulary, columns, counts, ends, carried, size = _Vocabulary(), [], [], [0], [], 0
                    begin, made = i + 1, made + 1
            if begin < len(batch):
                carried.append(row.slice(begin))
        if carried:
            yield shard()

    return run


def _struct_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def local_shards(docs: DataFrame, carried: Column, scratch: Scratch, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``shard, rows, indptr, indices, data, n_words, words``: columns numbered by each shard's own ``words``; ``rows`` holds ``carried`` (a struct) by row."""
    narrow = docs.select(carried.alias("row"), utf8(text_or_empty(text)).alias("text"))
    schema = f"shard long, rows array<{_struct_type(narrow, 'row')}>, indptr binary, indices binary, data binary, n_words int, words array<binary>"
    return scratch.written(narrow.mapInArrow(_local_shards(shard_bytes), schema), "shards", compression="zstd")


def dictionary(shards: DataFrame) -> DataFrame:
    """``shard, at, word, id``: the global number of each word of each shard's vocabulary. One shuffle of the vocabularies.

    Numbers differ for different words and are the same wherever a word occurs, but aren't dense.
    """
    words = shards.select("shard", F.posexplode("words").alias("at", "word")).withColumn("bucket", F.shiftrightunsigned(F.xxhash64("word"), RANK_BITS))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word")) - 1
    rank = F.when(rank < 1 << RANK_BITS, rank).otherwise(F.raise_error(F.lit("too many words in a bucket of the dictionary")).cast("int"))
    return words.select("shard", "at", "word", F.shiftleft("bucket", RANK_BITS).bitwiseOR(rank.cast("long")).alias("id"))


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words as one row for each shard that some hundred thousand of them belong to."""
    held, n = [], 0

    def packed() -> Iterator[pa.RecordBatch]:
        shard, at, number = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("shard", "at", "id"))
        order = np.argsort(shard, kind="stable")
        shard, at, number = shard[order], at[order].astype("<i4"), number[order].astype("<i8")
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist()
        ends = [*starts[1:], len(shard)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(shard[starts]),
                pa.array([at[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                pa.array([number[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
            ],
            ["shard", "at", "ids"],
        )

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= PACKED:
            yield from packed()
            held, n = [], 0
    if n:
        yield from packed()


def _globalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard first its matrix, then its vocabulary's numbers, to ``shard, rows, indptr, indices, data``."""
    matrix, numbers, missing = None, None, 0
    for batch in batches:
        for i in range(len(batch)):
            one = batch.slice(i, 1)
            if one.column("n_words")[0].is_valid:
                matrix, missing = one, one.column("n_words")[0].as_py()
                numbers = np.empty(missing, "<i8")
            else:
                at = np.frombuffer(one.column("at")[0].as_buffer(), "<i4")
                numbers[at] = np.frombuffer(one.column("ids")[0].as_buffer(), "<i8")
                missing -= len(at)
            if not missing:
                indptr, local, data = (unsqueezed(matrix.column(c)[0].as_py()) for c in ("indptr", "indices", "data"))
                yield pa.RecordBatch.from_arrays(
                    [matrix.column("shard"), matrix.column("rows"), *(pa.array([x.tobytes()], pa.binary()) for x in (indptr, numbers[local], data))],
                    ["shard", "rows", "indptr", "indices", "data"],
                )
                matrix = numbers = None


def _with_numbers(shards: DataFrame) -> DataFrame:
    """Each shard's matrix, followed by the packed numbers of its vocabulary, in one task."""
    packed = dictionary(shards).select("shard", "at", "id").mapInArrow(_packer, "shard long, at binary, ids binary")
    both = shards.drop("words").unionByName(packed, allowMissingColumns=True)
    return both.repartition("shard").sortWithinPartitions("shard", F.col("n_words").isNull())


def csr_shards(shards: DataFrame) -> DataFrame:
    """``shard, rows, indptr, indices, data``: CSR with global column numbers; little-endian int64, int64 and int32."""
    schema = f"shard long, rows {_struct_type(shards, 'rows')}, indptr binary, indices binary, data binary"
    return _with_numbers(shards).mapInArrow(_globalised, schema)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for one in _globalised(batches):
        indptr = np.frombuffer(one.column("indptr")[0].as_buffer(), "<i8")
        data = np.frombuffer(one.column("data")[0].as_buffer(), "<i4")
        before = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
        rows, columns = one.column("rows")[0].values, one.column("indices")[0].as_buffer()
        nonzero = np.diff(indptr)
        assert len(columns) == 8 * indptr[-1] and len(data) == indptr[-1]
        for at in range(0, len(rows), 10_000):
            end = min(at + 10_000, len(rows))
            yield pa.RecordBatch.from_arrays(
                [rows.slice(at, end - at), pa.array(before[indptr[at + 1 : end + 1]] - before[indptr[at:end]]), pa.array(nonzero[at:end])],
                ["row", "total", "nonzero"],
            )


def row_sums(shards: DataFrame) -> DataFrame:
    """``row, total, nonzero`` of each row of the matrix with global columns: what is carried, the sum of its counts, its number of columns."""
    element = shards.schema["rows"].dataType.elementType.simpleString()
    return _with_numbers(shards).mapInArrow(_sums, f"row {element}, total long, nonzero long")
