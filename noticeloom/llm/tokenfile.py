"""Token ids as files: a wavelet matrix for each shard, in ascending order of document ids.

Documents are range-partitioned by id; each task encodes its range in order and, at least every ``FILE_TOKENS`` ids, ends a
file (see :mod:`noticeloom.llm.wavelet`). Spark's text writer puts each file's bytes in the folder as one record, so any
file system that Spark writes will do; its binary reader reads them back. A task holds one file's ids at a time.

Defined results: a null text counts as empty; every document ends with the end id, so an empty one has one id; a null
doc_id is stored as the least and comes back null; rows that repeat an id follow each other in the order of a hash of
their text; a very long text is a document of a file like any other, which ends after it;
an empty table gives no files and an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import shared_dir, table, written
from noticeloom.llm.encoding import default_path, encoder
from noticeloom.llm.wavelet import TokenFile, to_bytes

END_ID = 2
#: Bytes of text dealt to a task, and ids in a file at most (but for the last document of a file).
SHARD_BYTES, FILE_TOKENS = 16 << 20, 8 << 20
NO_ID = -(1 << 63)
#: Words that the encoder remembers: here nothing else needs a worker's memory.
REMEMBERED = 800_000


def _file_writer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = encoder(path, REMEMBERED), TaskContext.get().partitionId(), 0
        ids, docs, lengths, size = [], [], [], 0

        def file() -> pa.RecordBatch:
            content = to_bytes(np.concatenate(ids), np.array(docs, np.int64), np.array(lengths, np.int64), part, number)
            for x in (ids, docs, lengths):
                x.clear()
            return pa.RecordBatch.from_pydict({"file": pa.array([content], pa.binary())})

        for batch in batches:
            coded, ends = coder.encode(batch["text"])
            at = 0
            for doc_id, end in zip(batch["doc_id"].to_pylist(), ends.tolist(), strict=True):
                ids += coded[at:end], np.array([end_id], coder.type)
                docs.append(NO_ID if doc_id is None else doc_id)
                lengths.append(end - at + 1)
                size, at = size + end - at + 1, end
                if size >= FILE_TOKENS:
                    yield file()
                    number, size = number + 1, 0
        if docs:
            yield file()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """``doc_id, text`` to wavelet-matrix files in ``path``."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(max(1, -(-total // SHARD_BYTES)), *order).sortWithinPartitions(*order)
    files = dealt.mapInArrow(_file_writer(tokenizer or default_path(), end_id), "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


READ = "part int, number int, place int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _file_reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            f = TokenFile(bytes(content))
            ids = f.matrix.ids().astype("<u4")
            ends = np.cumsum(f.lengths)
            starts = ends - f.lengths
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            ids_ = pd.array(f.doc_ids, "Int64")
            ids_[f.doc_ids == NO_ID] = pd.NA
            yield pd.DataFrame({"part": f.head["part"], "number": f.head["number"], "place": np.arange(len(crc)), "doc_id": ids_, "local_start": starts, "n_tokens": f.lengths, "ids_crc32": crc})


def token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; ``start`` counts the ids of all documents before."""
    rows = written(token_files(spark, path).mapInPandas(_file_reader, READ), "token-documents")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file
    bases = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n")).select("part", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, ["part", "number"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``doc_id, offset`` of every occurrence of an id, by rank and select in each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                f = TokenFile(bytes(content))
                starts = np.cumsum(f.lengths) - f.lengths
                at = np.array([f.matrix.occurrence(token, k) for k in range(f.matrix.count(token))], np.int64)
                doc = np.searchsorted(starts, at, "right") - 1
                yield pd.DataFrame({"doc_id": f.doc_ids[doc], "offset": at - starts[doc]})

    return token_files(spark, path).mapInPandas(run, "doc_id long, offset long")


def op6_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
