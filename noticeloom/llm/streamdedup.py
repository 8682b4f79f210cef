"""Exact deduplication of a stream of documents, with keyed state on disk that never expires.

Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``. Two streams run one after the other:

1. *Arrivals*: every document becomes a narrow row: digest of the normalised text, code points of the text as it came,
   ``doc_id``, and the content's locator (file and row in it). Nothing is grouped.
2. *State*: a streaming aggregation by digest over the arrivals, without watermark, so that nothing expires, in the RocksDB
   state store. A digest's state is its number of documents and the document to keep: identifier and content locator.
   Copies are combined in the map tasks before they meet, so a group of copies of any size sends a row a task.

A digest that more than one document has is a *hit*. :meth:`StreamingDedup.checked` reads the texts of all hits by their
locators and compares full bytes, again combined before they meet. Should different texts share a digest, they are told
apart by their bytes (:meth:`StreamingDedup.result`).

Of equal texts, the one with the most code points as it came, then the smallest ``doc_id``, then the first locator, stays.
Calling :meth:`StreamingDedup.ingest` again takes what has arrived since, from the streams' checkpoints: each document
is counted once, whatever failed between.

Defined results: a null text counts as empty, and empty texts (or those of white space alone) are copies of each other; a
null ``doc_id`` comes after all others; rows that repeat an id, equal or not, are documents of their own, and of equal rows one
stays; an empty table gives an empty result; very long texts are compared whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import few, shared_dir, table, text_or_empty, utf8

#: Rows of locators that are broadcast at most, about 150 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 200_000
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # a store is small beside the megabytes that RocksDB sets aside for each of its logs and manifests
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(utf8(text), 256))


def _located(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


class StreamingDedup:
    """Documents (``doc_id, text``) of a folder or file of Parquet; all that is kept lies under ``base``, in the shared folder.

    ``digest`` makes the key of the state from a normalised text. ``files_per_batch`` bounds a micro-batch.
    """

    def __init__(self, spark: SparkSession, path: str, base: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000):
        self.spark, self.path, self.base, self.digest, self.files_per_batch = spark, path, base.rstrip("/"), digest, files_per_batch
        self.schema = spark.read.parquet(path).select("doc_id", "text").schema

    def _run(self, writer, name: str) -> None:
        query = writer.option("checkpointLocation", f"{self.base}/checkpoints/{name}").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()

    def ingest(self) -> None:
        """Take in every document that isn't in the state yet."""
        path = self.path.rstrip("/")
        pattern = f"{path[:-1]}[{path[-1]}]"  # matches the path alone: as a pattern it may be a file too, not only a folder
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(pattern)
        arrivals = _located(stream, F.col("doc_id"), F.length(text_or_empty("text")).alias("chars"), self.digest(normalised()).alias("digest"))
        self._run(arrivals.writeStream.format("parquet").option("path", f"{self.base}/arrivals"), "arrivals")
        if not self._any("arrivals"):
            return
        kept = F.struct((-F.col("chars")).alias("_chars"), F.col("doc_id").isNull().alias("_unnamed"), "doc_id", "file", "row")
        arrived = self.spark.readStream.schema(self.arrivals.schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(f"{self.base}/arrivals")
        state = arrived.groupBy("digest").agg(F.count("*").alias("n"), F.min(kept).alias("keeper"))
        path = f"{self.base}/updates"

        def update(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")  # a repeated batch writes the same rows again

        before = {k: self.spark.conf.get(k, None) for k in STATE_STORE}
        for k, v in STATE_STORE.items():
            self.spark.conf.set(k, v)
        try:
            self._run(state.writeStream.outputMode("update").foreachBatch(update), "state")
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _any(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return any(s.getPath().getName().startswith("part-") for s in place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place))

    @property
    def arrivals(self) -> DataFrame:
        schema = f"doc_id {self.schema['doc_id'].dataType.simpleString()}, chars int, digest binary, file string, row long"
        return self.spark.read.schema(schema).parquet(f"{self.base}/arrivals")

    @property
    def state(self) -> DataFrame:
        """``digest, n, keeper``: the last update of each digest. Its number of documents only grows."""
        updates = self.spark.read.parquet(f"{self.base}/updates")
        if updates.agg(F.count_distinct("batch")).first()[0] == 1:
            return updates.drop("batch")
        return updates.groupBy("digest").agg(F.max("n").alias("n"), F.max_by("keeper", "n").alias("keeper"))

    def _texts(self, rows: DataFrame) -> DataFrame:
        """``digest, normal`` and locators of the given arrivals, their contents read by the locators."""
        contents = _located(self.spark.read.schema(self.schema).parquet(self.path), F.col("text"))
        found = contents.join(few(rows.select("file", "row", "digest", "doc_id", "chars"), MOST_BROADCAST), ["file", "row"])
        return found.select("digest", normalised().alias("normal"), "doc_id", "chars", "file", "row")

    def checked(self) -> DataFrame:
        """``digest, contents, members``: for each hit, how many different texts its documents have, by full bytes."""
        hits = self.state.where("n > 1").select("digest")
        texts = self._texts(self.arrivals.join(few(hits, MOST_BROADCAST), "digest", "left_semi"))
        return texts.groupBy("digest", "normal").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("contents"), F.sum("n").alias("members"))

    def result(self) -> DataFrame:
        """``doc_id, keep_id, group_size, kept, digest``: a row for each document that was taken in."""
        if not self._any("arrivals"):
            kind = self.schema["doc_id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"doc_id {kind}, keep_id {kind}, group_size long, kept boolean, digest binary")
        state = self.state
        checks = self.checked()
        checks.write.parquet(path := f"{shared_dir(self.spark, 'dedup-checks')}")
        checks = self.spark.read.parquet(path)
        missed = state.where("n > 1").join(checks, "digest", "left").where("members is null or members <> n")
        if not missed.isEmpty():
            raise ValueError("contents of documents that were taken in are gone or changed: their bytes can't be checked")
        shared = checks.where("contents > 1").select("digest")
        told = self.arrivals.join(state, "digest")
        if not shared.isEmpty():  # different texts with one digest: by their bytes
            texts = self._texts(self.arrivals.join(few(shared, MOST_BROADCAST), "digest", "left_semi"))
            kept = F.struct((-F.col("chars")).alias("_chars"), F.col("doc_id").isNull().alias("_unnamed"), "doc_id", "file", "row")
            apart = texts.groupBy("digest", "normal").agg(F.count("*").alias("n"), F.min(kept).alias("keeper"))
            apart = texts.join(apart, ["digest", "normal"]).drop("normal")
            told = told.join(few(shared, MOST_BROADCAST), "digest", "left_anti").unionByName(apart)
        kept = (F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))
        return told.select("doc_id", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest")


def op12_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dedup = StreamingDedup(spark, f"{sf_dir}/documents.parquet", shared_dir(spark, "dedup"))
    dedup.ingest()
    return dedup.result().select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY normal) AS group_size
  FROM d WINDOW w AS (PARTITION BY normal ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(normal) AS text_sha256 FROM r
"""
