r"""WARC archives: writing with de-duplication, and reading by boundary-chain verification.

Writing. Of records with equal payloads, that with the largest id becomes a ``response`` and the others ``revisit`` it
without a body. Spark's text writer with the record separator ``\r\n\r\n`` writes the archives, to any file system that
Spark can write, and without Python.

Reading. Spark's text reader cuts the archives, in parallel and inside files too, at each version line ``WARC/1.1``:
each piece is a candidate record, a true one or magic inside a payload. Each task emits its candidates with their offset
in the split and, from Content-Length, the offset of their successor; the sizes of the splits before make offsets in the
file. Pointer jumping from the start of each file then marks the reachable records: every round doubles the distance, so
a chain of n records takes about log2(n) joins of narrow rows. What isn't reachable is dropped. Payloads that reach over
later pieces are joined together in the task that reads them; if one crosses into another split, a second pass over the
pieces of those records alone puts it together. The same pass reads records that seemed to lie inside another, and very
large ones.

Defined results: a null payload counts as empty; a null id is written as ``null`` and read as null; rows that repeat an id
are records each, and of equal payloads under the largest id all rows with that id are responses; an empty table gives an
archive without records; a very long payload has to fit a row; a record that ends beyond the end of its file, and what
follows it, is not reachable; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import Scratch, few, shared_dir, table, utf8, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: A broadcast table of repeated payloads has at most so many rows of about 60 bytes; beyond that a shuffled join does it.
MOST_BROADCAST = 500_000
#: Bytes of a block that the first pass puts together at most; a larger one is left to the second.
MOST_HELD = 32 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: The digits of base 32 in base-32-hex order and in the order of RFC 4648.
HEX32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), HEX32, RFC32)


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html`` to those with ``payload, digest, refers_to`` (null: this one is a response)."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload")).withColumn("digest", base32_sha1(utf8(F.col("payload"))))
    long_enough = F.octet_length("payload") >= least_bytes
    again = written(
        rows.where(long_enough).groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeats"
    )
    joined = rows.join(few(again, MOST_BROADCAST), "digest", "left")
    return joined.withColumn("refers_to", F.when(long_enough & ~F.col("page_id").eqNullSafe(F.col("last_id")), F.col("last_id"))).drop("last_id")


def record_text(rows: DataFrame) -> Column:
    """The record without its end; ``rows`` as of :func:`deduplicated`."""
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    size = F.octet_length("payload").cast("string")
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.concat(F.lit(HTTP), size, F.lit(END))).otherwise(F.concat(F.lit(HTTP), size, F.lit(END), F.col("payload")))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:none")), r"[\x00-\x20\x7f]", "")
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    deduplicated(pages, least_bytes).select(record_text(pages).alias("value")).write.option("lineSep", END).text(path)


# --- reading -------------------------------------------------------------------------------------------------------

CANDIDATE = (
    "file string, split long, size long, at long, next long, warc_type string, page_id string, refers_to string, url string, "
    "payload_digest string, payload_bytes long, actual_digest string, payload binary, whole boolean"
)
FIELDS = [x.split()[0] for x in CANDIDATE.split(", ")]
_SEP = MAGIC.encode()
_FIELD = {k: re.compile(rb"(?mi)^" + k + rb":[ \t]*([^\r\n]*)") for k in (b"WARC-Type", b"WARC-Record-ID", b"WARC-Refers-To", b"WARC-Target-URI", b"WARC-Payload-Digest", b"Content-Length")}


def _field(head: bytes, name: bytes) -> str | None:
    m = _FIELD[name].search(head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def _page(urn: str | None) -> str | None:
    return urn[10:-1] if urn and urn.startswith("<urn:page:") else None


def parsed_head(piece: bytes) -> tuple[bytes, int, int] | None:
    """Header, where the block starts in the piece, and the block's size; None if it is no header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    size = _field(piece[:end], b"Content-Length")
    return (piece[:end], end + 4, int(size)) if size and size.isdigit() and len(size) < 16 else None


def described(head: bytes, block: bytes | None) -> dict:
    """The fields of a record; payload and digest from its block, if that is whole."""
    out = {
        "warc_type": _field(head, b"WARC-Type"),
        "page_id": _page(_field(head, b"WARC-Record-ID")),
        "refers_to": _page(_field(head, b"WARC-Refers-To")),
        "url": _field(head, b"WARC-Target-URI"),
        "payload_digest": (_field(head, b"WARC-Payload-Digest") or "").removeprefix("sha1:") or None,
        "whole": block is not None,
    }
    if block is not None:
        http, _, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?mi)^Content-Length:[ \t]*(\d+)", http)
        if out["warc_type"] == "revisit":
            out |= {"payload_bytes": int(said[1]) if said else None}
        else:
            out |= {"payload": payload, "payload_bytes": len(payload), "actual_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
    return out


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces in the order of a split to candidates. A last row of each split (``at`` null) has the split's size.

    One record is put together at a time: a candidate inside it gives its offsets alone (not ``whole``), as does one whose
    block is larger than ``MOST_HELD`` or ends beyond the split. So a task holds one block, and rows together hold every
    byte once, however many headers a payload shows. If such a candidate proves to be a record, the second pass reads it.
    """
    split, at, open_, held, rows = None, 0, None, bytearray(), []

    def row(x: dict, block: bytes | None) -> dict:
        return {k: x[k] for k in ("file", "split", "at", "next")} | described(x["head"], block)

    def end() -> None:
        if open_:
            rows.append(row(open_, None))
        if split:
            rows.append({"file": split[0], "split": split[1], "size": at})

    for batch in batches:
        for file, start, piece in zip(batch["file"], batch["split"], batch["piece"], strict=True):
            if (file, start) != split:
                end()
                split, at, open_ = (file, start), 0, None
            parsed = parsed_head(piece)
            if parsed:
                head, begin, size = parsed
                # the version line stands before the piece; the first piece of a file has none, and no header
                found = {"file": file, "split": start, "at": at - len(_SEP), "next": at + begin + size + len(END), "head": head, "begin": begin, "end": begin + size}
            if open_:
                held += _SEP
                held += piece
                if parsed:
                    rows.append(row(found, None))
            elif parsed and size <= MOST_HELD:
                open_, held = found, bytearray(piece)
            elif parsed:
                rows.append(row(found, None))
            if open_ and len(held) >= open_["end"]:
                rows.append(row(open_, bytes(memoryview(held)[open_["begin"] : open_["end"]])))
                open_, held = None, bytearray()
            at += len(piece) + len(_SEP)
            if len(rows) >= 500:
                yield pd.DataFrame(rows, columns=FIELDS, dtype=object)
                rows.clear()
    end()
    yield pd.DataFrame(rows, columns=FIELDS, dtype=object)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


def split_bases(splits: DataFrame) -> DataFrame:
    """The reader of a split goes on where that before it ended: the sizes before add up to where a split begins."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("size").over(Window.partitionBy("file")) - len(_SEP)  # the last piece has no version line after it
    return splits.select("file", "split", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), total.alias("file_size"))


def reachable(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``file, at, next`` to the ``file, at`` that a chain from offset 0 reaches, by pointer jumping."""
    state = scratch.written(links.groupBy("file", "at").agg(F.max("next").alias("jump")).withColumn("seen", F.col("at") == 0), "chain")
    # jumps only lead onwards, so that they all end
    while not state.where("seen and jump is not null").isEmpty():
        target = state.select("file", F.col("at").alias("jump"), F.col("jump").alias("onward"), F.lit(True).alias("there"))
        moved = state.join(target, ["file", "jump"], "left")
        step = F.explode(
            F.array(
                F.struct("at", F.col("onward").alias("jump"), F.col("seen")),
                F.struct(F.when(F.col("seen") & F.col("there"), F.col("jump")).alias("at"), F.lit(None).cast("long").alias("jump"), F.lit(True).alias("seen")),
            )
        )
        rows = moved.select("file", step.alias("x")).select("file", "x.*").where("at is not null")
        state = scratch.written(rows.groupBy("file", "at").agg(F.max("jump").alias("jump"), F.max("seen").alias("seen")), "chain")
    return state.where("seen").select("file", "at")


def _joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """One record from its pieces in order."""
    group = group.sort_values("piece_at")
    held = _SEP.join(group["piece"])
    head, begin, size = parsed_head(held)
    row = {"file": key[0], "at": key[1]} | described(head, held[begin : begin + size])
    return pd.DataFrame([row], columns=["file", "at", *FIELDS[5:]], dtype=object)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The reachable records: ``file, at, warc_type, page_id, refers_to, url, payload_digest, payload_bytes, actual_digest, payload``."""
    scratch = Scratch(spark, "warc-read")
    found = pieces(spark, path).mapInPandas(_candidates, CANDIDATE)
    # one narrow pass: the offsets of candidates and the sizes of splits
    narrow = scratch.written(found.select("file", "split", "size", F.col("at").alias("rel"), F.col("next").alias("rel_next"), "whole"), "candidates")
    bases = scratch.written(split_bases(narrow.where("size is not null")), "bases")
    links = narrow.where("size is null").join(bases, ["file", "split"]).select("file", "split", "whole", "base", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("rel_next")).alias("next"), "file_size")
    links = scratch.written(links.where("next <= file_size").drop("file_size"), "links")
    kept = scratch.written(links.join(reachable(links, scratch), ["file", "at"], "left_semi"), "kept")
    scratch.drop("candidates", "links", "chain")
    columns = ["file", "at", *FIELDS[5:-1]]
    rows = found.where("size is null").withColumnRenamed("at", "rel").drop("next", "size")
    out = rows.where("whole").join(kept.select("file", "split", (F.col("at") - F.col("base")).alias("rel"), "at"), ["file", "split", "rel"]).select(*columns)
    torn = kept.where("not whole").select("file", F.col("at").alias("record_at"), "next")
    if torn.isEmpty():
        return out
    return out.unionByName(_torn_records(spark, path, torn, bases).select(*columns))


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    split, at = None, 0
    for batch in batches:
        offsets = []
        for file, start, piece in zip(batch["file"], batch["split"], batch["piece"], strict=True):
            if (file, start) != split:
                split, at = (file, start), 0
            offsets.append(at - len(_SEP))
            at += len(piece) + len(_SEP)
        yield batch.assign(rel=offsets)


def _torn_records(spark: SparkSession, path: str, torn: DataFrame, bases: DataFrame) -> DataFrame:
    """Records from the pieces that they reach over. Both sides meet in a split of a file, not in the file."""
    # splits of a file begin at multiples of one size; a piece belongs to the split that its first byte is in
    unit = bases.where("split > 0").agg(F.min("split")).first()[0] or 1 << 60
    reached = F.sequence(F.greatest(F.expr(f"record_at div {unit}") - 1, F.lit(0)), F.expr(f"(next + {len(_SEP)}) div {unit}"))
    records = torn.withColumn("k", F.explode(reached)).withColumn("split", F.col("k") * unit).drop("k").join(bases.select("file", "split", "base"), ["file", "split"])
    numbered = pieces(spark, path).mapInPandas(_numbered, "file string, split long, piece binary, rel long")
    mine = numbered.join(records, ["file", "split"]).withColumn("piece_at", F.col("base") + F.col("rel")).where("piece_at >= record_at and piece_at < next")
    schema = ", ".join(["file string", "at long", *CANDIDATE.split(", ")[5:]])
    return mine.select("file", F.col("record_at").alias("at"), "piece_at", "piece").groupBy("file", "at").applyInPandas(_joined, schema)


def op5_warc_boundary_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path)
    return records.select(
        F.expr("try_cast(page_id as bigint)").alias("page_id"),
        "payload_bytes",
        F.coalesce("actual_digest", "payload_digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
    )


#: DuckDB has SHA-1 in hex; a list turns each five bits into a digit of base 32.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: right('000' || bin(('0x' || substr(h, (i + 1)::BIGINT, 1))::BIGINT), 4)), '') AS bits FROM h),
d AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (list_sum(list_transform(range(5), lambda k: substr(bits, (5 * j + k + 1)::BIGINT, 1)::BIGINT << (4 - k))) + 1)::BIGINT, 1)), '') AS digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM m
"""
