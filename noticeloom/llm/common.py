"""What the operators share: reading a table, a folder that all executors see, written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: The temporary folder of this process, once one is needed.
_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session (tests) may name none: then a temporary folder of this process is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs a shared folder: set spark.checkpoint.dir")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="noticeloom-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = _OWN[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one job, in a folder of its own under the shared one; they can be deleted once they have been read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.paths = spark, shared_dir(spark, label), {}

    def written(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Cut the lineage: the rows as a Parquet table. A table of the same name from before is deleted."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path, compression=compression)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def few(df: DataFrame, most: int) -> DataFrame:
    """The rows, to be broadcast if they are counted as ``most`` at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def sieved(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int = 28) -> DataFrame:
    """The rows without most of those whose key isn't wanted; what stays has to be joined exactly. Keys aren't null.

    One bit a hash, in 2 ** (bits - 15) rows of 4 KB: however much is wanted, 32 MB are broadcast at most.
    """
    own, number = [c for c in (f"_sieve{i}" for i in range(len(rows.columns) + 2)) if c not in rows.columns][:2], F.pmod(F.xxhash64(*keys), F.lit(1 << bits)) + 1
    bucket, position = own
    marks = wanted.select(F.bitmap_bucket_number(number).alias(bucket), F.bitmap_bit_position(number).alias("_at")).groupBy(bucket).agg(F.bitmap_construct_agg("_at").alias("_bits"))
    held = rows.withColumn(bucket, F.bitmap_bucket_number(number)).withColumn(position, F.bitmap_bit_position(number)).join(F.broadcast(marks), bucket)
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast({position} div 8 + 1 as int), 1)")), 16, 10).cast("int")
    return held.where(F.getbit(byte, (F.col(position) % 8).cast("int")) == 1).select(*rows.columns)


def slices(batches: Iterator, rows: int = 500) -> Iterator:
    """The batches of a task in parts of so many rows: Spark bounds a batch by bytes, this bounds what is made of it at once."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.iloc[i : i + rows].reset_index(drop=True)


def in_pandas(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``mapInPandas``, but ``ids`` are nullable integers: with a null in a batch pandas would make floats of them, which don't hold 64 bits."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frames() -> Iterator[pd.DataFrame]:
            for batch in batches:
                frame = batch.to_pandas()
                for name in ids:
                    if pa.types.is_integer(batch.column(name).type):
                        frame[name] = batch.column(name).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)
                yield frame

        for frame in run(frames()):
            yield pa.RecordBatch.from_pandas(frame, schema=out, preserve_index=False)

    return df.mapInArrow(mapped, schema)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def utf8(column: Column) -> Column:
    return column.cast("binary")


def hex_uniform(key: Column, digits: int = 13) -> Column:
    """A long below 16**digits from the MD5 of a string: the same on any engine that has MD5."""
    return F.conv(F.substring(F.md5(utf8(key)), 1, digits), 16, 10).cast("long")
