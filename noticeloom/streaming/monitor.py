"""Streaming forms of collection and monitoring, for sources that arrive as streams.

The batch operators define the results; here their analogues run on unbounded input: counts in windows with a watermark of
the overlap, a per-source state machine, and an upsert of each micro-batch (late or edited items replace what is stored).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from noticeloom import settings
from noticeloom.operators.upserts import latest


def counts_by_window(items: DataFrame, width: str = "1 day", late_days: int = settings.OVERLAP_DAYS) -> DataFrame:
    """``source, published`` to ``source, start, n``; items later than the overlap are too late."""
    windowed = items.withWatermark("published", f"{late_days} days").groupBy(F.window("published", width), "source").agg(F.count("*").alias("n"))
    return windowed.select("source", F.col("window.start").alias("start"), "n")


TRANSITION = "source string, problem string, transition string, at timestamp"
STATE = "problem string, announced boolean"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    problem, announced = state.get if state.exists else (None, False)
    out = []
    rows = pd.concat(list(batches)).sort_values("at", kind="stable")
    for new, at in zip(rows["problem"], rows["at"], strict=True):
        new = None if pd.isna(new) else new
        if new != problem:
            out.append((key[0], new, "recovered" if new is None else "new" if problem is None else "changed", at))
            problem, announced = new, False
    state.update((problem, announced))
    yield pd.DataFrame(out, columns=["source", "problem", "transition", "at"])


def transitions(outcomes: DataFrame) -> DataFrame:
    """A stream of ``source, problem, at`` to the changes of each source's problem. State is one row a source."""
    return outcomes.groupBy("source").applyInPandasWithState(_step, TRANSITION, STATE, "append", GroupStateTimeout.NoTimeout)


def upsert_each_batch(items: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """Each micro-batch becomes a folder of ``path`` named by its number, so that a batch that runs twice writes the same; readers take the latest row of each key."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted_table(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(path)
    return latest(rows, keys, ["_batch"]).drop("_batch", "batch")
