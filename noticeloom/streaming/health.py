"""The health of sources as a stream: silence is found by timers, without an item; a changed format by the last items.

State is a row and a list of at most ``FORMAT_LAST`` items a source, in the RocksDB state store. Time is that of the items: the
watermark says how far it has come, and a timer stands ``SILENCE_DAYS`` after each source's last item. The batch operators
(:func:`noticeloom.operators.monitoring.problems`) say the same of the same items at the same instant.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from noticeloom import settings

CHANGES = "source string, problem string, transition string, at timestamp"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _milliseconds(instant: pd.Timestamp) -> int:
    return int(pd.Timestamp(instant).value // 1_000_000)


def transition(before: str | None, now: str | None) -> str:
    return "recovered" if now is None else "new" if before is None else "changed"


class SourceHealth(StatefulProcessor):
    """``id, published, has_classes`` of one source to the changes of its problem."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.problem = handle.getValueState("problem", "problem string")
        self.recent = handle.getListState("recent", "published timestamp, id long, has_classes boolean")

    def _changed(self, source: str, now: str | None, at: pd.Timestamp) -> Iterator[pd.DataFrame]:
        before = self.problem.get()[0] if self.problem.exists() else None
        if now != before:
            self.problem.update((now,))
            yield pd.DataFrame({"source": [source], "problem": [now], "transition": [transition(before, now)], "at": [at]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(list(self.recent.get()) if self.recent.exists() else [], columns=["published", "id", "has_classes"])
        for batch in rows:
            both = pd.concat([kept, batch[["published", "id", "has_classes"]]]) if len(kept) else batch[["published", "id", "has_classes"]]
            kept = both.sort_values(["published", "id"], kind="stable").tail(settings.FORMAT_LAST)
        self.recent.put([(pd.Timestamp(p).to_pydatetime(), int(i), bool(c)) for p, i, c in kept.itertuples(index=False)])
        last = pd.Timestamp(kept["published"].iloc[-1])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(_milliseconds(last) + settings.SILENCE_DAYS * 86_400_000)
        odd = len(kept) >= settings.FORMAT_LEAST and int(kept["has_classes"].sum()) < settings.FORMAT_SHARE * len(kept)
        yield from self._changed(key[0], "formato" if odd else None, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.UTC).replace(tzinfo=None)
        yield from self._changed(key[0], "silenzio", pd.Timestamp(at))

    def close(self) -> None:
        pass


def changes(items: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A stream of ``source, id, published, has_classes`` to ``source, problem, transition, at``. ``delay``: how late an item may come."""
    watched = items.withWatermark("published", delay).groupBy("source")
    return watched.transformWithStateInPandas(SourceHealth(), CHANGES, "Append", "EventTime")


def followed(spark: SparkSession, items: DataFrame, base: str, delay: str = "0 seconds") -> DataFrame:
    """All changes so far, after taking in what has arrived since the last call with the same ``base``."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:

        def write(rows: DataFrame, batch: int) -> None:
            rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/changes/part={batch}")

        query = changes(items, delay).writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.parquet(f"{base}/changes").drop("part")


def current(found: DataFrame) -> DataFrame:
    """``source, problem`` of the sources that have one now, from all changes."""
    last = found.groupBy("source").agg(F.max_by("problem", F.struct("at", "batch")).alias("problem"))
    return last.where("problem is not null")
