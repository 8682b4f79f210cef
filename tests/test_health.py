"""The stream of sources' health on replayed days, against the batch operators at the same instants."""

import datetime as dt
import unicodedata

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeloom.functions import places
from noticeloom.operators import monitoring
from noticeloom.operators.shares import shared_folder
from noticeloom.streaming import health

ITEMS = "source string, id long, published timestamp, has_classes boolean"


def test_health_of_replayed_days_equals_batch(spark, tmp_path):
    start, base, folder = dt.datetime(2026, 9, 1, 8), shared_folder(spark, "health-test"), str(tmp_path / "items")
    rows = []
    for day in range(18):
        at = start + dt.timedelta(days=day)
        rows.append([("steady", 10 * day, at, True), ("steady", 10 * day + 1, at + dt.timedelta(hours=1), True)])
        if day < 4 or day > 14:  # silent between, and back
            rows[-1].append(("stops", 10 * day + 2, at, True))
        rows[-1] += [("odd", 10 * day + 3 + i, at, day < 5) for i in range(2)]
    seen = []
    for part in (rows[:5], rows[5:13], rows[13:]):
        for day in part:
            spark.createDataFrame(day, ITEMS).coalesce(1).write.mode("append").parquet(folder)
            seen += day
        stream = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 3).parquet(folder)
        got = {r["source"]: r["problem"] for r in health.current(health.followed(spark, stream, base)).collect()}
        every = spark.createDataFrame(seen, ITEMS)
        read = every.select("source").distinct().withColumn("error", F.lit(None).cast("string"))
        now = F.lit(max(r[2] for r in seen))
        want = {r["source"]: r["problem"] for r in monitoring.problems(read, every, now).where("problem is not null").collect()}
        assert got == want
    moves = [r["transition"] for r in spark.read.parquet(f"{base}/changes").where("source = 'stops'").orderBy("at").collect()]
    assert moves == ["new", "recovered"]


@given(st.text(max_size=40))
def test_folding_equals_its_definition(text):
    assert places.folded(text) == "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")).lower()
