"""A look at the sources without writing anything. ``python -m noticeloom.plans.check --help``."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noticeloom import schemas
from noticeloom.functions import codes
from noticeloom.operators import monitoring
from noticeloom.plans.job import collected


def main(argv: list[str] | None = None, now: dt.datetime | None = None) -> int:
    """A line a source over the first-read window: items, those with classes, the last one, or what is wrong. 1 if a source is."""
    p = argparse.ArgumentParser(prog="noticeloom-check", description="Read each source's last days and report what it gives.")
    p.add_argument("--sources", required=True, help="JSON catalogue of the sources")
    p.add_argument("--replay", help="file of recorded responses instead of the network")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    outcomes, read = collected(spark, a.sources, schemas.empty(spark, "publication"), now or dt.datetime.now(dt.UTC).replace(tzinfo=None), a.replay)
    report = monitoring.source_report(outcomes.select("source"), read.withColumn("classes", codes.classes(F.col("heading"))["codes"]))
    bad = 0
    for r in report.join(outcomes, "source").orderBy("source").collect():  # a row a source
        wrong = r["error"] or ("no items" if not r["n"] else None)
        bad += wrong is not None
        print(f"{r['source']}: " + (wrong or f"{r['n']} items, {r['with_classes']} with classes, last {r['last']:%Y-%m-%d}"))
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
