"""The recipients' command: list, add, change, deactivate, forget. ``python -m noticeloom.plans.recipients --help``.

A request becomes one-row tables for :mod:`noticeloom.operators.recipients`. The new tables are written beside the old ones
under ``next``. Exit code 1: problems, all of them listed; 2: wrong usage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noticeloom import schemas
from noticeloom.operators import digest, recipients, rendering


def _listed(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="noticeloom-recipients")
    p.add_argument("--state", required=True, help="folder of the state tables")
    p.add_argument("--classes", help="JSON object of class names")
    p.add_argument("--groups", help="JSON object of groups")
    p.add_argument("--provinces", help="CSV of provinces, with a column sigla")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("add", "change"):
        s = sub.add_parser(name)
        s.add_argument("email")
        for kind in ("class", "group", "province"):
            s.add_argument(f"--{kind}", action="append", type=_listed, default=[])
        s.add_argument("--split", action=argparse.BooleanOptionalAction, help="one digest for each province")
        if name == "change":
            s.add_argument("--email", dest="new_email")
    for name in ("deactivate", "forget"):
        sub.add_parser(name).add_argument("email")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    from noticeloom.sources import configuration

    a = arguments(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    people, wanted = (schemas.read_state(spark, a.state, t) for t in ("recipient", "preference"))

    def write(name, df):
        schemas.conformed(df, name).write.mode("overwrite").parquet(f"{a.state}/next/{name}")

    if a.command == "list":
        for r in rendering.described(people.join(digest.preferences_by_kind(wanted), "recipient", "left")).join(people.select("recipient", "email"), "recipient").orderBy("email").toLocalIterator():
            print(r["text"])
        return 0
    asked = spark.createDataFrame([(a.email,)], "email string")
    hit = recipients.by_email(people, asked).select("recipient").first()
    if a.command != "add" and hit is None:
        print("no such recipient", file=sys.stderr)
        return 1
    one = spark.createDataFrame([(hit[0] if hit else (people.agg(F.max("recipient")).first()[0] or 0) + 1,)], "recipient long")
    if a.command == "deactivate":
        write("recipient", recipients.deactivated(people, one, F.current_timestamp()))
        return 0
    if a.command == "forget":
        kept, ledger = recipients.forgotten(schemas.read_state(spark, a.state, "digest"), schemas.read_state(spark, a.state, "ledger"), one)
        write("digest", kept)
        write("ledger", ledger)
        return 0
    if a.command == "add" and hit is not None:
        print("indirizzo già presente", file=sys.stderr)
        return 1
    who = one.first()[0]
    kinds = (("classe", a.__dict__["class"]), ("gruppo", a.group), ("provincia", a.province))
    new = spark.createDataFrame([(who, kind, v) for kind, lists in kinds for values in lists for v in values], "recipient long, kind string, value string")
    request = spark.createDataFrame([(who, a.email if a.command == "add" else a.new_email, a.split)], "recipient long, email string, split boolean")
    after = recipients.replaced_preferences(wanted, new, new.limit(0).select("recipient")).where(F.col("recipient") == who)
    none = spark.createDataFrame([], "value string")
    classes = configuration.class_names(spark, a.classes).select(F.col("class").alias("value")) if a.classes else none
    groups = configuration.group_members(spark, a.groups).select(F.col("name").alias("value")).distinct() if a.groups else none
    provinces = configuration.read_csv(spark, a.provinces).select(F.col("sigla").alias("value")) if a.provinces else none
    found = recipients.problems(people, request, after, classes, groups, provinces)
    said = sorted(r["problem"] for r in found.collect())
    if not after.count() and a.command == "add":
        said += ["serve almeno una Classe di concorso o un Gruppo di classi", "serve almeno una Provincia"]
    if said:
        print("\n".join(said), file=sys.stderr)
        return 1
    change = recipients.added(people, request, found, F.current_timestamp()) if a.command == "add" else recipients.modified(people, request, found)
    write("recipient", change)
    write("preference", recipients.replaced_preferences(wanted, new, found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
