"""The engine's tables, and queries for rows that break their constraints (Spark has no CHECK, UNIQUE or foreign keys)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "text": T.StringType(), "bool": T.BooleanType(), "time": T.TimestampType(), "date": T.DateType()}
_LINKS = T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("label", T.StringType())]))
_DISAGREEMENTS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("field", "heading", "document")]))


def _table(fields: str, **special: T.DataType) -> T.StructType:
    pairs = (x.split(":") for x in fields.split())
    return T.StructType([T.StructField(name, special.get(name) or _TYPES[kind]) for name, kind in pairs])


TABLES = {
    "recipient": _table("recipient:long email:text active:bool created:time deactivated:time split:bool"),
    "preference": _table("recipient:long kind:text value:text"),
    "publication": _table("publication:long source:text key:text url:text heading:text published:time documents:x read:time updated:time", documents=_LINKS),
    "notice": _table(
        "id:long type:text staff:text classes:x school:text school_code:text town:text province:text province_from:text protocol:text protocol_date:text "
        "referred_protocol:text hours:int until:text deadline:time document:text fingerprint:text unread:bool unreadable:bool disagreements:x created:time updated:time arrived:text",
        classes=T.ArrayType(T.StringType()),
        disagreements=_DISAGREEMENTS,
    ),
    "announcement": _table("publication:long id:long"),
    "digest": _table("digest:long recipient:long day:date province:text sent:time"),
    "ledger": _table("recipient:long id:long digest:long"),
    "document": _table("hash:text kind:text size:int text:text region:text following:text error:text created:time"),
    "publication_document": _table("publication:long url:text place:int hash:text error:text read:time"),
    "source_state": _table("source:text last_success:time last_error:time message:text problem:text problem_since:time last_alert:date recovered:time"),
    "alert": _table("alert:long recipient:long day:date sent:time"),
    "document_part": _table("archive:text place:int name:text part:text"),
    "possible_duplicate": _table("a:long b:long"),
    "alias": _table("old:long id:long"),
    "extracted": _table("publication:long digest:text"),
}

KEYS = {
    "recipient": ["recipient"],
    "preference": ["recipient", "kind", "value"],
    "publication": ["publication"],
    "notice": ["id"],
    "announcement": ["publication", "id"],
    "digest": ["recipient", "day", "province"],
    "ledger": ["recipient", "id"],
    "document": ["hash"],
    "publication_document": ["publication", "url"],
    "source_state": ["source"],
    "alert": ["recipient", "day"],
    "document_part": ["archive", "place"],
    "possible_duplicate": ["a", "b"],
    "alias": ["old"],
    "extracted": ["publication"],
}

# What the constrained columns may hold.
CHECKS = {
    "recipient": ["active = (deactivated is null)"],
    "preference": ["kind in ('classe', 'gruppo', 'provincia')"],
    "notice": [
        "type in ('interpello', 'annullamento', 'rettifica', 'riapertura', 'esito')",
        "staff in ('docente', 'ata-dsga', 'altro')",
        "(province is null) = (province_from is null)",
    ],
    "publication_document": ["(hash is null) = (error is not null)"],
    "source_state": ["problem is null or problem in ('errore', 'silenzio', 'formato')", "(problem is null) = (problem_since is null)"],
    "possible_duplicate": ["a < b"],
}

REFERENCES = [
    ("preference", "recipient", "recipient", "recipient"),
    ("announcement", "publication", "publication", "publication"),
    ("announcement", "id", "notice", "id"),
    ("ledger", "recipient", "recipient", "recipient"),
    ("ledger", "id", "notice", "id"),
    ("digest", "recipient", "recipient", "recipient"),
    ("alert", "recipient", "recipient", "recipient"),
    ("notice", "document", "document", "hash"),
    ("alias", "id", "notice", "id"),
]


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """Older files lack younger columns: they are null (false for flags)."""
    have = set(df.columns)
    fill = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(False if isinstance(f.dataType, T.BooleanType) else None).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]
    return df.select(*fill)


def read_state(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return conformed(spark.read.parquet(f"{folder}/{name}"), name)


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rule, rows`` of all broken keys (nulls are equal), checks and references."""
    found = []
    for name, df in tables.items():
        twice = df.groupBy(*KEYS[name]).count().where("count > 1")
        found.append(twice.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit("unique " + ", ".join(KEYS[name])).alias("rule"), "rows"))
        checks = list(CHECKS.get(name, []))
        if checks:
            counts = df.agg(*(F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(f"_{i}") for i, c in enumerate(checks)))
            rows = F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(f"_{i}").alias("rows")) for i, c in enumerate(checks))))
            found.append(counts.select(rows.alias("x")).select(F.lit(name).alias("table"), "x.rule", "x.rows"))
    for child, column, parent, key in REFERENCES:
        if child in tables and parent in tables:
            lost = tables[child].where(F.col(column).isNotNull()).join(tables[parent].select(F.col(key).alias(column)), column, "left_anti")
            found.append(lost.agg(F.count("*").alias("rows")).select(F.lit(child).alias("table"), F.lit(f"{column} in {parent}").alias("rule"), "rows"))
    return reduce(DataFrame.unionByName, found).where("rows > 0")
