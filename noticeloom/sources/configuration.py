"""Configuration and dictionary scans, with every problem reported as a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.functions.patterns import TOWN_COLUMNS


def read_csv(spark: SparkSession, path: str, separator: str = ";", header: bool = True) -> DataFrame:
    """Quoted cells may hold separators, doubled quotes and line breaks; blank rows are dropped."""
    return spark.read.csv(path, sep=separator, header=header, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def town_list(spark: SparkSession, path: str) -> DataFrame:
    """``names, italian, province_name, province`` by place of the column."""
    raw = read_csv(spark, path)
    return raw.select(*(F.col(f"`{raw.columns[i]}`").alias(n) for n, i in TOWN_COLUMNS.items())).where("province is not null")


def json_map(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSON object file as ``key, value``; no row if the file isn't an object."""
    body = spark.read.text(path, wholetext=True)
    return body.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("key", "value"))


def class_names(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, "string").select(F.col("key").alias("class"), F.col("value").alias("name"))


def group_members(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, "array<string>").select(F.col("key").alias("name"), F.explode_outer("value").alias("class"))


def configuration_problems(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """``problem`` rows: empty groups and members that no class has."""
    empty = groups.where("class is null").select(F.concat(F.lit("empty group: "), "name").alias("problem"))
    unknown = groups.where("class is not null").join(classes.select("class"), "class", "left_anti")
    return empty.unionByName(unknown.select(F.concat(F.lit("unknown class in "), "name", F.lit(": "), "class").alias("problem")))


SOURCE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("nome", T.StringType()),
        T.StructField("adapter", T.StringType()),
        T.StructField(
            "impostazioni",
            T.StructType(
                [
                    T.StructField("api", T.StringType()),
                    T.StructField("cerca", T.StringType()),
                    T.StructField("categorie", T.ArrayType(T.IntegerType())),
                    T.StructField("perPagina", T.IntegerType()),
                    T.StructField("pagina", T.StringType()),
                ]
            ),
        ),
    ]
)


def source_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SOURCE).json(path, multiLine=True)


def source_problems(sources: DataFrame, adapters: tuple[str, ...] = ("wordpress", "pagina-decreti")) -> DataFrame:
    """``id, problem``: all problems of all sources together."""
    s = F.col("impostazioni")

    def rule(condition, problem: str):
        return F.when(~F.coalesce(condition, F.lit(False)), F.lit(problem))

    is_rest, is_page = F.col("adapter") == "wordpress", F.col("adapter") == "pagina-decreti"
    found = F.array(
        rule(F.col("id").rlike(r"^[a-z0-9-]+\z"), "id not valid"),
        rule(F.trim("nome") != "", "no name"),
        rule(F.col("adapter").isin(*adapters), "unknown adapter"),
        F.when(is_rest, rule(s["api"].rlike("^https?://"), '"api" must be a web address')),
        F.when(is_rest & (s["cerca"] == ""), F.lit('"cerca" must be a text')),
        F.when(is_rest & s["cerca"].isNull() & s["categorie"].isNull(), F.lit('needs "cerca" or "categorie"')),
        F.when(is_rest & ~F.coalesce(s["perPagina"].between(1, 100), F.lit(True)), F.lit('"perPagina" must be from 1 to 100')),
        F.when(is_page, rule(s["pagina"].rlike("^https?://"), '"pagina" must be a web address')),
    )
    own = sources.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))
    twice = sources.groupBy("id").count().where("count > 1").select("id", F.lit("id used twice").alias("problem"))
    return own.unionByName(twice)
