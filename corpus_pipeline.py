"""From raw documents to packed training sequences, in four stages.

``STAGES`` lists them in order. Each takes ``(spark, docs, sf_dir)``; all but the last return the columns of documents. Each
stage works on everything that the one before kept, written as Parquet and read again.

1. ``language_id``: documents without a recognisable language go: no letter, or a prediction nearer to a coin toss than
   half of what held-out documents of as many letters have (``langid.least_margins``). The model is of all labelled documents outside
   the held-out third, these bounds of all within it. Of a few letters little can be told, so that
   short texts rarely go, junk or not; where all labelled documents have one language, every text with a letter stays.
2. ``ngram_jaccard_join``: of each group of copies and near copies (five-word shingles, similarity 0.8 or more) the
   document with the least id stays.
3. ``benchmark_decontamination``: documents that hold a benchmark item, up to its budget of edits, go.
4. ``best_fit_packing``: what is left is packed into sequences of the permitted lengths, counted in tokens.

Defined results: a null or empty text, or one without a letter, goes in stage 1, whatever its other columns; equal rows are
judged alike, and stage 2 keeps one of them; ties go to the least id, then text; a null ``doc_id`` joins no group and stays; very
long texts count whole; empty tables give an empty result; further columns of documents pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticeloom.llm import decontam, langid, nearjoin, packing
from noticeloom.llm.common import table, written
from noticeloom.llm.encoding import token_count


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit_whole(docs)
    return docs.where(langid.recognised(model, langid.least_margins(docs, model), docs["text"]))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearjoin.one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, token_count(docs["text"]))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express a linear classifier, edit distances over every stretch of a text, or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
