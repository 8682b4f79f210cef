"""Ids of 64 bits beside a null, through every operator: 2**60 + 1 and 2**60 + 3 are one number as floats."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noticeloom.llm.common import sieved
from noticeloom.llm import attribution, decontam, filteraudit, langid, mpegts, nearjoin, packing, sharding, streamdedup, tokenfile

A, B, C = 2**60 + 1, 2**60 + 3, 2**60 + 5
WORDS = " ".join(f"word{i}" for i in range(60))
ROWS = [(A, WORDS), (B, WORDS + " more"), (None, "other text entirely"), (C, WORDS)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in one batch, with a column ``sections`` that clashes."""
    folder = str(tmp_path_factory.mktemp("ids"))
    rows = [(i, t, "en", "s", len(t), "clash") for i, t in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sections string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(A, WORDS[:120]), (None, WORDS[100:250])], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(A, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize(
    "query",
    [
        packing.op1_best_fit_packing,
        mpegts.op3_mpeg_transport_streams,
        langid.op4_language_id,
        tokenfile.op6_wavelet_token_files,
        attribution.op7_token_attribution,
        sharding.op8_rendezvous_sharding,
        nearjoin.op10_ngram_jaccard_join,
        streamdedup.op12_streaming_exact_dedup,
    ],
)
def test_ids_come_back(spark, folder, query):
    assert {r["doc_id"] for r in query(spark, folder).select("doc_id").collect()} == {A, B, C, None}


def test_ids_of_matches_and_links(spark, folder):
    found = decontam.op9_benchmark_decontamination(spark, folder)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(d, i) for d in (A, B, C) for i in (A, None)}
    links = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in nearjoin.op10_ngram_jaccard_join(spark, folder).collect()}
    assert links == {A: (A, 2), B: (A, 2), C: (A, 2), None: (None, 0)}
    kept = {r["doc_id"]: r["keep_id"] for r in streamdedup.op12_streaming_exact_dedup(spark, folder).collect()}
    assert kept == {A: A, B: B, C: A, None: None}


def test_one_of_a_group_stays_and_goes_through_the_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert {r["doc_id"] for r in nearjoin.one_of_each_group(docs).collect()} == {A, None}
    packed = corpus_pipeline.best_fit_packing(spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == {A, B, C, None}


def test_audit_counts_every_id(spark, folder):
    kept = filteraudit.op13_filter_interaction_audit(spark, folder).where("filter_order = 'EABCD' and step = 1")
    assert [(r["kept"], r["removed"]) for r in kept.collect()] == [(3, 1)]


def test_rows_without_words_are_not_joined_on_a_null_key(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else " ") for i in range(50)] + [(100, WORDS), (101, WORDS)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_links"] for r in nearjoin.ngram_jaccard_join(docs).collect()}
    assert got == {**dict.fromkeys(range(50), 0), 100: 1, 101: 1}
    # no join reads rows whose key is null
    plan = nearjoin.ngram_jaccard_join(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(key" in plan and plan.count("isnull(key") == 1


def test_sieve_keeps_what_is_wanted_and_little_else(spark):
    rows = spark.range(200_000).select((F.col("id") * 7).alias("k"), F.lit("x").alias("_sieve0"), F.concat(F.lit("t"), "id").alias("t"))
    wanted = rows.where("k % 1000 = 0").select("k", "t")
    for bits, most in ((28, 1.02), (16, 5.0)):
        got = sieved(rows, wanted, ["k", "t"], bits)
        assert got.columns == rows.columns
        assert got.join(wanted, ["k", "t"], "left_semi").count() == wanted.count()
        assert got.count() <= most * wanted.count()
    assert sieved(rows, wanted.limit(0), ["k", "t"]).count() == 0
