"""Repair of conversations, stateful deduplication and the filter audit: against SQL on tables full of edges, and brute force."""

import heapq
import random
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from noticeloom.llm import filteraudit, repair, streamdedup, termmatrix
from noticeloom.llm.common import Scratch, shared_dir


def against_sql(spark, folder, query, sql, **tables):
    """Rows of a query and of its SQL on the given tables: ``name=(rows, schema)``."""
    db = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    out = query(spark, str(folder))
    got = Counter(tuple(r) for r in out.collect())
    want = Counter(db.sql(f"SELECT {', '.join(out.columns)} FROM ({sql})").fetchall())
    assert got == want, (list((got - want).items())[:5], list((want - got).items())[:5])
    return got


# --- repair ----------------------------------------------------------------------------------------------------------


def cheapest_by_dijkstra(turns):
    """Cost and least letters, by a search over (cost, letters)."""
    following = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, letters, i, said = heapq.heappop(heap)
        if (i, said) in done:
            continue
        done.add((i, said))
        if i == len(turns) and said in ("", "a"):
            return cost, letters
        heapq.heappush(heap, (cost + 3, letters + "I", i, following[said]))
        if i < len(turns):
            initial, fault = "suax"[turns[i] & 3], turns[i] >> 2
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, said))
            if fault in (0, 3):
                heapq.heappush(heap, (cost + 3 + fault, letters + "R", i + 1, following[said]))
                if said + initial in ("s", "u", "su", "ua", "au"):
                    heapq.heappush(heap, (cost + fault, letters + "K", i + 1, initial))
    raise AssertionError


def test_auction_equals_dijkstra_on_all_short_conversations():
    for n in range(4):
        for turns in product(range(16), repeat=n):
            assert repair.cheapest_edits(bytes(turns)) == cheapest_by_dijkstra(turns)


def test_auction_in_windows_equals_dijkstra():
    rng = random.Random(5)
    for _ in range(200):
        turns = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 9, 13, 14]) for _ in range(rng.randrange(100)))
        want = cheapest_by_dijkstra(turns)
        for window in (1, 3, 16, 1000):
            assert repair.cheapest_edits(turns, window) == want


def test_prices_are_dual_feasible_and_tight_along_the_path():
    rng = random.Random(6)
    for _ in range(50):
        turns = bytes(rng.randrange(16) for _ in range(12))
        terminal = tuple(cost for cost, _ in repair.CLOSING)
        prices = repair._fresh(turns, terminal)
        repair.auction(turns, repair.NOTHING, prices)
        for node in range(4 * len(turns)):
            for _, passed, then, cost in repair.ARCS[turns[node >> 2]][node & 3]:
                assert prices[node] <= cost + prices[(node & ~3) + 4 * passed + then]


CONVERSATIONS = "conv_id long, turn long, role string, text string, pos int, said string, audit int"


def conversations(rng, n):
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    texts = ["Ok.", "Ok.", "no end", "", " \t\n", None, "Why?", "città! ", "a\x1cb", "ends.\x1c", "x" * 100 + "a.", "x" * 100 + "b."]
    return [
        (rng.choice([1, 2, 3, None, 2**60 + 1, 2**60 + 3, *range(10, 60)]), rng.choice([None, -3, *range(12)]), rng.choice(roles), rng.choice(texts), 1, "clash", 2)
        for _ in range(n)
    ]


def test_repair_equals_sql_with_nulls_ties_and_repeated_rows(spark, tmp_path):
    rows = conversations(random.Random(7), 700)
    against_sql(spark, tmp_path, repair.op11_conversation_repair, repair.SQL, conversations=(rows, CONVERSATIONS))


def test_repair_of_a_conversation_longer_than_windows_and_batches(spark, tmp_path):
    rng = random.Random(8)
    rows = [(4, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Turn {t}.", f"turn {t}", "Again."]), 0, "", 0) for t in range(3000) if t % 7]
    got = against_sql(spark, tmp_path, repair.op11_conversation_repair, repair.SQL, conversations=(rows, CONVERSATIONS))
    assert len(got) == 1


def test_repair_of_dropped_and_empty_tables(spark, tmp_path):
    import zlib

    turns = [t for t in range(200) if zlib.crc32(f"9:{t}".encode()) % 20 == 0]
    got = against_sql(spark, tmp_path, repair.op11_conversation_repair, repair.SQL, conversations=([(9, t, "user", "Gone.", 0, "", 0) for t in turns], CONVERSATIONS))
    assert [r[1:-1] for r in got] == [(0, 0, 0, 0, 0, 0, "")]
    assert not against_sql(spark, tmp_path / "none", repair.op11_conversation_repair, repair.SQL, conversations=([], CONVERSATIONS))


def test_repaired_turns_are_legal_and_hash_to_the_digest(spark):
    import hashlib

    rows = spark.createDataFrame(conversations(random.Random(9), 400), CONVERSATIONS)
    passing = repair.audited(repair.damaged(rows), Scratch(spark, "repair-test"))
    digests = {r["conv_id"]: r for r in repair.digests(passing).collect()}
    turns = defaultdict(dict)
    for r in repair.repaired_turns(passing).collect():
        turns[r["conv_id"]][r["position"]] = (r["role"], r["text"])
    for conv, r in digests.items():
        said = [turns[conv][i] for i in range(len(turns[conv]))]
        initials = "".join(role[0] for role, _ in said)
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2) and initials != "s"
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest() == r["repaired_sha256"]


# --- stateful deduplication ------------------------------------------------------------------------------------------

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, digest string, file int, n int"


def documents(rng, n):
    texts = ["", None, "a b", "ab", " a\nb ", "a\x1cb", "A b", "città  è", "cittàè", "word " * 300, "many words # here", "AB CD", "l" * 70_000, "l" * 69_999 + " l"]
    langs = ["it", "en", None, ""]
    ids = [None, 2**60 + 1, 2**60 + 3, *range(40)]
    return [(rng.choice(ids), rng.choice([*texts, f"own {i} text"]), rng.choice(langs), "s", 1, "clash", 1, 2) for i in range(n)]


def test_dedup_equals_sql_with_nulls_ties_and_repeated_rows(spark, tmp_path):
    against_sql(spark, tmp_path, streamdedup.op12_streaming_exact_dedup, streamdedup.SQL, documents=(documents(random.Random(1), 300), DOCUMENTS))


def test_dedup_of_an_empty_table(spark, tmp_path):
    assert not against_sql(spark, tmp_path, streamdedup.op12_streaming_exact_dedup, streamdedup.SQL, documents=([], DOCUMENTS))


def told(dedup):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in dedup.result().collect())


def test_different_texts_with_one_digest_are_told_apart_by_their_bytes(spark, tmp_path):
    spark.createDataFrame(documents(random.Random(2), 200), DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    whole = streamdedup.StreamingDedup(spark, f"{tmp_path}/documents.parquet", shared_dir(spark, "dedup-test"))
    short = streamdedup.StreamingDedup(
        spark, f"{tmp_path}/documents.parquet", shared_dir(spark, "dedup-test"), digest=lambda text: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(text.cast("binary")), F.lit(4))), 2, "0"))
    )
    for x in (whole, short):
        x.ingest()
    assert short.state.count() <= 4
    assert short.checked().agg(F.max("contents")).first()[0] > 1
    assert told(whole) == told(short)


def test_dedup_goes_on_where_it_stopped_and_counts_nothing_twice(spark, tmp_path):
    folder, rows = f"{tmp_path}/documents.parquet", documents(random.Random(3), 240)
    base = shared_dir(spark, "dedup-test")
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * (k + 1)], DOCUMENTS).coalesce(1).write.mode("append").parquet(folder)
        dedup = streamdedup.StreamingDedup(spark, folder, base, files_per_batch=1)  # as after a restart: all state is on disk
        dedup.ingest()
        dedup.ingest()
        once = streamdedup.StreamingDedup(spark, folder, shared_dir(spark, "dedup-test"))
        once.ingest()
        assert told(dedup) == told(once) and sum(told(dedup).values()) == 80 * (k + 1)
    assert dedup.state.agg(F.sum("n")).first()[0] == 240


def test_small_state_takes_little_disk(spark, tmp_path):
    """No store sets aside megabytes for its logs and manifests: hundreds of partitions would fill a disk with them."""
    import os
    import threading

    spark.createDataFrame(documents(random.Random(6), 100), DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    local = spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())
    seen, done = {}, threading.Event()

    def watch():
        while not done.wait(0.05):
            for at, _, names in os.walk(local):
                for name in names if "StateStoreId" in at else ():
                    try:
                        seen[f"{at}/{name}"] = max(seen.get(f"{at}/{name}", 0), 512 * os.stat(f"{at}/{name}").st_blocks)
                    except FileNotFoundError:
                        pass

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        streamdedup.StreamingDedup(spark, f"{tmp_path}/documents.parquet", shared_dir(spark, "dedup-test")).ingest()
    finally:
        done.set()
        watcher.join()
    assert any("MANIFEST" in name for name in seen) and max(seen.values()) < 1 << 20


def test_texts_that_changed_since_are_noticed(spark, tmp_path):
    folder = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string").coalesce(1).write.parquet(folder)
    dedup = streamdedup.StreamingDedup(spark, folder, shared_dir(spark, "dedup-test"))
    dedup.ingest()
    spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(folder)
    with pytest.raises(ValueError, match="changed"):
        dedup.result()


# --- filter audit ----------------------------------------------------------------------------------------------------

LABELS = "doc_id long, quality int, toxic int"


def test_audit_equals_sql_with_nulls_ties_and_repeated_rows(spark, tmp_path):
    rng = random.Random(4)
    labels = [(rng.choice([None, 2**60 + 1, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    rows = documents(rng, 300)
    against_sql(spark, tmp_path, filteraudit.op13_filter_interaction_audit, filteraudit.SQL, documents=(rows, DOCUMENTS), labels=(labels, LABELS))


def test_audit_of_empty_tables(spark, tmp_path):
    query, sql = filteraudit.op13_filter_interaction_audit, filteraudit.SQL
    assert not against_sql(spark, tmp_path / "a", query, sql, documents=([], DOCUMENTS), labels=([], LABELS))
    assert len(against_sql(spark, tmp_path / "b", query, sql, documents=(documents(random.Random(0), 5)[:1], DOCUMENTS), labels=([], LABELS))) == 600


@pytest.mark.parametrize("shard_bytes", [1, 3000, 1 << 30])
def test_matrix_holds_every_count_under_one_number_a_word(spark, shard_bytes, monkeypatch):
    monkeypatch.setattr(termmatrix, "PACKED", 7)
    rng = random.Random(shard_bytes)
    vocabulary = [f"w{i}" for i in range(300)] + ["è", "\x1c", "a\x85b"]
    texts = [" \t".join(rng.choices(vocabulary, k=rng.randrange(80))) for _ in range(120)] + ["", None, "\n\n", "w1 " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    shards = termmatrix.local_shards(docs, F.struct("doc_id"), Scratch(spark, "matrix-test"), shard_bytes=shard_bytes)
    words = {}
    for r in termmatrix.dictionary(shards).collect():
        assert words.setdefault(r["id"], bytes(r["word"])) == bytes(r["word"])
    assert len(words) == len(set(words.values()))
    got = {}
    for r in termmatrix.csr_shards(shards).collect():
        indptr, indices, data = np.frombuffer(r["indptr"], "<i8"), np.frombuffer(r["indices"], "<i8"), np.frombuffer(r["data"], "<i4")
        for k, row in enumerate(r["rows"]):
            at = slice(indptr[k], indptr[k + 1])
            got[row["doc_id"]] = Counter({words[i]: n for i, n in zip(indices[at].tolist(), data[at].tolist(), strict=True)})
    assert got == {i: Counter((t or "").encode().split()) for i, t in enumerate(texts)}
    sums = {r["row"]["doc_id"]: (r["total"], r["nonzero"]) for r in termmatrix.row_sums(shards).collect()}
    assert sums == {i: (sum(c.values()), len(c)) for i, c in got.items()}


@pytest.mark.parametrize("kind", ["<i4", "<i8"])
def test_squeezed_numbers_come_back(kind):
    for numbers in ([], [0], [-1, 5, 2**31 - 1], list(range(1000))):
        assert termmatrix.unsqueezed(termmatrix.squeezed(np.array(numbers, kind))).tolist() == numbers
