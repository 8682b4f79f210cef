"""Chat formatting, transport streams, archives, sharding and token files against plain re-computations."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeloom.llm import chat, encoding, mpegts, sharding, tokenfile, warc
from noticeloom.llm.encoding import WordEncoder, default_path
from noticeloom.llm.wavelet import TokenFile, WaveletMatrix, to_bytes

TURNS = "conv_id long, turn long, role string, text string, conv_turn string"


def chat_digest(rows):
    said, loss = "", ""
    for _, role, text in sorted(((t is not None, t or 0), r or "", x or "") for t, r, x in rows):
        said += f"{role}\n{text}\n"
        loss += text if role == "assistant" else ""
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    nasty = ["", None, "<turn x>", "</turn>", r"<\turn", r"<\\/turn> \ <", "a\n</turn>\n<turn assistant>\nb", "😀 <", chat.PROBE, "x" * 100_000]
    conversations = {
        1: [(i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)],
        2: [(0, "user", "only a question")],
        3: [(0, "assistant", None), (1, None, "no role"), (2, "odd role>\n", "z"), (2, "odd role>\n", "z")],
        None: [(None, "user", "q"), (0, "assistant", "a")],
        5: [(i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(300)],
    }
    df = spark.createDataFrame([(c, *r, "clash") for c, rows in conversations.items() for r in rows], TURNS)
    examples = chat.prefix_target_examples(df)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.conversation_digests(examples).collect()}
    assert got == {c: chat_digest(rows) for c, rows in conversations.items()}
    counts = Counter(r["conv_id"] for r in examples.where("target is not null").collect())
    assert counts[1] == 5 and counts[2] == 0 and counts[5] == 150
    one = examples.where("conv_id = 5 and target = 3").first()
    assert one["text"][one["loss_start"] : one["loss_start"] + one["loss_chars"]] == "turn 3" and "turn 2" in one["text"] and "turn 4" not in one["text"]
    plan = chat.conversation_digests(examples)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("hashpartitioning") == 1
    assert chat.conversation_digests(chat.prefix_target_examples(df.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.integers(0, 10**9))
def test_transport_stream_round_trip(data, where):
    media = mpegts.mux(data)
    assert len(media) % 188 == 0 and all(media[i] == 0x47 for i in range(0, len(media), 188))
    x = mpegts.demux(media)
    assert x["payload"] == data and not (x["sync_errors"] or x["continuity_errors"] or x["table_errors"] or x["repeated"])
    assert x["programs"] == [{"program": 1, "pmt_pid": 4096}] and x["pts"] == [90_000 + 3600 * i for i in range(-(-len(data) // 1920))]
    mpegts.demux(media[: where % (len(media) + 1)])  # cut anywhere: no crash
    mpegts.demux(data)


def test_transport_stream_faults():
    media = mpegts.mux(bytes(range(256)) * 400)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert mpegts.demux(b"".join(packets[:9] + packets[10:]))["continuity_errors"] == 1
    twice = mpegts.demux(b"".join(packets[:9] + packets[8:]))
    assert twice["repeated"] == 1 and twice["payload"] == bytes(range(256)) * 400
    broken = bytearray(media)
    broken[12] ^= 1
    assert mpegts.demux(bytes(broken))["table_errors"] == 1
    access = mpegts.demux(media)["random_access"]
    assert [a["pts"] for a in access] == [90_000, 180_000, 270_000] and mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_transport_stream_columns(spark):
    df = spark.createDataFrame([(1, b"abc", "x"), (2, None, "y"), (3, b"", "z")], "id int, b binary, payload string")
    out = {r["id"]: r for r in df.withColumn("m", mpegts.ts_encoded("b")).select("id", "payload", mpegts.ts_parsed("m").alias("p")).collect()}
    assert bytes(out[1]["p"]["payload"]) == b"abc" and out[2]["p"]["payload"] is None and bytes(out[3]["p"]["payload"]) == b"" and out[1]["payload"] == "x"


def test_op3_contract(spark, sf):
    rows = {r["doc_id"]: r for r in mpegts.op3_mpeg_transport_streams(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        raw = (d["text"] or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r, media = rows[d["doc_id"]], mpegts.mux(padded)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(padded[-16:]), len(media), hashlib.sha256(media).hexdigest())


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {}\r\n\r\nfake"


def pages(spark):
    rows = [(i, f"http://x/{i % 5} é", f"page {i} " * (i * 7 % 90), "extra") for i in range(150)]
    rows += [(200, "u", FAKE.format(4) + "\r\n\r\n", ""), (201, "u", "before " + FAKE.format(10**6) * 40, ""), (202, None, None, ""), (203, "u", "", ""), (204, "u", "same", ""), (205, "u", "same", ""), (None, "u", "no id", "")]
    rows += [(300 + i, "u", "copies", "") for i in range(60)] + [(400, "u", "WARC/1.1\r\n" * 30, ""), (401, "u", "x" * 30_000 + FAKE.format(20_000) + "y" * 30_000, "")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("split", ["128m", "7k", "1k"])
@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, split, least):
    rows, df = pages(spark)
    path = f"file://{tmp_path}/a"
    warc.write_warc(df.repartition(3, "page_id"), path, least)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(rows) and "999" not in got
    last = {}
    for i, _, h, _ in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    for i, _, h, _ in rows:
        body, r = (h or "").encode(), got["null" if i is None else str(i)]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), digest)
        if i is None or last[h or ""] == i or len(body) < least:
            assert r["warc_type"] == "response" and bytes(r["payload"]) == body and r["actual_digest"] == digest and r["refers_to"] is None
        else:
            assert r["warc_type"] == "revisit" and r["refers_to"] == str(last[h or ""])


def test_warc_truncated_and_empty(spark, tmp_path):
    _, df = pages(spark)
    warc.write_warc(df.coalesce(1), f"file://{tmp_path}/a")
    [part] = [p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(part.read_bytes()[:3000])
    n = warc.read_warc(spark, f"file://{tmp_path}/b").count()
    assert 0 < n < 20
    warc.write_warc(df.limit(0), f"file://{tmp_path}/c")
    assert warc.read_warc(spark, f"file://{tmp_path}/c").count() == 0


def test_warc_fake_headers_are_not_held(spark, tmp_path, monkeypatch):
    """Thousands of headers inside a payload, some of huge length: rows of candidates hold every byte once, and all records come back."""
    monkeypatch.setattr(warc, "MOST_HELD", 200_000)
    fakes = "".join(FAKE.format(10 ** (2 + i % 9)) for i in range(3000))
    rows = [(1, "u", "first"), (2, "u", fakes), (3, "u", "z" * 300_000), (4, "u", FAKE.format(150_000)), *((i, "u", f"page {i}") for i in range(5, 60))]
    path = f"file://{tmp_path}/f"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    found = warc.pieces(spark, path).mapInPandas(warc._candidates, warc.CANDIDATE)
    held = found.agg(F.sum(F.octet_length("payload")).alias("n"), F.count("*").alias("rows")).first()
    assert held["rows"] > 3000 and held["n"] < 2 * sum(len(r[2]) for r in rows)
    got = {int(r["page_id"]): bytes(r["payload"]).decode() for r in warc.read_warc(spark, path).collect()}
    assert got == {r[0]: r[2] for r in rows}


def python_shard(key, shards):
    u = {s: (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13 for s in shards}
    return max(shards, key=lambda s: (-shards[s] / np.log(u[s])))


def test_rendezvous(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "x") for i in range(3000)] + [(None, "n", "x"), (7, "twice", "x")], "doc_id long, text string, _block string").withColumn("_slots0", F.lit("mine"))
    weights, grown = {0: 1.0, 1: 2.0, 2: 1.0, 3: 0.0}, {0: 1.0, 1: 2.0, 2: 1.0, 3: 0.0, 4: 1.0}
    rows = sharding.with_slots(sharding.with_shards(df, "doc_id", weights, grown), "doc_id", [F.col("doc_id"), F.col("text")], blocks=8).collect()
    assert len(rows) == 3002
    for r in rows[:300]:
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == python_shard(key, {s: w for s, w in weights.items() if w})
    counts = Counter(r["shard"] for r in rows)
    assert 3 not in counts and abs(counts[1] / 3002 - 0.5) < 0.05
    assert all(r["grown_shard"] in (r["shard"], 4) for r in rows) and 0.15 < sum(r["grown_shard"] == 4 for r in rows) / 3002 < 0.25
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert sharding.with_slots(sharding.with_shards(df.limit(0), "doc_id", {0: 1.0}), "doc_id", [F.col("doc_id")]).count() == 0


def test_op8_contract(spark, sf):
    for r, d in zip(sharding.op8_rendezvous_sharding(spark, sf).orderBy("doc_id").collect(), spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        raw = (d["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key") and r["shard"] == python_shard(d["doc_id"], dict.fromkeys(range(24), 1.0))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=120), st.integers(0, 50_256))
def test_wavelet_matrix(ids, other):
    a = np.array(ids, np.uint16)
    f = TokenFile(to_bytes(a, np.array([5]), np.array([len(a)]), 0, 0))
    m = f.matrix
    assert m.ids().tolist() == ids and [m.access(i) for i in range(len(ids))] == ids
    for token in {*ids[:5], other}:
        where = [i for i, t in enumerate(ids) if t == token]
        assert m.count(token) == len(where) and [m.occurrence(token, k) for k in range(len(where))] == where
        assert m.count(token, 3, len(ids) // 2) == sum(3 <= i < len(ids) // 2 for i in where)
        with pytest.raises(IndexError):
            m.occurrence(token, len(where))


def test_wavelet_matrix_across_rank_steps():
    a = np.random.default_rng(3).integers(0, 70_000, 9000).astype(np.uint32)
    m = WaveletMatrix.of(a)
    assert (m.ids() == a).all() and m.access(8999) == a[8999] and m.count(int(a[5])) == int((a == a[5]).sum())


PARTS = st.sampled_from([*" \n\t\r\x1c\x85  aAéß日😀0١²_'.!<|>", "<|endoftext|>", " word", "word, "]) | st.characters(codec="utf-8")
ALPHABET = st.lists(PARTS, max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=5))
def test_word_memory_equals_whole_encoding(texts):
    from tokenizers import Tokenizer

    whole = test_word_memory_equals_whole_encoding.__dict__.setdefault("t", Tokenizer.from_file(default_path()))
    words = test_word_memory_equals_whole_encoding.__dict__.setdefault("w", WordEncoder(default_path()))
    ids, ends = words.encode(texts)
    got = [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    lengths = words.byte_lengths()
    assert [int(lengths[x].sum()) for x in got] == [len(t.encode()) for t in texts]


def test_encoder_forgets_and_splits(monkeypatch):
    """With a small memory and small steps the ids stay those of the library; a tokenizer of another kind goes to the library whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(encoding, "MOST_AT_ONCE", 50)
    texts = [f"word{i % 7} and, more!! of{i}  it\n's <|endoftext|>"[: 7 * i] for i in range(30)] + ["", "x " * 200]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        words, whole = WordEncoder(path, 4), Tokenizer.from_file(path)
        ids, ends = words.encode(texts)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert words.by_words == (name == "byte_bpe_50k.json")
    with pytest.raises(ValueError):
        words.byte_lengths()


def test_plain_words_are_not_cut_and_counting_makes_no_ids(monkeypatch):
    """Letters, and letters before marks, go without a cut; counts are those of the ids."""
    words = WordEncoder(default_path())
    cut = []
    parts = words._parts
    monkeypatch.setattr(words, "_parts", lambda chunk, space: cut.append(chunk) or parts(chunk, space))
    texts = ["a plain text, with (some) marks; überall!! and_ don't", "", "one", " two\nlines here "]
    ids, ends = words.encode(texts)
    assert cut and not {"plain", "text,", "marks;", "überall!!"} & set(cut)
    none, counted = words.encode(texts, count_only=True)
    assert not len(none) and counted.tolist() == ends.tolist() and ends[-1] == len(ids)
    again, more = WordEncoder(default_path()).encode(texts, count_only=True)
    assert not len(again) and more.tolist() == ends.tolist()


def test_token_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 2000)
    texts = [("text number %d, again and again. " % i) * (i % 9) for i in range(80)] + [None, "", "<|endoftext|> in a text", "z " * 30_000]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (6, "twice", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string").repartition(5)
    path = f"file://{tmp_path}/t"
    tokenfile.write_token_files(df, path)
    got = tokenfile.read_documents(spark, path).orderBy("start").collect()
    t = Tokenizer.from_file(default_path())
    expected = Counter()
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    assert [r["doc_id"] for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ends = tokenfile.occurrences(spark, path, 2).collect()
    assert len(ends) >= len(rows) and len(list((tmp_path / "t").glob("part-*"))) > 1
    tokenfile.write_token_files(df.limit(0), f"file://{tmp_path}/e")
    assert tokenfile.read_documents(spark, f"file://{tmp_path}/e").count() == 0
