"""Language, attribution, decontamination, the join, packing and the pipeline against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeloom.llm import attribution, common, components, decontam, langid, nearjoin, packing, shingles
from noticeloom.llm.encoding import WordEncoder, default_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# --- language ------------------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = langid.op4_language_id(spark, sf).join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == truth.count() and len(held) > 200 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97


def test_language_edges(spark):
    letters = {"en": "the house with a view", "de": "das haus mit aussicht über", "fr": "la maison avec une vue où", "xx": "zzq qzz zqz"}
    rows = [(i, letters[lang] * (1 + i % 3), lang, "s", 1) for i, lang in enumerate(list(letters) * 30)]
    rows += [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "123 !?", "de", "s", 0), (None, "the house", "en", "s", 0), (1003, "das haus " * 50_000, None, "s", 0)]
    df = spark.createDataFrame(rows, DOC).withColumn("lang_pred", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(df, langid.fit(df)).collect()}
    assert got[1000] == got[1001] == got[1002] == ("und", 0.0) and got[1003][0] == "de" and got[None][0] == "en"
    assert all(got[i][0] == lang for i, _, lang, _, _ in rows[:120])
    assert langid.fit(df.limit(0)) is None and {r["lang_pred"] for r in langid.identified(df.limit(3), None).collect()} == {"und"}
    one = df.where("lang = 'en'")
    assert {r["lang_pred"] for r in langid.identified(one.where("text is not null"), langid.fit(one)).collect()} == {"en"}


def test_unrecognised_texts_go_and_clean_ones_stay(spark):
    import corpus_pipeline

    rnd = random.Random(5)
    junk = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(500)) for _ in range(40)]
    junk += [" ".join("".join(rnd.choice("абвгдежзиклмнопрст") for _ in range(rnd.randint(2, 9))) for _ in range(60)) for _ in range(40)]
    given_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in given_.collect()] + [(100_000 + i, t, None, "s", len(t)) for i, t in enumerate(junk)]
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, given_.schema), "").collect()}
    held = {r["doc_id"] for r in given_.where(langid.held_out_column()).collect()}
    assert sum(i in kept for i in held) >= 0.995 * len(held) and sum(i in kept for i in (r[0] for r in rows[:-80])) >= 0.995 * (len(rows) - 80)
    assert sum(100_000 + i not in kept for i in range(80)) > 75
    short = [r for r in rows[:-80] if r[1] and len(r[1]) < 60]
    assert short and sum(r[0] in kept for r in short) >= 0.98 * len(short)
    least = langid.least_margins(given_, langid.fit(given_))
    assert min(least.values()) > 0 and least[128] > least[8] and set(langid.least_margins(given_, None).values()) == {0.0}


# --- attribution ---------------------------------------------------------------------------------------------------


def spans_by_hand(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    out, raw, at = [], text.encode(), 0
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    sizes = WordEncoder(default_path()).byte_lengths()
    for i in t.encode(text, add_special_tokens=False).ids:
        out.append((owner[at], owner[at + int(sizes[i]) - 1] + 1))
        at += int(sizes[i])
    assert at == len(raw)
    return out


TEXTS = ["", "one <|endoftext|> line", "two\nlines\n", "\n\n", "Città è bella\nperché 日本語 😀😀\nfine", "x" * 5000, "a  b\n  c\n\n\n d"]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_by_brute_force(spark, rule):
    sections = [[(0, 3), (3, 7), (9, 400)], [(2, 5), (4, 6)], [(5, 2), (1, 1)], None, [(3, 100), (0, 3)], [(1000, 4000)], []]
    rows = [(i, t, [{"start": a, "end": b} for a, b in s] if s is not None else None) for i, (t, s) in enumerate(zip(TEXTS, sections, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<start:int,end:int>>")
    got = defaultdict(dict)
    for r in attribution.attributed(df, rule).collect():
        got[r["doc_id"]][r["section"]] = r["n_tokens"]
    for i, (text, given_) in enumerate(zip(TEXTS, sections, strict=True)):
        owner = [-1] * len(text)
        order = sorted(range(len(given_ or [])), key=lambda k: (min(max(given_[k][0], 0), len(text)), k))
        for k in order:
            a, b = given_[k]
            for c in range(max(a, 0), min(b, len(text))):
                if owner[c] < 0 and all(c >= max(given_[j][1], 0) or c < given_[j][0] for j in order[: order.index(k)]):
                    owner[c] = k
        expected = Counter()
        for a, b in spans_by_hand(text):
            held = Counter(owner[a:b])
            if rule == "proportional":
                for s, n in held.items():
                    expected[s] += n / (b - a)
            elif rule == "first":
                expected[next((s for s in owner[a:b] if s >= 0), -1)] += 1
            else:
                inside = {s: n for s, n in held.items() if s >= 0}
                best = min(inside, key=lambda s: (-inside[s], owner[a:b].index(s))) if inside else -1
                expected[best if inside and held.get(-1, 0) <= inside[best] else -1] += 1
        for s in {*expected, *got[i]}:
            assert abs(got[i].get(s, 0.0) - expected.get(s, 0)) < 1e-9, (i, s)


def test_attribution_to_lines(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])] + [(None, "a\nb", "x")], "doc_id long, text string, n_tokens string")
    rows = attribution.attributed(df).collect()
    for i, t in enumerate([*TEXTS, None]):
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in mine) == len(spans_by_hand(t or ""))
        assert [r["section"] for r in mine] == list(range(len(mine))) and mine[-1]["end"] == len(t or "") and (t or "").count("\n") + 1 - ((t or "").endswith("\n")) == len(mine)
    assert sum(r["doc_id"] is None for r in rows) == 2 and attribution.attributed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        attribution.attributed(df, "other")


# --- decontamination -----------------------------------------------------------------------------------------------


def edit_search(pattern, text):
    """Best distance of the pattern to any stretch, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("ab ", min_size=1, max_size=12), st.text("ab ", max_size=30))
def test_myers_equals_table(pattern, text):
    scores = decontam.myers(pattern, text)
    assert min(scores, default=len(pattern)) == (edit_search(pattern, text) if text else len(pattern)) or edit_search(pattern, text) == len(pattern)
    k = len(pattern)
    found = decontam.best_match(pattern, text, k)
    if found:
        d, a, b = found
        assert d == edit_search(pattern, text) and edit_search(pattern, text[a:b]) <= d


def test_contamination_by_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 30)))) for i in range(12)] + [(100, None), (101, ""), (102, "tiny"), (None, "skipped " * 9)]

    def edited(t, n):
        for _ in range(n):
            i = rnd.randrange(len(t))
            t = rnd.choice((t[:i] + t[i + 1 :], t[:i] + "z" + t[i:], t[:i] + "q" + t[i + 1 :]))
        return t

    docs = []
    for i in range(60):
        body = [word() for _ in range(60)]
        if i % 3:
            _, item = items[i % 12]
            body[20:20] = edited(item, rnd.randint(0, int(len(item) * 0.1))).upper().replace(" ", "\n " if i % 2 else " ").split(" ")
        docs.append((i, " ".join(body), "x"))
    docs += [(60, None, "x"), (61, "", "x"), (62, "w " * 100_000 + items[3][1], "x"), (63, items[5][1], "x"), (63, items[5][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, distance string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contamination(df, bench).collect())
    expected = []
    for i, t, _ in docs:
        n = decontam.normal(t)
        for k, item in items:
            p = decontam.normal(item)
            if p and k is not None and n and (p in n or len(n) < 5000 and edit_search(p, n) <= int(len(p) * decontam.RATE)):
                expected.append((i, k, 0 if p in n else edit_search(p, n)))
    assert got == sorted(expected) and len(got) > 25
    spans = {(r["doc_id"], r["item_id"]): r for r in decontam.contamination(df, bench).collect()}
    text = dict((i, t) for i, t, _ in docs)
    for (i, k), r in spans.items():
        assert edit_search(decontam.normal(dict(items)[k]), decontam.normal(text[i][r["match_start"] : r["match_end"]])) <= r["budget"]
    clean = decontam.decontaminated(df, bench)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _, _ in docs} - {i for i, _, _ in got}
    assert decontam.contamination(df, bench.limit(0)).count() == 0 and decontam.contamination(df.limit(0), bench).count() == 0
    assert [len(b) for b in decontam.item_blocks(bench, 400)][0] < 13  # several blocks


def test_items_without_an_id_and_with_the_same_id(spark):
    items = [(None, "an item whose row names no id at all"), (None, "another one that has no id either"), (2**60 + 1, "one of two texts that share an id"), (2**60 + 1, "the second text beneath one id")]
    docs = [(i, f"before {t} after") for i, (_, t) in enumerate(items)] + [(9, "nothing of the kind")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, items[0], (None, None), (None, "")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contamination(df, bench).collect()) == [(0, None), (1, None), (2, 2**60 + 1), (3, 2**60 + 1)]
    assert [r["doc_id"] for r in decontam.decontaminated(df, bench).collect()] == [9]


# --- the join ------------------------------------------------------------------------------------------------------


def brute_join(rows):
    sets, classes = {}, defaultdict(list)
    for i, t in rows:
        w = shingles.words_of(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        classes[tuple(w) if w else i].append(i)
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared / (len(sets[a]) + len(sets[b]) - shared) >= 0.8 - 1e-12:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rep = {i: min(c) for c in classes.values() for i in c}
    return {i: (find(i), links[i], rep[i]) for i in sets}


def near_corpus():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    line = " ".join(rnd.choice(words) for _ in range(60))
    rows = []
    for base in range(12):
        body = [rnd.choice(words) for _ in range(rnd.randint(80, 160))]
        for copy in range(rnd.choice((1, 2, 5, 40))):
            changed = list(body)
            for _ in range(copy % 4):
                changed[rnd.randrange(len(changed))] = rnd.choice(words)
            rows.append(" ".join(changed) + (" " + line if base % 4 == 0 else ""))
    rows += ["Short text", "short   TEXT!", "one", "", None, "", "...", "a b c d e", "a b c d e f", rows[0], rows[0], "w " * 20_000, "w " * 20_001]
    return list(enumerate(rows))


def test_join_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "VERIFY", 16)
    monkeypatch.setattr(nearjoin, "BLOCK", 16)
    rows = near_corpus()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, key string, id string")
    got = {r["doc_id"]: tuple(r)[1:] for r in nearjoin.ngram_jaccard_join(df).collect()}
    assert got == brute_join(rows)


def test_join_edges(spark):
    df = spark.createDataFrame([(None, "the same five words here"), (1, "the same five words here"), (1, "the same five words here"), (2, "Other words, entirely so different")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in nearjoin.ngram_jaccard_join(df).collect())
    assert got[-1] == (2, 2, 0) and got[1:3] == [(1, 1, 1), (1, 1, 1)] and len(got) == 4
    kept = nearjoin.one_of_each_group(df.withColumn("_place", F.lit(1)))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2] and kept.columns == ["doc_id", "text", "_place"]
    assert nearjoin.ngram_jaccard_join(df.limit(0)).count() == 0 and nearjoin.one_of_each_group(df.limit(0)).count() == 0


def test_join_with_ids_that_repeat_with_different_texts(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    one, two, other = (" ".join(rnd.choice(words) for _ in range(120)) for _ in range(3))
    for a, b in ((one, two), (two, one)):
        rows = [(1, a), (1, b), (50, b), (51, b), (52, b + " tail"), (53, a + " tail"), (2, other)]
        got = sorted(tuple(r) for r in nearjoin.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == [(1, 1, 1, 1), (1, 1, 3, 1), (2, 2, 0, 2), (50, 1, 3, 1), (51, 1, 3, 1), (52, 1, 3, 52), (53, 1, 1, 53)]
        kept = nearjoin.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(map(tuple, kept.collect())) == sorted([(1, a), (1, b), (2, other)])


def test_rows_of_a_repeated_id_go_by_their_own_text(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    one, clean, third = (" ".join(rnd.choice(words) for _ in range(120)) for _ in range(3))
    rows = [(1, one), (5, one.upper()), (5, clean), (5, "..."), (5, "..."), (7, third), (7, third + " tail"), (7, third), (None, one), (None, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_group", F.lit(1))
    kept = nearjoin.one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect())) == sorted([(0, one), (0, one), (1, one), (5, "..."), (5, clean), (7, third)])


def test_depths_reach_the_target():
    free = nearjoin.shortened({}, 0.8, 0.998)
    assert nearjoin.recall(free, 0.8) >= 0.998 and min(free) >= nearjoin.LEAST_DEPTH
    crowded = {(t, d): (1e9 if t < 8 and d < 7 else 0.0) for t in range(nearjoin.TREES) for d in range(3, 9)}
    depths = nearjoin.shortened(crowded, 0.8, 0.99)
    assert min(depths[:8]) > min(depths[8:])  # crowded tries keep longer prefixes


def test_components_by_brute_force(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2001 + i) for i in range(90)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t"), "t").collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in alone}
    assert components.components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark, "t"), "t").count() == 0


def test_shared_counts():
    rnd = np.random.default_rng(0)
    left, right = ([np.unique(rnd.integers(0, 500, 120).astype(np.uint64)) for _ in range(n)] for n in (9, 7))
    expected = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert shingles.shared_counts(left, right, columns=64).tolist() == expected == shingles.shared_counts(left, right).tolist()


# --- packing -------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_best_fit_is_valid_and_no_worse_than_single_lengths(sizes):
    lengths = (8, 16, 32, 64)
    s = np.array(sorted(sizes, reverse=True))
    where, used, final = packing.best_fit(s, lengths)
    held = Counter()
    for b, x in zip(where.tolist(), s.tolist(), strict=True):
        held[b] += x
    assert [held[b] for b in range(len(used))] == used
    assert all(u <= f and f == min(x for x in lengths if x >= u) for u, f in zip(used, final, strict=True))  # downsized to the contents

    def plain(opening):
        """Best fit by looking at every bin."""
        bins = []
        for x in s.tolist():
            fits = [b for b in bins if b[0] >= x]
            if fits:
                b = min(fits, key=lambda b: b[0])
            else:
                b = [max(opening, min(y for y in lengths if y >= x)), 0]
                bins.append(b)
            b[0] -= x
            b[1] += x
        return sum(packing.cost(min(y for y in lengths if y >= b[1])) for b in bins)

    assert sum(map(packing.cost, final)) <= min(plain(x) for x in lengths) + 1e-6


def test_packing_keeps_everything(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([0, 1, 100, 3000, 16384, 16385, 70_000]), "x") for i in range(3000)] + [(5000, None, "x"), (None, 10, "x"), (7, 100, "x"), (7, 100, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n long, bin_id string")
    out = packing.packed(df, F.col("n"), group=256).collect()
    total, pieces, bins = Counter(), defaultdict(list), defaultdict(list)
    for r in out:
        total[r["doc_id"]] += r["length"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        if r["bin_id"]:
            bins[r["bin_id"]].append(r)
    expected = Counter()
    for i, n, _ in rows:
        expected[i] += n or 0
    assert {i: total[i] for i in expected} == dict(expected)
    for rs in bins.values():
        assert sum(r["length"] for r in rs) == rs[0]["bin_used"] <= rs[0]["bin_length"] and rs[0]["bin_length"] in packing.LENGTHS
        assert sorted(r["position"] for r in rs) == list(range(len(rs)))
    for i, p in pieces.items():
        if i != 7:
            p.sort()
            assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False))
    filled = sum(r["length"] for r in out) / sum(rs[0]["bin_length"] for rs in bins.values())
    assert filled > 0.97
    assert packing.packed(df.limit(0), F.col("n")).count() == 0
    again = packing.packed(df.repartition(7), F.col("n"), group=256).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))  # the same whatever the partitions


def test_packed_sequences_hold_every_token(spark):
    from tokenizers import Tokenizer

    texts = ["one two three four " * n for n in (0, 1, 3, 10, 10, 40, 90)] + [None, "città è bella <|endoftext|> " * 30]
    rows = [(i if i != 4 else 3, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    whole = Tokenizer.from_file(default_path())
    expected = Counter()
    for i, t, _ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        for k in range(0, len(ids), 64):
            expected[i, k // 64, k, tuple(ids[k : k + 64])] += 1
    got, fills = Counter(), []
    for r in packing.packed_sequences(df, lengths=(16, 32, 64), group=8, pad=-1).collect():
        at = 0
        assert len(r["ids"]) == r["bin_length"] and [x["position"] for x in r["spans"]] == list(range(len(r["spans"])))
        for x in r["spans"]:
            got[x["doc_id"], x["piece"], x["start"], tuple(r["ids"][at : at + x["length"]])] += 1
            at += x["length"]
        assert set(r["ids"][at:]) <= {-1} and r["bin_length"] == min(n for n in (16, 32, 64) if n >= at)
        fills.append(at / r["bin_length"])
    assert got == expected and packing.packed_sequences(df.limit(0)).count() == 0


def test_packing_by_every_packing_of_small_cases():
    """Best fit never costs less than the cheapest of all packings, and seldom more than a fifth above it."""
    lengths, rnd, over = (4, 8, 16), random.Random(3), []

    def cheapest(sizes):
        def go(rest, bins):
            if not rest:
                return sum(packing.cost(min(x for x in lengths if x >= b)) for b in bins)
            tried, best = set(), float("inf")
            for k, b in enumerate(bins):
                if b + rest[0] <= max(lengths) and b not in tried:
                    tried.add(b)
                    best = min(best, go(rest[1:], (*bins[:k], b + rest[0], *bins[k + 1 :])))
            return min(best, go(rest[1:], (*bins, rest[0])))

        return go(tuple(sizes), ())

    for _ in range(40):
        sizes = np.array(sorted((rnd.randint(1, 16) for _ in range(rnd.randint(1, 7))), reverse=True))
        least, got = cheapest(sizes.tolist()), sum(map(packing.cost, packing.best_fit(sizes, lengths)[2]))
        assert got >= least - 1e-9
        over.append(got / least)
    assert sum(over) / len(over) < 1.02 and max(over) < 1.5


def test_negative_lengths_take_no_place(spark):
    out = packing.packed(spark.createDataFrame([(1, -5), (2, 3)], "doc_id long, n long"), F.col("n")).collect()
    assert sorted((r["doc_id"], r["length"], r["bin_id"] is None) for r in out) == [(1, 0, True), (2, 3, False)]


def test_packing_deals_equal_rows_into_many_groups(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit(500).alias("n"))
    out = packing.packed(df, F.col("n"), group=256).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in df.collect()) and {r["length"] for r in out} == {500}
    assert max(Counter(r["bin_id"].split("-")[0] for r in out).values()) < 2 * 256


def test_decontamination_in_blocks(spark, monkeypatch):
    """Three blocks give what one gives."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(30))) for i in range(9)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(40)) + (" " + items[i % 9][1] if i % 2 else ""), "x") for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    one, kept = sorted(map(tuple, decontam.contamination(d, b).collect())), sorted(r["doc_id"] for r in decontam.decontaminated(d, b).collect())
    blocks = list(decontam.item_blocks(b, 600))
    assert len(blocks) >= 3
    monkeypatch.setattr(decontam, "item_blocks", lambda benchmark: iter(blocks))
    assert sorted(map(tuple, decontam.contamination(d, b).collect())) == one and len(one) == 30
    assert sorted(r["doc_id"] for r in decontam.decontaminated(d, b).collect()) == kept == [i for i in range(60) if i % 2 == 0]


def test_language_sample_is_bounded_where_an_id_repeats(spark):
    """A hot id, and equal rows, don't bring more rows to the driver than the bound."""
    many = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"), F.lit("en").alias("lang"))
    rows, each = langid._sample(many, 50, 100)
    assert each == 50 and 10 <= rows.count() <= 130
    vectors = langid.Featurizer()
    assert vectors.vector("\U00030000\U00031350") is not None and vectors.vector("123") is None


def labelled(n: int):
    rnd = random.Random(8)
    said = {"en": "the house with view and garden".split(), "de": "das haus mit aussicht über wald".split(), "fr": "la maison avec une vue où".split(), "es": "la casa con el año y niño".split()}
    langs = [rnd.choice(list(said)) for _ in range(n)]
    langs[5] = langs[6] = langs[7] = "ga"  # a rare one
    said["ga"] = "teach agus radharc álainn".split()
    return [(i, " ".join("".join(rnd.sample(w, len(w)) if rnd.random() < 0.3 else w) for w in rnd.choices(said[lang], k=rnd.randint(1, 12))), lang, "s", 1) for i, lang in enumerate(langs)]


def test_bounds_of_recognition_count_every_held_out_row(spark):
    """More rows than a sample would have: the same bounds as by going through all of them."""
    df = spark.createDataFrame(labelled(12_000), DOC)
    model, held = langid.fit(df), df.where(langid.held_out_column()).collect()
    assert len(held) > 3500
    featurizer, margins = langid.Featurizer(), defaultdict(list)
    for r in held:
        for n in langid.LETTERS:
            if cut := langid.first_letters(r["text"], n):
                [name], [margin] = langid.margins(model, np.array([featurizer.vector(cut)]))
                if name == r["lang"]:
                    margins[n].append(round(float(margin), 4))
    expected, last = {}, 0.0
    for n in langid.LETTERS:
        last = expected[n] = langid.SHARE * float(np.quantile(margins[n], langid.MISSED)) if margins[n] else last
    assert langid.least_margins(df, model) == pytest.approx(expected, abs=1e-4)


def test_whole_model_counts_every_row(spark):
    """Each different row is in a cell, rare languages are in each, and a pair's machine is the mean of those of the cells."""
    rows = labelled(12_000)
    df = spark.createDataFrame(rows + [rows[0]] * 50 + [(20_000, None, "en", "s", 1), (20_001, "12", "en", "s", 1), (20_002, "text", None, "s", 1)], DOC)
    usable = df.where(~langid.held_out_column() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    dealt, cells = langid._dealt(usable)
    got, different = dealt.drop("vector").collect(), usable.where("doc_id < 20000").select(F.xxhash64("doc_id", "text").alias("place"), "lang").distinct().collect()
    assert cells > 5 and {(r["place"], r["lang"]) for r in got} == set(map(tuple, different))
    assert len(got) < len(different) + cells * 3 + 50 and max(Counter(r["cell"] for r in got).values()) < 1.3 * langid.CELL
    assert {r["cell"] for r in got if r["lang"] == "ga"} == set(range(cells)) or not [r for r in different if r["lang"] == "ga"]
    featurizer, text = langid.Featurizer(), {}
    for r in usable.select(F.xxhash64("doc_id", "text").alias("place"), "text").collect():
        text[r["place"]] = r["text"]
    sums = []
    for cell in range(cells):
        of = sorted({(r["place"], r["lang"]) for r in got if r["cell"] == cell})
        x = np.array([featurizer.vector(text[place]) for place, _ in of]).astype(np.float16).astype(np.float32)
        sums.append(langid.fitted(x, np.array([lang for _, lang in of], object)))
    model = langid.fit_whole(df)
    assert model["families"]["names"] == sums[0]["families"]["names"] and model["languages"].keys() == sums[0]["languages"].keys()
    for step, steps in [(model["families"], [m["families"] for m in sums]), *((model["languages"][f], [m["languages"][f] for m in sums]) for f in model["languages"])]:
        assert step["names"] == steps[0]["names"] and np.allclose(step["weights"], np.mean([m["weights"] for m in steps], axis=0), atol=1e-3)
    assert langid.fit_whole(df.limit(0)) is None and langid.fit_whole(df.where("doc_id = 20001")) is None
    assert langid.fit_whole(df.where("lang = 'en'"))["languages"]["germanic"]["names"] == ["en"]


def test_machines_by_rows_are_those_by_weights():
    """With fewer rows than weights the steps go by the rows' factors; further rows without weight make them go the other way."""
    rnd = np.random.default_rng(3)
    x = np.abs(rnd.standard_normal((60, 90))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] > x[:, 1], 1.0, -1.0).astype(np.float32)
    few, many = langid.trained_svm(x, y), langid.trained_svm(np.tile(x, (2, 1)), np.tile(y, 2))
    assert len(few) == 91 and np.allclose(few, many, atol=1e-2 * np.abs(many).max())


# --- the pipeline --------------------------------------------------------------------------------------------------


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    [item] = [r["text"] for r in bench.where("item_id = 3").collect()]
    base = rows[0][1]
    rows += [(9001, "1234 !!", "en", "s", 7), (9002, None, "en", "s", 0), (9003, base, "en", "s", 1), (9004, base + " tail", "en", "s", 1), (9005, "A clean start. " + item + " And an end.", None, None, None), (9006, "", None, "s", 0)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    alive = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = brute_join([(r[0], r[1]) for r in alive])
    alive = [r for r in alive if groups[r[0]][0] == r[0]]
    items = [(r["item_id"], decontam.normal(r["text"])) for r in bench.collect()]
    matcher = decontam.Matcher(items, decontam.RATE)
    expected = {r[0] for r in alive if not matcher.find(decontam.normal(r[1]))}
    assert {r["doc_id"] for r in out} == expected and not {9001, 9002, 9003, 9005, 9006} & expected
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_path())
    size = {r[0]: len(whole.encode(r[1], add_special_tokens=False).ids) for r in rows if r[1]}
    kept = Counter()
    for r in out:
        kept[r["doc_id"]] += r["length"]
    assert dict(kept) == {i: size[i] for i in expected}
    empty = tmp_path / "empty"
    spark.createDataFrame([], DOC).write.parquet(str(empty / "documents.parquet"))
    bench.write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_written_tables_go_to_the_shared_folder(spark):
    path = common.shared_dir(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
