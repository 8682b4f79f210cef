"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

1. Documents with the same words are one class; a 64-bit hash of the words' key names it from here on, and only the result
   maps it to its least ``doc_id``. Ids that repeat with different texts so lose no class.
2. Each class gets a MinHash signature over its word shingles. The signature is cut into trees of ``DEPTH`` values: a
   tree is a prefix trie, kept as rows sorted by signature, and a node is a prefix that several classes share.
3. Matching starts from whole labels in every tree and shortens prefixes, one tree by one level at a time: always where
   the count of further candidate pairs, taken from the sorted tries, is least for the recall gained. It ends when a
   pair of exactly the threshold is found with the target probability; more similar pairs are found more often.
4. Nodes of several classes give candidates. Signatures, a byte a value, leave out pairs far below the threshold. Small
   nodes, mostly the same in many trees, give their few pairs once; in large nodes the rest only has to connect: a block
   asks about what isn't connected yet and emits a spanning forest, never all its pairs.
5. Inside each connected group of candidates *all* pairs are verified exactly, in blocks of classes against blocks. Links
   are counted in the task and never emitted. The text of a class travels and is cut into shingles once for each block of
   ``VERIFY`` classes that its group has, so once in all but very large groups.

The join returns a row for each document: ``class_id`` (the least id of the documents that links connect with it),
``n_links`` (documents other than this one with a similarity of at least the threshold, copies included) and ``words_id``
(the least id of those with the same words).

Defined results: null and empty texts, and texts without a word, link to nothing and are each a class of their own;
texts of fewer words than a shingle are one shingle; rows that repeat a ``doc_id`` are documents of their own, each with
its own text; a null ``doc_id`` takes part in nothing, and comes back with what its words' class has, or null and no links;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import Scratch, few, in_pandas, sieved, slices, table, written
from noticeloom.llm.components import components
from noticeloom.llm.shingles import MinHasher, Shingler, shared_counts, spanning, text_key, words_of

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH, LEAST_DEPTH, TARGET = 16, 8, 3, 0.998
#: Pairs whose signatures agree less than so many standard deviations below the threshold aren't candidates.
DEVIATIONS = 5
#: Classes in a block of candidates, and classes and shingles in a block of exact verification.
BLOCK, VERIFY, VERIFY_SHINGLES = 4096, 2048, 2_000_000
#: A table of counts of groups is broadcast up to so many rows.
MOST_BROADCAST = 500_000
#: Nodes of so many classes at most give their pairs as rows, at most 28 a node; larger ones are worked on in blocks.
SMALL = 8

SIGNED = "doc_id long, text_hash long, key binary, n int, sig binary"


def _signer(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, hasher = Shingler(width), MinHasher(TREES * DEPTH)
        for batch in slices(batches):
            keys, sizes, sigs = [], [], []
            for text in batch["text"]:
                words = words_of(text)
                keys.append(text_key(words) if words else None)
                shingles = shingler.shingles(words)
                sizes.append(len(shingles))
                sigs.append(hasher.signature(shingles).astype(">u4").tobytes() if words else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "key": keys, "n": sizes, "sig": sigs})

    return run


def _trie_costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs in the nodes of sorted labels, by tree and depth. A partition holds whole subtrees of LEAST_DEPTH."""
    pairs = np.zeros((TREES, DEPTH + 1), np.float64)
    runs, last_tree, last = np.ones(DEPTH + 1, np.int64), None, None
    for batch in batches:
        for tree, label in zip(batch["tree"].to_numpy(), batch["label"], strict=True):
            common = 0
            if tree == last_tree:
                while common < DEPTH and label[4 * common : 4 * common + 4] == last[4 * common : 4 * common + 4]:
                    common += 1
            pairs[tree, 1 : common + 1] += runs[1 : common + 1]
            runs[1 : common + 1] += 1
            runs[common + 1 :] = 1
            last_tree, last = tree, label
    yield pd.DataFrame([(t, d, pairs[t, d]) for t in range(TREES) for d in range(LEAST_DEPTH, DEPTH + 1)], columns=["tree", "depth", "pairs"])


def recall(depths: list[int], similarity: float) -> float:
    miss = 1.0
    for d in depths:
        miss *= 1 - similarity**d
    return 1 - miss


def shortened(costs: dict[tuple[int, int], float], threshold: float, target: float) -> list[int]:
    """The depth of each tree: shorten where further pairs are fewest for the recall gained, until the target."""
    depths = [DEPTH] * TREES
    while recall(depths, threshold) < target:
        choices = [
            ((costs.get((t, d - 1), 0.0) - costs.get((t, d), 0.0) + 1.0) / (np.log1p(-(threshold**d)) - np.log1p(-(threshold ** (d - 1)))), -d, t)
            for t, d in enumerate(depths)
            if d > LEAST_DEPTH
        ]
        if not choices:
            raise ValueError(f"{TREES} trees of at least {LEAST_DEPTH} values can't reach a recall of {target} at a similarity of {threshold}")
        depths[min(choices)[2]] -= 1
    return depths


def least_agreement(threshold: float) -> float:
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5


def _tags(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _connector(least: float):
    def connect(group: pd.DataFrame) -> pd.DataFrame:
        """A block of a node, or two: edges that connect the pairs with like signatures."""
        a, b = group[~group["other"]], group[group["other"]]
        edges = []
        if len(a):
            left = _tags(a["tags"])
            if b.empty:
                edges = spanning(a["id"].tolist(), None, lambda i, at: (left[at] == left[i]).mean(axis=1) >= least)
            else:
                right = _tags(b["tags"])
                edges = spanning(
                    a["id"].tolist(), b["id"].tolist(), lambda i, at: (right[at] == left[i]).mean(axis=1) >= least, lambda j, at: (left[at] == right[j]).mean(axis=1) >= least
                )
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return connect


def _likely(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.loc[(_tags(batch["ta"]) == _tags(batch["tb"])).mean(axis=1) >= least, ["a", "b"]]

    return run


def _verifier(width: int, threshold: float):
    def verify(group: pd.DataFrame) -> pd.DataFrame:
        """Exact similarities in a block of a group of candidates, or between two: links of each class, and a spanning forest."""
        a, b = group[~group["other"]], group[group["other"]]
        same = b.empty
        if same:
            b = a
        if a.empty:
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype({"a": "int64", "b": "Int64", "links": "int64"})
        shingler = Shingler(width)
        left = [shingler.shingles(words_of(t)) for t in a["text"]]
        right = left if same else [shingler.shingles(words_of(t)) for t in b["text"]]
        shared, na, nb = shared_counts(left, right), a["n"].to_numpy(), b["n"].to_numpy()
        linked = np.empty(shared.shape, bool)
        for i, row in enumerate(shared):
            linked[i] = row >= threshold * (na[i] + nb - row) - 1e-9
        if same:
            np.fill_diagonal(linked, False)
        ids, others, copies = a["id"].tolist(), b["id"].tolist(), a["copies"].to_numpy()
        rows = [(i, None, int(n)) for i, n in zip(ids, linked @ b["copies"].to_numpy(), strict=True) if n]
        if not same:
            rows += [(j, None, int(n)) for j, n in zip(others, copies @ linked, strict=True) if n]
        rows += [(i, j, 0) for i, j in spanning(ids, None if same else others, lambda i, at: linked[i, at], None if same else lambda j, at: linked[at, j])]
        # built by column: a column of ids and None would pass through floats, which do not hold 64 bits
        return pd.DataFrame({"a": pd.array([r[0] for r in rows], "int64"), "b": pd.array([r[1] for r in rows], "Int64"), "links": pd.array([r[2] for r in rows], "int64")})

    return verify


def in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Deal the rows of a group into its number of blocks by a hash of ``id``, and repeat each for the pairs of blocks that it is in: ``i <= j``, ``other`` for the second block."""
    dealt = rows.withColumn("_n", blocks.cast("int")).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    return (
        dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("i", F.least("_own", "_other"))
        .withColumn("j", F.greatest("_own", "_other"))
        .withColumn("other", F.col("_own") > F.col("_other"))
        .drop("_n", "_own", "_other")
    )


def _joined(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """The result of the join, with the hash of each row's text and ``component``, which names a group of linked classes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "join")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = scratch.written(in_pandas(texts, _signer(width), SIGNED), "signed")
    usable = signed.where("key is not null and doc_id is not null")
    # the same words have the same signature, so any will do
    named = usable.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("n").alias("n"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = scratch.written(named.select("key", "copies", "n", F.xxhash64("key").alias("id"), "first.*", "sig"), "classes")
    firsts = classes.select("id", "sig")
    labels = firsts.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.col("sig").substr(t * (4 * DEPTH) + 1, F.lit(4 * DEPTH)))).alias("tree", "label"))
    costs = labels.select("tree", "label").repartition(F.col("tree"), F.substring("label", 1, 4 * LEAST_DEPTH)).sortWithinPartitions("tree", "label").mapInPandas(_trie_costs, "tree int, depth int, pairs double")
    depths = shortened({(r["tree"], r["depth"]): r["pairs"] for r in costs.groupBy("tree", "depth").agg(F.sum("pairs").alias("pairs")).collect()}, threshold, target)
    depth = F.get(F.array(*map(F.lit, depths)), F.col("tree"))
    nodes = labels.select("id", "tree", F.xxhash64(F.col("label").substr(F.lit(1), depth * 4)).alias("node"))
    shared = nodes.groupBy("tree", "node").agg(F.count("*").alias("m")).where("m > 1")
    members = scratch.written(nodes.join(shared, ["tree", "node"]), "members")
    # a byte of each value is enough to tell likely pairs
    tags = firsts.select("id", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(TREES * DEPTH - 1)), lambda k: F.hex(F.col("sig").substr(k * 4 + 4, F.lit(1)))), "")).alias("tags"))
    tags = scratch.written(tags.join(members.select("id").distinct(), "id"), "tags")
    small = members.where(F.col("m") <= SMALL).groupBy("tree", "node").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
    pairs = small.select("ids", F.posexplode("ids").alias("at", "a")).select("a", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("b")).distinct()
    told = pairs.join(tags.select(F.col("id").alias("a"), F.col("tags").alias("ta")), "a").join(tags.select(F.col("id").alias("b"), F.col("tags").alias("tb")), "b")
    parts, least = int(spark.conf.get("spark.sql.shuffle.partitions")), least_agreement(threshold)
    many = in_blocks(members.where(F.col("m") > SMALL), F.ceil(F.col("m") / BLOCK)).join(tags, "id")
    # so many tasks whatever the size in bytes: the work is in comparing
    connected = many.repartition(parts, "tree", "node", "i", "j").groupBy("tree", "node", "i", "j").applyInPandas(_connector(least), "a long, b long")
    groups = components(told.mapInPandas(_likely(least), "a long, b long").unionByName(connected), scratch, "candidates")
    chosen = scratch.written(groups.join(classes.select("id", "copies", "n", "doc_id", "text_hash"), "id"), "groups")
    scratch.drop("members", "tags", "candidates")
    # most texts are in no group: they are left out before the join, which would move them all
    few_texts = sieved(texts.where("doc_id is not null"), chosen.select("doc_id", "text_hash"), ["doc_id", "text_hash"])
    held = chosen.select("id", "doc_id", "text_hash").join(few_texts, ["doc_id", "text_hash"]).groupBy("id").agg(F.min("text").alias("text"))
    sized = chosen.select("component", "id", "copies", "n")
    # groups of more than one block are few: as a rule a broadcast brings their numbers to the rows
    number = F.ceil(F.greatest(F.count("*") / F.lit(VERIFY), F.sum("n") / F.lit(VERIFY_SHINGLES)))
    large = few(sized.groupBy("component").agg(number.alias("blocks")).where("blocks > 1"), MOST_BROADCAST)
    blocks = in_blocks(sized.join(large, "component", "left"), F.coalesce("blocks", F.lit(1)))
    dealt = blocks.join(held, "id").repartition(parts, "component", "i", "j")
    verified = scratch.written(dealt.groupBy("component", "i", "j").applyInPandas(_verifier(width, threshold), "a long, b long, links long"), "verified")
    scratch.drop("groups")
    clusters = components(verified.where("b is not null").select("a", "b"), scratch, "clusters")
    links = verified.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    least = clusters.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    told = classes.join(links, "id", "left").join(clusters, "id", "left").join(least, "component", "left")
    told = told.select(
        "key", F.col("doc_id").alias("words_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "doc_id").alias("class_id"), F.coalesce("component", "id").alias("component")
    )
    # rows without words would all meet on the null key
    worded = signed.where("key is not null").select("doc_id", "text_hash", "key").join(told, "key", "left")
    out = worded.unionByName(signed.where("key is null").select("doc_id", "text_hash"), allowMissingColumns=True)
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("words_id", "doc_id").alias("words_id"), "text_hash", "component"
    )


def ngram_jaccard_join(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """``doc_id, text`` to ``doc_id, class_id, n_links, words_id``; see the module."""
    return _joined(docs, width, threshold, target).drop("text_hash", "component")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents without those that a linked document of a lesser ``doc_id`` stands for, with all their columns.

    Each row is judged by its own text. Of the rows of a group that share its least id one stays, and of equal rows one.
    Rows with a null ``doc_id`` stay.
    """
    joined = written(_joined(docs), "join-result")
    mark, place, group = "_text_hash", "_place", "_group"
    while {mark, place, group} & set(docs.columns):
        mark, place, group = mark + "_", place + "_", group + "_"
    gone = joined.where("doc_id <> class_id").select("doc_id", F.col("text_hash").alias(mark)).distinct()
    left = docs.withColumn(mark, F.xxhash64("text")).join(gone, ["doc_id", mark], "left_anti")
    if joined.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left.select(*docs.columns)
    of = joined.where("doc_id is not null and component is not null").select("doc_id", F.col("text_hash").alias(mark), F.col("component").alias(group)).distinct()
    # a text without words is in no group: there rows are equal by text
    order = Window.partitionBy("doc_id", F.col(group).isNull(), F.coalesce(group, mark)).orderBy("text")
    numbered = left.join(of, ["doc_id", mark], "left").withColumn(place, F.row_number().over(order))
    return numbered.where(F.col(place).eqNullSafe(1) | F.col("doc_id").isNull()).select(*docs.columns)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
