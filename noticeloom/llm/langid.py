"""Language identification by hierarchical discrimination.

First a document's language family is predicted, then the language within it. Both steps are one-versus-one linear
support vector machines over hashed character 1- to 3-grams of the whole text (lower case; what isn't a letter counts as
one space; square roots of frequencies, scaled to unit length).

Training uses documents with a text and a language outside the held-out third, equal rows once. :func:`fit_whole` takes all of them: they are
dealt by a hash of id and text into cells of about ``CELL``, each cell gives a machine for each pair, and a pair's machines are averaged
(parameter mixing). A language that is too rare for that has its rows in several cells, so that each cell has about ``LEAST`` of it; machines, not
documents, reach the driver. :func:`fit` takes a bounded sample: about ``PER_LANGUAGE`` documents a language and ``MOST_ROWS`` in all, those
with the least hashes; the sample's features, not its texts, reach the driver. Prediction runs over all documents in the tasks and shuffles
nothing. A prediction sees the text alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any labelled document everything
is ``und``; with a single language every text with a letter is that language; ties go to the language that sorts first;
repeated rows are predicted each; very long texts count whole; an empty table gives an empty result; further columns are
ignored. The score is the probability of the family times that of
the language in it, each a mean of logistic margins.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import slices, table, written

#: Families of languages by ISO 639-1 code. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
DIMENSIONS, ORDERS = 2048, 3
PER_LANGUAGE, MOST_ROWS = 500, 20_000
#: Rows of a cell, about, and rows of a language that it has, about, where there are as many.
CELL, LEAST = 1000, 8
STEEPNESS = 4.0
#: A text is held against texts cut to the largest of these numbers of letters that it reaches.
LETTERS = (1, 8, 16, 32, 64, 128)
#: Recognised is what lies at least this far from a coin toss (0) to the margin that this part of the held-out rows miss (1).
SHARE, MISSED = 0.5, 0.01
LANGUAGE = "lang_pred string, score double"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters; there are none from U+40000 on."""
    return np.fromiter((chr(i).isalpha() for i in range(0x40000)), bool, 0x40000)


class Featurizer:
    def __init__(self):
        self.letter = letters()

    def codes(self, text: str) -> np.ndarray:
        """Code points of letters with 0 for each run of anything else, and 0 at both ends; empty without a letter."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where((c < len(self.letter)) & self.letter[np.minimum(c, len(self.letter) - 1)], c, 0)
        if not c.any():
            return np.empty(0, np.uint32)
        c = np.concatenate((np.zeros(1, np.uint32), c.astype(np.uint32), np.zeros(1, np.uint32)))
        return c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]

    def vector(self, text: str | None) -> np.ndarray | None:
        c = self.codes(text) if text else ()
        if not len(c):
            return None
        counts, h = np.zeros(DIMENSIONS, np.float64), np.zeros(len(c), np.uint32)
        for order in range(ORDERS):
            h = (h[: len(c) - order] + np.uint32(order + 1)) * np.uint32(0x9E3779B1) ^ c[order:] * np.uint32(0x85EBCA6B)
            mixed = (h ^ h >> np.uint32(15)) * np.uint32(0xC2B2AE35)
            counts += np.bincount(mixed >> np.uint32(21), minlength=DIMENSIONS)
        v = np.sqrt(counts)
        return (v / np.linalg.norm(v)).astype(np.float32)


def trained_svm(x: np.ndarray, y: np.ndarray, decay: float = 1e-5, steps: int = 400) -> np.ndarray:
    """Weights, the last for the constant, of a linear SVM with squared hinge loss; accelerated gradient steps.

    Both sides weigh the same however many rows they have.
    """
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = last = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (4.0 + decay)
    if len(x) <= x.shape[1]:  # the same steps by factors of the rows, of which the weights are sums: fewer than the weights
        products = x @ x.T
        a = last = np.zeros(len(x), np.float32)
        for t in range(steps):
            look = a + np.float32(t / (t + 3.0)) * (a - last)
            slack = np.maximum(0, 1 - y * (products @ look))
            last, a = a, look - np.float32(rate) * (np.float32(decay) * look - 2 * weight * slack * y)
        return a @ x
    for t in range(steps):
        look = w + (t / (t + 3.0)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ look))
        last, w = w, look - rate * (decay * look - 2 * ((weight * slack * y) @ x))
    return w


def one_versus_one(x: np.ndarray, labels: np.ndarray) -> dict:
    names = sorted(set(labels.tolist()))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    weights = []
    for i, j in pairs:
        of = (labels == names[i]) | (labels == names[j])
        weights.append(trained_svm(x[of], np.where(labels[of] == names[i], 1.0, -1.0).astype(np.float32)))
    return {"names": names, "pairs": pairs, "weights": np.array(weights, np.float32).reshape(len(pairs), DIMENSIONS + 1)}


def votes(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winning name of each row, by hard votes and then by soft ones, and its mean probability."""
    n = len(model["names"])
    if n == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    hard, soft = np.zeros((len(x), n)), np.zeros((len(x), n))
    margins = x @ model["weights"][:, :-1].T + model["weights"][:, -1]
    for k, (i, j) in enumerate(model["pairs"]):
        p = 1 / (1 + np.exp(-STEEPNESS * np.clip(margins[:, k].astype(np.float64), -20, 20)))
        hard[:, i] += p >= 0.5
        hard[:, j] += p < 0.5
        soft[:, i] += p
        soft[:, j] += 1 - p
    best = np.argmax(hard + soft / n, axis=1)
    return best, soft[np.arange(len(x)), best] / (n - 1)


def fitted(x: np.ndarray, labels: np.ndarray) -> dict | None:
    """The family step, and the language step of each family."""
    if not len(labels):
        return None
    family = np.array([FAMILY_OF.get(c, c) for c in labels.tolist()])
    return {"families": one_versus_one(x, family), "languages": {f: one_versus_one(x[family == f], labels[family == f]) for f in sorted(set(family.tolist()))}}


def predicted(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    which, score = votes(model["families"], x)
    out = np.empty(len(x), object)
    score = score.copy()
    for k, name in enumerate(model["families"]["names"]):
        rows = np.flatnonzero(which == k)
        if len(rows):
            inner = model["languages"][name]
            best, p = votes(inner, x[rows])
            out[rows] = np.array(inner["names"], object)[best]
            score[rows] *= p
    return out.tolist(), score


def margins(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted languages, and how far each score lies from tossing a coin at each step (0) to certainty (1)."""
    names, score = predicted(model, x)
    step = 0.5 if len(model["families"]["names"]) > 1 else 1.0
    coins = {c: step * (0.5 if len(inner["names"]) > 1 else 1.0) for inner in model["languages"].values() for c in inner["names"]}
    coin = np.array([coins[c] for c in names], np.float64)
    return names, np.where(coin < 1, (score - coin) / np.where(coin < 1, 1 - coin, 1), 1.0)


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    featurizer = Featurizer()
    for batch in slices(batches):
        found = [(o, c, v.astype(np.float16).tobytes()) for o, c, t in zip(batch["place"], batch["lang"], batch["text"], strict=True) if (v := featurizer.vector(t)) is not None]
        yield pd.DataFrame(found, columns=["place", "lang", "vector"])


def held_out_column() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _sample(usable: DataFrame, per_language: int, most_rows: int) -> tuple[DataFrame | None, int]:
    """``place, lang, text`` of about as many rows a language as the second value says; None if there are none."""
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_rows).collect()}
    if not counts:
        return None, 0
    each = max(1, min(per_language, most_rows // len(counts)))
    # a few more than needed, as the hash decides for each row alone; the driver keeps the least hashes
    place = (F.xxhash64("doc_id", "text") / F.lit(2.0**64)) + 0.5
    shares = [(lang, 1.5 * each / n if n > 2 * each else 1.0) for lang, n in counts.items()]
    table = usable.sparkSession.createDataFrame(shares, "lang string, share double")  # at most ``most_rows`` of them
    near = usable.select(place.alias("place"), "lang", "text").join(F.broadcast(table), "lang").where("place <= share")
    # equal rows have one place: they count once, however many there are
    return near.groupBy("lang", "place").agg(F.first("text").alias("text")), each


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> dict | None:
    """A model from a bounded sample of the labelled documents outside the held-out third; None if there are none."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out_column())
    rows, each = _sample(usable, per_language, most_rows)
    if rows is None:
        return None
    found: dict[str, list] = {}
    for r in rows.mapInPandas(_vectors, "place double, lang string, vector binary").toLocalIterator():
        found.setdefault(r["lang"], []).append((r["place"], bytes(r["vector"])))
    kept = [(lang, v) for lang in sorted(found) for _, v in sorted(found[lang])[:each]]
    if not kept:
        return None
    x = np.frombuffer(b"".join(v for _, v in kept), np.float16).reshape(len(kept), DIMENSIONS).astype(np.float32)
    return fitted(x, np.array([lang for lang, _ in kept], object))


def _dealt(usable: DataFrame) -> tuple[DataFrame, int]:
    """``cell, place, lang, vector`` of every row with a letter, repeated where its language is rare, and the number of cells; equal rows may repeat."""
    counts = written(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    total, langs = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cells = max(1, -(-total // CELL))
    least = max(1, min(LEAST, CELL // (2 * max(1, langs))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()  # so that a row that is repeated often goes once a task

        def new() -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys = list(zip(batch["place"].tolist(), batch["lang"], strict=True))
                fresh = []
                for key in keys:
                    fresh.append(key not in seen)
                    seen.add(key)
                if len(seen) > 100_000:
                    seen.clear()
                yield batch[fresh]

        yield from _vectors(new())

    rows = usable.select(F.xxhash64("doc_id", "text").alias("place"), "lang", "text").mapInPandas(run, "place long, lang string, vector binary")
    groups = counts.select("lang", F.greatest(F.lit(1).cast("long"), F.expr(f"n div {least}")).alias("groups"))
    cell = F.when(F.col("groups") >= cells, F.array(F.pmod("place", F.lit(cells).cast("long")))).otherwise(
        F.sequence(F.pmod("place", "groups"), F.lit(cells - 1).cast("long"), F.col("groups"))
    )
    return rows.join(F.broadcast(groups), "lang").select(F.explode(cell).alias("cell"), "place", "lang", "vector"), cells


MACHINES = "families boolean, family string, one string, other string, cell long, n long, weights binary"


def _cell_machines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of cell, place and language: the sums of each pair's weights over the task's cells; a language alone has none."""
    sums: dict[tuple, list] = {}
    cell = last = None
    langs, vectors = [], []

    def end() -> None:
        model = fitted(np.frombuffer(b"".join(vectors), np.float16).reshape(len(vectors), DIMENSIONS).astype(np.float32), np.array(langs, object))
        for family, step in [(None, model["families"]), *model["languages"].items()]:
            for (i, j), w in zip(step["pairs"], step["weights"].astype(np.float64), strict=True):
                of = sums.setdefault((family is None, family, step["names"][i], step["names"][j]), [cell, 0, np.zeros(DIMENSIONS + 1)])
                of[1] += 1
                of[2] += w
            if family is not None:
                for c in step["names"]:
                    sums.setdefault((False, family, c, c), [cell, 0, np.empty(0)])
        langs.clear()
        vectors.clear()

    for batch in batches:
        for c, place, lang, vector in zip(batch["cell"].tolist(), batch["place"].tolist(), batch["lang"], batch["vector"], strict=True):
            if c != cell and langs:
                end()
            if (c, place, lang) != last:
                cell, last = c, (c, place, lang)
                langs.append(lang)
                vectors.append(bytes(vector))
    if langs:
        end()
    yield pd.DataFrame([(*key, first, n, w.tobytes()) for key, (first, n, w) in sums.items()], columns=[c.split()[0] for c in MACHINES.split(", ")])


def _mean_machine(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("cell")
    total = sum(np.frombuffer(bytes(w), np.float64) for w in rows["weights"])
    n = int(rows["n"].sum())
    return rows.head(1).assign(n=n, weights=[(total / max(1, n)).astype(np.float32).tobytes()])


def fit_whole(docs: DataFrame) -> dict | None:
    """A model from every labelled document outside the held-out third; None if there are none with a letter."""
    dealt, cells = _dealt(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out_column()))
    machines = dealt.repartition(cells, "cell").sortWithinPartitions("cell", "place", "lang").mapInPandas(_cell_machines, MACHINES)
    means = machines.groupBy("families", "family", "one", "other").applyInPandas(_mean_machine, MACHINES)
    found: dict[str | None, dict] = {}
    for r in means.toLocalIterator():
        found.setdefault(r["family"], {})[r["one"], r["other"]] = np.frombuffer(bytes(r["weights"]), np.float32)
    if not found:
        return None

    def step(names: list[str], machines: dict) -> dict:
        pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
        # no machine, where no cell has both languages, is a coin toss
        weights = [machines.get((names[i], names[j]), np.zeros(DIMENSIONS + 1, np.float32)) for i, j in pairs]
        return {"names": names, "pairs": pairs, "weights": np.array(weights, np.float32).reshape(len(pairs), DIMENSIONS + 1)}

    families = found.pop(None, {})
    return {"families": step(sorted(found), families), "languages": {f: step(sorted({c for pair in found[f] for c in pair}), found[f]) for f in sorted(found)}}


def language(model: dict | None, text: Column) -> Column:
    """``struct<lang_pred, score>`` of a text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        featurizer = Featurizer()
        for batch in slices(batches):
            langs, scores = ["und"] * len(batch), np.zeros(len(batch))
            vectors = [(i, v) for i, t in enumerate(batch) if model and (v := featurizer.vector(t)) is not None]
            if vectors:
                names, p = predicted(model, np.array([v for _, v in vectors]))
                for (i, _), name, s in zip(vectors, names, p, strict=True):
                    langs[i], scores[i] = name, s
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return F.pandas_udf(run, LANGUAGE)(text)


def first_letters(text: str, n: int) -> str | None:
    """A text up to its n-th letter; None if it has fewer."""
    for at, c in enumerate(text):
        n -= c.isalpha()
        if not n:
            return text[: at + 1]
    return None


def least_margins(docs: DataFrame, model: dict | None) -> dict[int, float]:
    """The least margin of a recognised text by its number of letters (``LETTERS``), from all held-out rows with a language.

    Their texts are cut to each number of letters; of the margins of right predictions the first percentile counts,
    and the least is ``SHARE`` of it. A number that no held-out text reaches has the least of the number before; without
    held-out rows the least is a coin toss.
    """
    if model is None:
        return dict.fromkeys(LETTERS, 0.0)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & held_out_column()).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        featurizer = Featurizer()
        for batch in slices(batches):
            cuts = [(lang, n, v) for lang, t in zip(batch["lang"], batch["text"], strict=True) for n in LETTERS if (c := first_letters(t, n)) and (v := featurizer.vector(c)) is not None]
            names, margin = margins(model, np.array([v for *_, v in cuts])) if cuts else ([], [])
            yield pd.DataFrame([(n, round(float(m), 4)) for (lang, n, _), name, m in zip(cuts, names, margin, strict=True) if name == lang], columns=["letters", "margin"])

    # margins have four digits, so that a percentile counts some thousand values, however many rows there are
    missed = rows.mapInPandas(run, "letters int, margin double").groupBy("letters").agg(F.percentile("margin", F.lit(MISSED)).alias("margin"))
    found, out, last = {r["letters"]: r["margin"] for r in missed.collect()}, {}, 0.0
    for n in LETTERS:
        last = out[n] = SHARE * found[n] if n in found else last
    return out


def recognised(model: dict | None, least: dict[int, float], text: Column) -> Column:
    """Whether a text has a letter and a margin of at least what its number of letters asks for."""
    bounds, values = np.array(sorted(least)), np.array([least[n] for n in sorted(least)])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        featurizer = Featurizer()
        for batch in slices(batches):
            out = np.zeros(len(batch), bool)
            vectors = [(i, np.count_nonzero(featurizer.codes(t)), v) for i, t in enumerate(batch) if model and (v := featurizer.vector(t)) is not None]
            if vectors:
                places = np.searchsorted(bounds, [n for _, n, _ in vectors], side="right") - 1
                out[[i for i, *_ in vectors]] = margins(model, np.array([v for *_, v in vectors]))[1] >= values[places]
            yield pd.Series(out)

    return F.pandas_udf(run, "boolean")(text)


def identified(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    return docs.select("doc_id", held_out_column().alias("held_out"), language(model, F.col("text")).alias("x")).select("doc_id", "held_out", "x.*")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, fit(docs))
