"""Token counts by offset-mapped attribution.

A whole document is encoded once; the byte lengths of its tokens give each token's character span, and an interval join
of the sorted spans with the sorted sections of the document gives each section its tokens. A token that crosses a
boundary goes by an explicit rule:

- ``majority``: to the section with most of its characters, the first of equals;
- ``first``: to the section of its first character that is in any section;
- ``proportional``: to each section by its share of the token's characters.

Sections are spans of code points, ``[start, end)``, that don't overlap; without a ``sections`` column the lines of the
text are its sections, each with its line break. All work on a document stays in its task; nothing is shuffled.

Defined results: a null text counts as empty and has one empty section; tokens outside every section are counted in a
row with section -1; sections beyond the text are cut to it; of sections that overlap, that which starts later loses the
shared characters; repeated rows are counted each; very long texts are encoded whole; an empty table gives an empty result;
further columns are ignored (the query takes none as ``sections``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import in_pandas, slices, table
from noticeloom.llm.encoding import default_path, encoder

COUNTED = "doc_id long, section int, start int, end int, n_tokens double, n_crossing int"
RULES = ("majority", "first", "proportional")


def line_sections(text: str) -> np.ndarray:
    """Start and end of each line with its break."""
    sizes = [len(x) + 1 for x in text.split("\n")]
    sizes[-1] -= 1
    if len(sizes) > 1 and not sizes[-1]:
        sizes.pop()
    ends = np.cumsum(sizes)
    return np.stack((ends - sizes, ends), axis=1)


def token_spans(text: str, ids: np.ndarray, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, in code points; tokens that share a character both cover it."""
    ends = np.cumsum(byte_lengths[ids])
    starts = ends - byte_lengths[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def disjoint(sections: np.ndarray, size: int) -> np.ndarray:
    """Cut to the text; what starts later gives way."""
    out = np.clip(sections, 0, size)
    reach = 0
    for i in np.lexsort((np.arange(len(out)), out[:, 0])):
        out[i, 0] = max(out[i, 0], reach)
        out[i, 1] = max(out[i, 1], out[i, 0])
        reach = max(reach, out[i, 1])
    return out


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, the last for those outside, and how many of them cross a boundary. Sections are disjoint."""
    order = np.argsort(sections[:, 0], kind="stable")
    order = order[sections[order, 0] < sections[order, 1]]  # empty ones hold nothing
    begin, end = sections[order, 0], sections[order, 1]
    n, tokens, crossing = len(sections), np.zeros(len(sections) + 1), np.zeros(len(sections) + 1, np.int64)
    if not len(order):
        tokens[n] = len(starts)
        return tokens, crossing
    at = np.searchsorted(begin, starts, "right") - 1
    inside = (at >= 0) & (ends <= end[at])
    np.add.at(tokens, order[at[inside]], 1.0)
    for k in np.flatnonzero(~inside):
        i, a, b, parts = max(int(at[k]), 0), int(starts[k]), int(ends[k]), []
        while i < len(begin) and begin[i] < b:
            if (overlap := min(b, int(end[i])) - max(a, int(begin[i]))) > 0:
                parts.append((overlap, int(order[i])))
            i += 1
        covered = sum(x for x, _ in parts)
        if rule == "proportional":
            shares = [(x / (b - a), s) for x, s in parts] + [((b - a - covered) / (b - a), n)] * (covered < b - a)
        elif not parts or rule == "majority" and b - a - covered > max(x for x, _ in parts):
            shares = [(1.0, n)]
        else:
            shares = [(1.0, (max(parts, key=lambda x: x[0]) if rule == "majority" else parts[0])[1])]
        for share, s in shares:
            tokens[s] += share
            crossing[s] += 1
    return tokens, crossing


def _counter(path: str, rule: str, given: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        lengths = coder.byte_lengths()
        for batch in slices(batches, 2000):
            texts = batch["text"].tolist()
            ids, stops = coder.encode(texts)
            out, at = [], 0
            for k, (text, stop) in enumerate(zip(texts, stops.tolist(), strict=True)):
                if given:
                    listed = batch["sections"].iloc[k]
                    spans = np.array([(s["start"], s["end"]) for s in listed] if listed is not None else [], np.int64).reshape(-1, 2)
                    spans = disjoint(spans, len(text))
                else:
                    spans = line_sections(text)
                starts, ends = token_spans(text, ids[at:stop], lengths)
                at = stop
                tokens, crossing = attribute(starts, ends, spans, rule)
                rows = len(spans) + bool(tokens[-1])
                number = np.arange(rows)
                number[len(spans) :] = -1
                edge = np.concatenate((spans, [[0, 0]]))[:rows]
                out.append((k, number, edge, tokens[:rows], crossing[:rows]))
            if not out:
                continue
            counts = [len(x[1]) for x in out]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].repeat(counts).reset_index(drop=True),
                    "section": np.concatenate([x[1] for x in out]),
                    "start": np.concatenate([x[2][:, 0] for x in out]),
                    "end": np.concatenate([x[2][:, 1] for x in out]),
                    "n_tokens": np.concatenate([x[3] for x in out]),
                    "n_crossing": np.concatenate([x[4] for x in out]),
                }
            )

    return run


def attributed(docs: DataFrame, rule: str = "majority", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, text`` and perhaps ``sections array<struct<start, end>>`` to a row a section: its span, tokens, and how many of them cross a boundary."""
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    given = "sections" in docs.columns
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select("doc_id", text, *(["sections"] if given else []))
    return in_pandas(rows, _counter(tokenizer or default_path(), rule, given), COUNTED)


def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(table(spark, sf_dir, "documents").select("doc_id", "text"))
