"""Byte-level BPE over whole texts with the tokenizers library, with a memory of words.

Byte-level BPE never merges across the words that its pattern cuts, so a text's ids are those of its words in a row. The
library's model encodes each new word once in a worker and the ids of known words are put together; texts repeat most
words. The result equals the library's own encoding of the whole text, added tokens of the tokenizer included (tests
compare them). A tokenizer that cuts texts in another way, and texts that hold the string of an added token, go to the
library whole.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import string
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.llm.common import slices

#: Words that a worker remembers at most: a generation of half as many, and the one before it. A word takes about 200 bytes.
MOST_REMEMBERED = 200_000
#: Bytes of texts that are worked on at once, or one text.
MOST_AT_ONCE = 4 << 20
#: Letters and these marks after them: two words of the pattern, without asking it.
_MARKS = string.punctuation


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 for themselves, others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Texts to ids, as little-endian unsigned integers wide enough for the vocabulary."""

    def __init__(self, path: str, remembered: int = MOST_REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        #: Fixed value: the word pattern of byte-level vocabularies with ``use_regex``.
        self.cut = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall
        if sys.byteorder != "little":
            raise NotImplementedError("ids are made in the machine's byte order")
        self.type, self.code = (np.dtype("<u2"), "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (np.dtype("<u4"), "I")
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.model._resize_cache(0)  # words are remembered here
        self.by_words = self._cuts_as_expected()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.packers = [struct.Struct(f"<{n}{self.code}").pack for n in range(16)]
        #: Ids of words, and of what follows a space together with the space; none where white space beside the space makes it
        #: no start of a word.
        self.words: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}
        #: What was remembered after a space before this generation: what is met again goes over to it, the rest is forgotten.
        self.before: dict[str, bytes] = {}

    def _cuts_as_expected(self) -> bool:
        said = json.loads(self.tokenizer.to_str())
        cut, model = said["pre_tokenizer"] or {}, said["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        return said["normalizer"] is None and model["type"] == "BPE" and plain and cut.get("type") == "ByteLevel" and bool(cut.get("use_regex")) and not cut.get("add_prefix_space")

    def _learn(self, memory: dict, words: Iterable[str], prefix: str) -> None:
        """Let the library's model encode new words."""
        model, space, packers, characters = self.model.tokenize, self.characters[32], self.packers, self.characters.__getitem__
        for word in words:
            if prefix and word.isascii() and word.isalpha():
                shown = space + word
            else:
                shown = "".join(map(characters, (prefix + word).encode("utf-8", "surrogatepass")))
            ids = [t.id for t in model(shown)]
            memory[word] = packers[len(ids)](*ids) if len(ids) < len(packers) else array(self.code, ids).tobytes()

    def _parts(self, chunk: str, space: str) -> tuple[str, ...]:
        """The words of ``space`` (one, or none) and a chunk without white space at its ends, without the space."""
        if chunk.isalpha():
            return (chunk,)
        if (stem := chunk.rstrip(_MARKS)).isalpha():
            return stem, chunk[len(stem) :]
        first, *rest = self.cut(space + chunk)
        return first[len(space) :], *rest

    def _after_space(self, chunks: list[str]) -> dict[str, bytes]:
        """Remember the ids of new chunks together with the space before them; none where white space at an end makes it no start of a word.

        What a line break joins is seldom the same twice: its ids are put together, given back and not remembered.
        """
        after, words, before, firsts, bare, marked, composed = self.after_space, self.words, self.before, {}, {}, [], []
        out = {}
        for chunk in chunks:
            if chunk.isalpha():  # most are
                firsts[chunk] = None
                continue
            if (first := chunk.rstrip(_MARKS)).isalpha():
                mark = chunk[len(first) :]
                marked.append((chunk, first, mark))
                if mark not in words:
                    bare[mark] = None
            elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
                after[chunk] = b""
                continue
            else:
                line, broken, more = chunk.partition("\n")
                if broken and line and more and not (line[-1].isspace() or more[0].isspace()):
                    first, *rest = self._parts(line, " ")
                    rest += ("\n", *self._parts(more, ""))
                else:
                    first, *rest = self._parts(chunk, " ")
                for word in rest:
                    if word not in words:
                        bare[word] = None
                composed.append((chunk, first, rest, not broken))
            if first not in after:
                if (ids := before.get(first)) is None:
                    firsts[first] = None
                else:
                    after[first] = ids
        self._learn(after, firsts, " ")
        self._learn(words, bare, "")
        for chunk, first, mark in marked:
            after[chunk] = after[first] + words[mark]
        for chunk, first, rest, often in composed:
            ids = after[first]
            if rest:
                ids = b"".join((ids, *map(words.__getitem__, rest)))
            if often:
                after[chunk] = ids
            else:
                out[chunk] = ids
        return out

    def _cut(self, text: str) -> bytes:
        words = self.cut(text)
        self._learn(self.words, [w for w in dict.fromkeys(words) if w not in self.words], "")
        return b"".join(map(self.words.__getitem__, words))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def encode(self, texts: pa.Array | list[str], count_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (none of them, if they are only counted), and where those of each text end. No text is null."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(texts):
            return np.empty(0, self.type), np.empty(0, np.int64)
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        if len(texts) > 1 and size[-1] > MOST_AT_ONCE:
            middle = min(max(1, int(np.searchsorted(size, size[-1] // 2))), len(texts) - 1)
            (one, ends), (two, more) = self.encode(texts[:middle], count_only), self.encode(texts[middle:], count_only)
            return np.concatenate((one, two)), np.concatenate((ends, more + ends[-1]))
        if not self.by_words:
            coded = [np.frombuffer(self._whole(t), self.type) for t in texts.to_pylist()]
            return np.concatenate(coded), np.cumsum([len(x) for x in coded])
        split = pc.split_pattern(texts, " ")
        begin = split.offsets.to_numpy()[: len(texts)].astype(np.int64)
        end = split.offsets.to_numpy()[1 : len(texts) + 1].astype(np.int64)
        chunks = split.values.dictionary_encode()
        codes, known = chunks.indices.to_numpy(zero_copy_only=False).copy(), chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.after_space) > self.remembered // 2:
            self.before, self.after_space = self.after_space, {}
        if len(self.words) > self.remembered // 4:
            self.words = {}
        values, new = list(map(self.after_space.get, known)), []
        for i, v in enumerate(values):
            if v is None:
                word = known[i]
                if (v := self.before.get(word)) is None:
                    new.append(i)
                else:
                    values[i] = self.after_space[word] = v
        if new:
            gc.disable()  # nothing here makes cycles, and looking for them among so many words takes long
            try:
                found = self._after_space([known[i] for i in new])
            finally:
                gc.enable()
            for i in new:
                word = known[i]
                values[i] = found[word] if (v := self.after_space.get(word)) is None else v
        spoilt = np.fromiter(map(len, values), np.int64, len(values)) == 0
        # no space stands before the first, and none after the last, so these may have white space there
        whole = np.zeros(len(texts), bool)
        for string in self.added:
            whole |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        lone = end - begin == 1
        first = [known[c] for c in codes[begin].tolist()]
        last = [known[c] for c in codes[end - 1].tolist()]
        inner = np.concatenate(([0], np.cumsum(spoilt[codes])))
        bad = np.where(lone, 0, inner[np.maximum(end - 1, begin + 1)] - inner[begin + 1]) > 0
        bad |= ~lone & np.fromiter((a[-1:].isspace() or not z or z[0].isspace() for a, z in zip(first, last, strict=True)), bool, len(first))
        codes[end - 1] = len(values) + np.arange(len(texts))
        values += [b"" if one else self._cut(" " + z) if not b else b"" for one, b, z in zip(lone, bad | whole, last, strict=True)]
        codes[begin] = len(values) + np.arange(len(texts))
        values += [b"" if b else self._cut(a) for b, a in zip(bad | whole, first, strict=True)]
        again = np.flatnonzero(bad | whole)
        for i in again.tolist():
            text = texts[i].as_py()
            values[codes[begin[i]]] = self._whole(text) if whole[i] else self._cut(text)
        sizes = np.fromiter(map(len, values), np.int32, len(values)) // self.type.itemsize
        counts = sizes[codes]
        for i in again.tolist():
            counts[begin[i] + 1 : end[i]] = 0
        ends = np.cumsum(counts, dtype=np.int32)
        if count_only:
            return np.empty(0, self.type), ends[end - 1].astype(np.int64)
        pool, starts = np.frombuffer(b"".join(values), self.type), np.cumsum(sizes, dtype=np.int32) - sizes
        at = np.repeat(starts[codes] - (ends - counts), counts)
        at += np.arange(ends[-1], dtype=np.int32)
        return pool[at], ends[end - 1].astype(np.int64)

    def byte_lengths(self) -> np.ndarray:
        """Bytes of each id: in a byte-level vocabulary every character stands for a byte, and added tokens are plain text."""
        if not self.by_words:
            raise ValueError("spans from byte lengths need a byte-level vocabulary")
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        size = self.tokenizer.get_vocab_size()
        return np.array([added.get(i, len(self.tokenizer.id_to_token(i) or "")) for i in range(size)], np.int64)


@functools.lru_cache(maxsize=1)
def encoder(path: str, remembered: int = MOST_REMEMBERED) -> WordEncoder:
    """One encoder a worker process: the tasks that it runs share the words that they met."""
    return WordEncoder(path, remembered)


def token_ids(text: Column, path: str | None = None) -> Column:
    """The ids of a text, ``array<int>``; none for null."""
    path = path or default_path()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in slices(batches, 2000):
            ids, ends = encoder(path).encode(batch.fillna("").tolist())
            yield pd.Series(np.split(ids.astype(np.int32), ends[:-1]) if len(ends) else [], dtype=object)

    return F.pandas_udf(run, "array<int>")(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """How many tokens a text has; 0 for null."""
    path = path or default_path()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in slices(batches, 2000):
            yield pd.Series(np.diff(encoder(path).encode(batch.fillna("").tolist(), count_only=True)[1], prepend=0), dtype="int64")

    return F.pandas_udf(run, "long")(text)
