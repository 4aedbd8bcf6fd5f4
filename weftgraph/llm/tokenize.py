"""Exact byte-level BPE of a whole corpus by traversing the trie of its distinct words.

A BPE encoding is valid exactly if each pair of neighbouring tokens is; so the encoding of a word is fixed by
the *last token* of each of its prefixes. Sorted distinct words are visited in the order of a depth-first walk
of their trie: what two words share at their start is computed once, only the states below the branch are new.
No corpus-wide shuffle is needed: a worker keeps the words that it knows, within a bound, and forgets all when
the bound is reached (which costs time, never rows).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Words that a worker remembers; beyond it the memory is emptied.
KNOWN_WORDS = 200_000
#: The pattern of the vocabulary, with white space as Unicode has it (regex's own \s has four control characters more).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: The same for the standard library, a third faster, right where \w less digits and _ are the letters and \s is white space.
PLAIN = r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: What rules PLAIN out: control characters that Python counts as white space, and all beyond Latin, Greek, Cyrillic, CJK
#: and emoji, where letters and numbers may be told apart otherwise.
RARE = "[\x1c-\x1f\xaa\xb2\xb3\xb9\xba\xbc-\xbe\u02b0-\u036f\u0482-\u2012\u2020-\u2025\u2027-\u20ab\u20ad-\u2121\u2123-\u218f\u2460-\u24ff\u2700-\u2fff\u3003-\u3007\u3012-\u30ff\u3100-\u33ff\u9f00-\uff00\uff10-\uff1a\uff21-\uffff\U00010000-\U0001efff\U0001f100-\U0001f1e5\U0001fb00-\U0010ffff]"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable bytes stand for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes words (bytes) with one vocabulary; ``encode_words`` is the trie walk."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_alphabet()
        vocabulary = model["vocab"]
        self.ids: dict[bytes, int] = {}
        for text, i in vocabulary.items():
            if all(c in to_byte for c in text):
                self.ids[bytes(to_byte[c] for c in text)] = i
        self.merges: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i = vocabulary[a + b]
            self.merges[vocabulary[a], vocabulary[b]] = i
            if i not in self.parts:
                self.parts[i] = (vocabulary[a], vocabulary[b])
                self.rank[i] = rank
        #: by the last two bytes of a prefix: the lengths, longest first, of the tokens that can end it
        ends: dict[bytes, set[int]] = {}
        for token in self.ids:
            if len(token) > 1:
                ends.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {end: tuple(sorted(n, reverse=True)) + (1,) for end, n in ends.items()}
        self.fits: dict[tuple[int, int], bool] = {}

    def pair_holds(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their joined bytes are encoded.

        The boundary between them is undone merge by merge, the later merge of the two sides first; if a merge
        across it had come earlier than both, the pair would have been joined.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        merges, parts, rank = self.merges, self.parts, self.rank
        a, b, bound, ok = left, right, 1 << 60, True
        while True:
            joined = merges.get((a, b))
            # ties go to the left merge, which is why the right side's bound is inclusive
            if joined is not None and rank[joined] < bound:
                ok = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                bound, a = ra, parts[a][1]
            else:
                bound, b = rb + 1, parts[b][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[left, right] = ok
        return ok

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """ids of each distinct word; the words are sorted here, which makes the loop a depth-first trie walk."""
        out: dict[bytes, list[int]] = {}
        last: list[int] = []  # last[i]: the last token of the prefix of i + 1 bytes
        size: list[int] = []  # and its length
        before = b""
        ids, lengths, holds, alone = self.ids, self.lengths, self.pair_holds, (1,)
        for word in sorted(set(words)):
            n, shared, most = len(word), 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared:], size[shared:]
            for end in range(shared + 1, n + 1):
                for k in lengths.get(word[end - 2 : end], alone) if end > 1 else alone:
                    if k > end:
                        continue
                    token = ids.get(word[end - k : end])
                    if token is None:
                        continue
                    if k == end:
                        # a token alone: valid if its own bytes encode to it
                        if k == 1 or self.whole(token):
                            break
                    elif holds(last[end - k - 1], token) and (k == 1 or self.whole(token)):
                        break
                last.append(token)
                size.append(k)
            at, rev = n, []
            while at:
                rev.append(last[at - 1])
                at -= size[at - 1]
            out[word] = rev[::-1]
            before = word
        return out

    def whole(self, token: int) -> bool:
        """Whether the merges lead to this token from its own bytes."""
        known = self.fits.get((token, -1))
        if known is None:
            known = token < 0 or token not in self.parts or self.pair_holds_not(token)
            self.fits[token, -1] = known
        return known

    def pair_holds_not(self, token: int) -> bool:
        a, b = self.parts[token]
        return self.whole(a) and self.whole(b)


_encoders: dict[str, TrieEncoder] = {}
_known: dict[str, tuple[dict[str, int], list[np.ndarray]]] = {}


def encoder(vocabulary: str = VOCABULARY, tokenizers: str = TOKENIZERS) -> TrieEncoder:
    path = os.path.join(tokenizers, f"{vocabulary}.json")
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


class BatchEncoder:
    """Encodes batches of texts; keeps the words seen, numbered, with their tokens in one flat array."""

    def __init__(self, vocabulary: str = VOCABULARY, tokenizers: str = TOKENIZERS, bound: int = KNOWN_WORDS):
        import regex

        self.trie = encoder(vocabulary, tokenizers)
        self.split_any = regex.compile(PATTERN).findall
        self.split_plain = re.compile(PLAIN).findall
        self.rare = re.compile(RARE).search
        self.bound = bound
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if self.rare(text) else self.split_plain(text)

    def numbers(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Word numbers of all texts after one another, and how many words each text has."""
        words: list[str] = []
        counts: list[int] = []
        for t in texts:
            w = self.split(t) if t else []
            words += w
            counts.append(len(w))
        if len(self.number) > self.bound:
            self.forget()
        new = set(words).difference(self.number)
        if new:
            raw = {w: w.encode("utf-8", "surrogatepass") for w in new}
            ids = self.trie.encode_words(list(raw.values()))
            fresh = []
            lens = []
            for w, b in raw.items():
                self.number[w] = len(self.number)
                fresh += ids[b]
                lens.append(len(ids[b]))
            self.flat = np.concatenate([self.flat, np.asarray(fresh, np.int32)])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.asarray(lens, np.int64))])
        get = self.number
        return [get[w] for w in words], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets of the texts)."""
        numbers, counts = self.numbers(texts)
        w = np.asarray(numbers, np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
        lens = (self.start[1:] - self.start[:-1])[w] if len(w) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(lens)])
        if not len(w):
            return np.zeros(0, np.int32), ends[bounds]
        at = np.repeat(self.start[w] - ends[:-1], lens) + np.arange(ends[-1])
        return self.flat[at], ends[bounds]


def _slices(texts: list[str | None], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters, so that very long texts don't add up in memory."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, tokenizers: str = TOKENIZERS
) -> DataFrame:
    """(id, ids array<int>) of each row, in one pass without a shuffle.

    Null and empty texts have the empty list; blank texts are encoded like any other; strings that look like
    special tokens are ordinary text; repeated rows stay repeated; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _worker_encoder(vocabulary, tokenizers)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                flat, offsets = enc.encode(texts[a:b])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def count_tokens(
    docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY, tokenizers: str = TOKENIZERS
) -> DataFrame:
    """The columns of ``keep`` and n_tokens of each row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _worker_encoder(vocabulary, tokenizers)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in _slices(texts):
                numbers, counts = enc.numbers(texts[a:b])
                lens = (enc.start[1:] - enc.start[:-1])[np.asarray(numbers, np.int64)] if numbers else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(lens)])
                bounds = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
                n = ends[bounds[1:]] - ends[bounds[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(n.astype(np.int64))],
                    names=[*keep, "n_tokens"],
                )

    src = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint"
    return src.mapInArrow(run, schema)


_batch: dict[tuple[str, str], BatchEncoder] = {}


def _worker_encoder(vocabulary: str, tokenizers: str) -> BatchEncoder:
    key = (vocabulary, tokenizers)
    if key not in _batch:
        _batch[key] = BatchEncoder(vocabulary, tokenizers)
    return _batch[key]
