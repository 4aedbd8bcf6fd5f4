"""Reading level by harmonic propagation on the graph of documents and their words.

Documents are joined to the words and word pairs of their prose. Graded documents are clamped to their grade; the
difficulty of a word is the mean over its documents, the difficulty of a document the mean over its words, weighted by
rarity, and both are repeated: the distributed harmonic iterations. Word nodes are hashed into a table of fixed size,
so what each iteration sends out is bounded whatever the corpus; partial sums per word are combined map-side. The
document side is written once, as packed arrays, and every iteration is one scan of it with one small exchange.

Scores of repeated averaging draw together, so the cuts between the levels are taken where the graded documents'
own, unclamped scores lie: half way between the medians of neighbouring levels. Wrong grades have no hold on medians.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.prose import sentences
from weftgraph.session import written

BITS = 18
ITERATIONS = 5
LEAST_WORDS = 40
EDGES = ".,;:!?()\"“”«»¿¡…'’-–—*_"
NAME = re.compile(r"[`_/\\\d]|[a-z][A-Z]|\.\w")
#: Han, kana and Hangul: texts mainly in them are of none of the languages that have levels here.
WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def word_hash(word: str) -> int:
    """Names, paths, numbers and code are all one word; punctuation at its ends is no part of a word."""
    if NAME.search(word):
        return 0x5BD1E995
    h = 0xCBF29CE484222325
    for b in word.lower().strip(EDGES).encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h | 1


class Features:
    """Packs the distinct hashed words and word pairs of each text; remembers the hashes of words, within a bound."""

    def __init__(self, bound: int = 500_000):
        self.known: dict[str, int] = {}
        self.bound = bound

    def of(self, texts: list[str | None]) -> list[tuple[int, bytes] | None]:
        words: list[str] = []
        spans: list[tuple[int, int]] = []
        for t in texts:
            a = len(words)
            if t and len(t) > 2 * LEAST_WORDS:
                got = sentences(t)
                if got:
                    prose = "\n".join(got)
                    if prose.isascii() or len(WIDE.findall(prose)) * 4 < len(prose):
                        words += prose.split()
            spans.append((a, len(words)))
        if len(self.known) > self.bound:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = word_hash(w)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:] if len(h) > 1 else h[:0]
        mix = lambda x: ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
        one, two = mix(h).astype(np.int32), mix(pair).astype(np.int32)
        out: list[tuple[int, bytes] | None] = []
        for a, b in spans:
            n = b - a
            out.append((n, np.unique(np.concatenate([one[a:b], two[a : b - 1]])).tobytes()) if n >= LEAST_WORDS else None)
        return out


_features: list[Features] = []


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, feats binary) of the documents with at least LEAST_WORDS words in full sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _features:
            _features.append(Features())
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            size = a = 0
            for b in range(1, len(ids) + 1):
                size += len(texts[b - 1] or "")
                if size > 4_000_000 or b == len(ids):
                    got = [(i, *f) for i, f in zip(ids[a:b], _features[0].of(texts[a:b])) if f]
                    cols = list(zip(*got)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["doc_id", "n_words", "feats"])
                    size, a = 0, b

    return docs.where("text is not null and doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words int, feats binary")


def _batches(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All features of a batch after one another, and where each document's begin; no document is without any."""
    raw = batch.column(batch.schema.get_field_index("feats")).to_pylist()
    lens = np.array([len(r) // 4 for r in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.int32), np.concatenate([[0], np.cumsum(lens)])


def propagate(packed: DataFrame, grades: DataFrame, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(difficulty, weight) of the 2^BITS word nodes after the iterations."""
    spark = packed.sparkSession
    graded = packed.join(grades, "doc_id", "left").select("feats", F.col("grade").cast("double").alias("grade"))
    graded = written(graded, "graded")
    start = graded.agg(F.avg("grade")).first()[0]
    prior = 2.0 if start is None else float(start)
    size = 1 << BITS
    value, weight = np.full(size, prior), np.ones(size)

    def step(value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = spark.sparkContext.broadcast((value, weight))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, w = state.value
            vw = v * w
            total, seen = np.zeros(size), np.zeros(size)
            for batch in batches:
                if not batch.num_rows:
                    continue
                feats, at = _batches(batch)
                grade = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                own = np.add.reduceat(vw[feats], at[:-1]) / np.maximum(np.add.reduceat(w[feats], at[:-1]), 1e-12)
                own = np.where(np.isnan(grade), own, grade)
                total += np.bincount(feats, np.repeat(own, np.diff(at)), size)
                seen += np.bincount(feats, minlength=size)
            hit = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit]), pa.array(seen[hit])], names=["node", "total", "seen"])

        sums = graded.mapInArrow(run, "node int, total double, seen double").groupBy("node").agg(F.sum("total"), F.sum("seen"))
        got = sums.toArrow()  # at most 2^BITS rows
        node = got.column(0).to_numpy()
        new, seen = np.full(size, prior), np.zeros(size)
        seen[node] = got.column(2).to_numpy()
        new[node] = got.column(1).to_numpy() / seen[node]
        state.unpersist()
        return new, seen

    n_docs = 0
    for _ in range(iterations):
        value, seen = step(value, weight)
        n_docs = max(n_docs, int(seen.max(initial=0)))
        weight = np.where(seen > 0, np.log((n_docs + 1) / np.maximum(seen, 1)) + 0.05, 0.0)
    return value, weight


def scores(packed: DataFrame, value: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(doc_id, n_words, score): the mean difficulty of the document's word nodes; grades don't enter."""
    state = packed.sparkSession.sparkContext.broadcast((value * weight, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vw, w = state.value
        for batch in batches:
            if batch.num_rows:
                feats, at = _batches(batch)
                s = np.add.reduceat(vw[feats], at[:-1]) / np.maximum(np.add.reduceat(w[feats], at[:-1]), 1e-12)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["doc_id", "n_words", "score"])

    return packed.select("doc_id", "n_words", "feats").mapInArrow(run, "doc_id bigint, n_words int, score double")


def cuts(medians: dict[int, float]) -> tuple[float, float]:
    """The scores from which levels 2 and 3 begin; a level without grades is put as far off as its neighbour, or one grade."""
    m1, m2, m3 = (medians.get(k) for k in (1, 2, 3))
    if m2 is None:
        m2 = (m1 + m3) / 2 if m1 is not None and m3 is not None else m1 + 1 if m1 is not None else m3 - 1 if m3 is not None else 2.0
    if m1 is None:
        m1 = 2 * m2 - m3 if m3 is not None else m2 - 1
    if m3 is None:
        m3 = 2 * m2 - m1
    return (m1 + m2) / 2, (m2 + m3) / 2


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, level bigint, score, n_words) of each document with enough prose; level 1, 2 or 3.

    Several grades of a document count as their mean; null grades and those of unknown documents have no effect. Null,
    empty, short and code-only texts have no level. Repeated rows of a document stay repeated. Without any grade all
    are level 2.
    """
    packed = written(pack(documents), "packed")
    grades = labels.where("level between 1 and 3 and doc_id is not null").groupBy("doc_id").agg(F.avg("level").alias("grade"))
    value, weight = propagate(packed, grades)
    score = written(scores(packed, value, weight), "scores")
    of = score.join(grades, "doc_id").groupBy(F.round("grade").cast("int").alias("level")).agg(F.percentile_approx("score", 0.5, 10000).alias("m"))
    low, high = cuts({r["level"]: r["m"] for r in of.collect()})
    level = F.lit(1) + (F.col("score") >= low).cast("int") + (F.col("score") >= high).cast("int")
    return score.select("doc_id", level.cast("bigint").alias("level"), "score", "n_words")
