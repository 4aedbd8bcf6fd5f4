"""Language posteriors by naive Bayes over hashed character n-grams, trained on a bounded sample of labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.prose import paragraphs

LANGUAGES = ("de", "en", "es", "fr", "pt", "zh")
#: Labelled documents that are learned from, of each language at most; the sample is the one of the least hashes of ids.
SAMPLE_PER_LANGUAGE = 400
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each between two blanks, and where each text begins and ends."""
    padded = [f" {t.lower()} " for t in texts]
    ends = np.cumsum([len(p) for p in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, ends


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + codes[k : k + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int64)


class NaiveBayes:
    """log P(gram | language) of each order, in one table of (order, bucket, language)."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @staticmethod
    def counts(texts: list[str], labels: list[str]) -> np.ndarray:
        """Smoothed counts of the grams of labelled texts, (order, bucket, language)."""
        counts = np.full((len(ORDERS), BUCKETS, len(LANGUAGES)), 0.05)
        for k, lang in enumerate(LANGUAGES):
            own = [t for t, at in zip(texts, labels) if at == lang]
            if own:
                codes, _ = _codes(own)
                for i, n in enumerate(ORDERS):
                    counts[i, :, k] += np.bincount(_grams(codes, n), minlength=BUCKETS)
        return counts

    @classmethod
    def of(cls, counts: np.ndarray) -> NaiveBayes:
        return cls(np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> NaiveBayes:
        return cls.of(cls.counts(texts, labels))

    def scores(self, texts: list[str]) -> np.ndarray:
        """(text, language): the mean over the orders of the summed log likelihoods; flat for texts without letters."""
        if not texts:
            return np.zeros((0, len(LANGUAGES)))
        codes, ends = _codes(texts)
        starts = np.concatenate([[0], ends[:-1]])
        total = np.zeros((len(texts), len(LANGUAGES)))
        for i, n in enumerate(ORDERS):
            # a gram belongs to the text that it begins in; the last n - 1 reach into the next text and are left out
            per = self.table[i][_grams(codes, n)]
            sums = np.concatenate([np.zeros((1, per.shape[1])), np.cumsum(per, axis=0, dtype=np.float64)])
            stop = np.minimum(np.maximum(starts, ends - n + 1), len(per))
            total += sums[stop] - sums[np.minimum(starts, len(per))]
        return total / len(ORDERS)


def add_pairs(table: np.ndarray, model: NaiveBayes, pairs: list[tuple[str, str]], sure: float = 8.0) -> None:
    """Add to table (order, bucket, language) the grams of the pairs that the model is sure of.

    Both sides of a pair are taken to be in one language; it is sure if it wins by ``sure`` nats over both together.
    The few pairs of mixed language are noise. Grams that reach into another text are left out, so the sum doesn't
    depend on which pairs come together.
    """
    if not pairs:
        return
    both = model.scores([a for a, _ in pairs]) + model.scores([b for _, b in pairs])
    order = np.sort(both, axis=1)
    best = both.argmax(axis=1)
    margin = order[:, -1] - order[:, -2]
    for k in range(len(LANGUAGES)):
        own = [t for pair, at, m in zip(pairs, best, margin) if at == k and m > sure for t in pair]
        if not own:
            continue
        codes, ends = _codes(own)
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        for i, n in enumerate(ORDERS):
            grams = _grams(codes, n)
            whole = text[: len(grams)] == text[n - 1 : n - 1 + len(grams)]
            table[i, :, k] += np.bincount(grams[whole], minlength=BUCKETS)


def pair_counts(pairs: DataFrame, model: NaiveBayes) -> np.ndarray:
    """(order, bucket, language): the grams of all pairs(question, text) that the model is sure of, summed over the tasks.

    A task sends one row per cell of the table that it counted in; the driver gets the summed cells, as many as the table has at most.
    """
    first = pairs.sparkSession.sparkContext.broadcast(model.table)
    shape = model.table.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, nb = np.zeros(shape, np.int64), NaiveBayes(first.value)
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for a in range(0, len(rows), 1000):
                add_pairs(table, nb, rows[a : a + 1000])
        cells = np.flatnonzero(table)
        for a in range(0, len(cells), 100_000):
            part = cells[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(table.ravel()[part])], ["cell", "n"])

    got = pairs.select("question", "text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(shape)
    out.ravel()[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def train(documents: DataFrame, pairs: DataFrame | None = None) -> NaiveBayes:
    """A model of documents.lang over the documents' prose, from at most SAMPLE_PER_LANGUAGE labelled rows of each language.

    Labels are read up to their first two letters, in any case; null, unknown and wrong ones are noise that the counts outweigh.
    With pairs(question, text) the model is fitted once more with all pairs that the first fit is sure of; this teaches
    the short, stereotyped wording of prompts.
    """
    label = F.lower(F.substring(F.trim("lang"), 1, 2))
    rank = Window.partitionBy("label").orderBy("h", "doc_id")
    rows = (
        documents.where("text is not null and lang is not null")
        .select("doc_id", label.alias("label"), F.xxhash64("doc_id").alias("h"))
        .where(F.col("label").isin(*LANGUAGES))
        .withColumn("r", F.row_number().over(rank))
        .where(F.col("r") <= SAMPLE_PER_LANGUAGE)
        .select("doc_id", "label")
    )
    got = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id").collect()
    texts = ["\n".join(paragraphs(r["text"])) for r in got]
    counts = NaiveBayes.counts(texts, [r["label"] for r in got])
    first = NaiveBayes.of(counts)
    return first if pairs is None else NaiveBayes.of(counts + pair_counts(pairs, first))
