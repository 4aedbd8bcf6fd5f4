"""Mixing sources to target weights: packed blocks, multinomial shard counts, pseudorandom index permutations.

Each source's documents are one stream of tokens, cut into blocks of a fixed length. The output is a number of shards
of slots; the source counts of a shard are a multinomial draw, given that all shards together hit the targets (and so
the repeat caps) exactly. The draw is a binary tree over the shards: at a node each source's slots fall to the left or
the right by a binomial draw seeded with the node, accepted so that the left side has its size (``split``); any task
finds its shard's counts, and how many slots of each source lie before it, in log2(shards) steps without a word from
any other task. The k-th slot of a source takes block perm(k mod n) of its epoch k div n, where perm is a keyed Feistel
permutation that differs from epoch to epoch. Blocks are joined by (source, index), always by a shuffle: both sides
grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import tokenize
from weftgraph.session import written

BLOCK_TOKENS = 512
SLOTS_PER_SHARD = 256
SEED = 20240229
#: Parts of a source's stream whose sizes are summed separately, so that no task orders a whole source: at least so many,
#: and one for so many documents of the table.
PARTS = 512
DOCS_PER_PART = 100_000


def source_name(col: str) -> F.Column:
    """Sources compare trimmed, in lower case, with _ for blanks and -."""
    return F.regexp_replace(F.lower(F.trim(F.col(col))), r"[\s\-]+", "_")


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str = tokenize.VOCABULARY, tokenizers: str = tokenize.TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of the target sources; null and empty texts have no tokens and take no part."""
    wanted = targets.select(source_name("source").alias("source")).where("source is not null").distinct()
    docs = documents.select("doc_id", source_name("source").alias("source"), "text").where("text is not null and text <> '' and doc_id is not null")
    kept = docs.join(wanted, "source", "left_semi")
    return written(tokenize.count_tokens(kept, ["doc_id", "source"], vocabulary=vocabulary, tokenizers=tokenizers).where("n_tokens > 0"), "sized")


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, first): where each document's tokens begin in its source's stream.

    Two levels of prefix sums: over the documents of a part, and over the parts of a source, whose number grows with the
    table. A part is a class of hashes of ids; the hash also orders the stream.
    """
    n_parts = max(PARTS, -(-docs.count() // DOCS_PER_PART))  # of a written table: read from its footers
    h = docs.withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod("h", F.lit(n_parts)).cast("int"))
    before = Window.partitionBy("source", "part").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    inner = h.withColumn("inner", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = h.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("outer"))
    return inner.join(parts, ["source", "part"]).select("doc_id", "source", "n_tokens", (F.col("outer") + F.col("inner")).alias("first"))


def fragments(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, block, at, doc_id, start, n): which tokens of which document lie where in which block; very long documents span many."""
    b = F.lit(block_tokens).cast("bigint")
    spans = placed(docs).select("*", F.explode(F.sequence(F.floor(F.col("first") / b), F.floor((F.col("first") + F.col("n_tokens") - 1) / b))).alias("block"))
    start = F.greatest(F.col("block") * b - F.col("first"), F.lit(0))
    end = F.least((F.col("block") + 1) * b - F.col("first"), F.col("n_tokens"))
    at = F.greatest(F.col("first") - F.col("block") * b, F.lit(0))
    return spans.select("source", "block", at.alias("at"), "doc_id", start.alias("start"), (end - start).alias("n"))


def plan(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None) -> pd.DataFrame:
    """One row per target source, on the driver: source, target_share, share, max_repeats, n_tokens, n_blocks, slots.

    Shares are scaled to sum to 1 over the sources that have tokens. Without ``total_tokens`` the mix is as large as
    the repeats allow with all shares met: the least of max_repeats x tokens / share. A larger total is filled as far as
    the caps allow, what a capped source lacks going to the others by share. Repeated target rows of a source add up
    their shares and keep the least cap; null or negative shares and caps are none.
    """
    t = targets.select(source_name("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("cap"))
    t = t.where("source is not null").groupBy("source").agg(F.sum("w").alias("target_share"), F.min("cap").alias("max_repeats"))
    n = docs.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    p = t.join(n, "source", "left").orderBy("source").toPandas()  # as many rows as targets
    p["n_tokens"] = p["n_tokens"].fillna(0).astype("int64")
    p["n_blocks"] = -(-p["n_tokens"] // block_tokens)
    usable = (p["n_tokens"] > 0) & (p["max_repeats"] > 0) & (p["target_share"] > 0)
    w = p["target_share"].where(usable, 0.0)
    p["share"] = w / w.sum() if w.sum() > 0 else 0.0
    most = p["n_blocks"] * p["max_repeats"]
    limit = (p["max_repeats"] * p["n_tokens"])[usable] / p["share"][usable]
    if not len(limit):
        p["slots"] = 0
        return p
    want = float(limit.min() if total_tokens is None else total_tokens) / block_tokens
    slots = np.zeros(len(p))
    open_ = usable.to_numpy().copy()
    while open_.any() and want - slots.sum() > 1e-6:
        add = np.where(open_, p["share"], 0.0)
        new = np.minimum(slots + (want - slots.sum()) * add / add.sum(), most)
        if np.allclose(new, slots):
            break
        slots = new
        open_ &= slots < most - 1e-9
    whole = np.floor(slots + 1e-9).astype(np.int64)
    short = int(round(min(want, slots.sum()))) - int(whole.sum())
    for k in np.argsort(-(slots - whole), kind="stable"):
        if short > 0 and usable[k] and whole[k] < most[k]:
            whole[k] += 1
            short -= 1
    p["slots"] = whole
    return p


def _log_factorials(a: int, b: int) -> float:
    """log(a! / b!) without cancellation, for counts of any size."""
    if max(a, b) < 1000:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    z, d = b + 1.0, float(a - b)
    return d * math.log(z) + (z + d - 0.5) * math.log1p(d / z) - d + (1 / (z + d) - 1 / z) / 12


def split(here: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's slots are among the ``left`` slots of a node's left side.

    Each source draws Binomial(its slots, left / all slots); the largest source takes what is missing, and the draw is
    kept with the probability of that number against its likeliest one. So the kept counts are exactly the independent
    binomials, that is the multinomial draw, given their sum. Counts are 64-bit; no size has another rule.
    """
    total = int(here.sum())
    if left <= 0 or left >= total:
        return here.copy() if left >= total else np.zeros_like(here)
    p, last = left / total, int(here.argmax())
    n = int(here[last])
    top = min(n, int((n + 1) * p))
    odds = math.log(p) - math.log1p(-p)
    while True:
        x = rng.binomial(here, p)
        m = left - int(x.sum()) + int(x[last])
        if 0 <= m <= n and math.log(1.0 - rng.random()) <= (m - top) * odds - _log_factorials(m, top) - _log_factorials(n - m, n - top):
            x[last] = m
            return x


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int = SEED, known: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before the shard, slots of each source in it); all shards but the last have SLOTS_PER_SHARD.

    ``known`` keeps the splits of the nodes passed, for the next shard of the same task.
    """
    before, here = np.zeros(len(slots), np.int64), np.asarray(slots, np.int64)
    low, high, node = 0, shards, 1
    while high - low > 1:
        mid = (low + high + 1) // 2
        take = known.get(node) if known is not None else None
        if take is None:
            take = split(here, min(int(here.sum()), (mid - low) * SLOTS_PER_SHARD), np.random.default_rng([seed, node]))
            if known is not None:
                if len(known) > 10_000:
                    known.clear()
                known[node] = take
        if shard < mid:
            here, high, node = take, mid, 2 * node
        else:
            before, here, low, node = before + take, here - take, mid, 2 * node + 1
    return before, here


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1: four Feistel rounds over the next even number of bits, walked until inside."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64))
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        l, r, k, h, m = x[todo] >> half[todo], x[todo] & mask[todo], key[todo].astype(np.uint64), half[todo], mask[todo]
        for rnd in range(4):
            f = (r + k + np.uint64(0x9E3779B97F4A7C15 * (rnd + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            l, r = r, l ^ ((f ^ (f >> np.uint64(29))) & m)
        x[todo] = (l << h) | r
        todo &= x >= n.astype(np.uint64)
    return x.astype(np.int64)


def slots(spark, p: pd.DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, epoch, block) of every output slot, made by the tasks from the shard's number alone."""
    names, totals, blocks = p["source"].tolist(), p["slots"].to_numpy(np.int64), p["n_blocks"].to_numpy(np.int64)
    shards = int(-(-totals.sum() // SLOTS_PER_SHARD))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for pdf in batches:
            for shard in pdf["id"].tolist():
                before, here = shard_counts(totals, shards, shard, seed, known)
                of = np.repeat(np.arange(len(names)), here)
                k = np.concatenate([np.arange(b, b + c) for b, c in zip(before, here)])
                n = blocks[of]
                epoch = k // n
                block = permute(k % n, n, of * 1_000_003 + epoch * 7_919 + seed)
                slot = np.random.default_rng([seed, 7, shard]).permutation(len(of))
                yield pd.DataFrame({"shard": shard, "slot": slot, "source": [names[i] for i in of], "epoch": epoch, "block": block})

    schema = "shard bigint, slot bigint, source string, epoch bigint, block bigint"
    ids = spark.range(0, shards, 1, max(1, min(shards // 64, 4096)))
    return ids.mapInPandas(run, schema)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(shard, slot, source, epoch, block, n_tokens, parts): the mixed corpus, one row a slot.

    parts are the fragments (at, doc_id, start, n) of the block, in the order of the stream; with the tokens of
    ``encode_corpus`` they give the block's ids. No token is used more than max_repeats times.
    """
    docs = sized(documents, targets)
    p = plan(docs, targets, total_tokens=total_tokens)
    # a block holds at most BLOCK_TOKENS fragments, so its list is bounded
    blocks = fragments(docs).groupBy("source", "block").agg(
        F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "doc_id", "start", "n"))).alias("parts")
    )
    # the planner takes a shard number for the size of its slots, so the kind of the join is not left to it
    return slots(documents.sparkSession, p).hint("merge").join(blocks, ["source", "block"]).select("shard", "slot", "source", "epoch", "block", "n_tokens", "parts")


def shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, share, max_repeats, n_docs, n_tokens, n_slots, mixed_tokens, actual_share, repeats) per target.

    share is the target scaled to the sources that have documents; repeats is how often the source's tokens were used
    on average. A source without documents has nothing mixed.
    """
    docs = sized(documents, targets)
    p = plan(docs, targets, total_tokens=total_tokens)
    spark = documents.sparkSession
    blocks = fragments(docs).groupBy("source", "block").agg(F.sum("n").alias("n"))
    used = slots(spark, p).groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    got = used.hint("merge").join(blocks, ["source", "block"]).groupBy("source").agg(F.sum("times").alias("n_slots"), F.sum(F.col("times") * F.col("n")).alias("mixed_tokens"), F.max("times").alias("most_repeats"))
    n_docs = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    base = spark.createDataFrame(p[["source", "target_share", "share", "max_repeats", "n_tokens"]], "source string, target_share double, share double, max_repeats int, n_tokens bigint")
    whole = Window.partitionBy()  # over as many rows as there are targets
    r = base.join(n_docs, "source", "left").join(got, "source", "left").fillna(0)
    return r.withColumn("actual_share", F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(whole), F.lit(0))).withColumn("repeats", F.col("mixed_tokens") / F.nullif("n_tokens", F.lit(0)))
