"""Retrieval: prefix full text with BM25, explore ranking, vector top-k, work memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import PropertyGraph
from weftgraph.operators.graph_algos import degrees
from weftgraph.session import written

K1, B = 1.2, 0.75
# Letters with marks and the letters they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"
# Words that a question's ranking leaves out, and words that stand in every question.
STOP_WORDS = ("how", "what", "where", "which", "does", "work", "from", "this", "that", "with", "into", "code", "flow")
NOISE = frozenset("the a an is are was were how what why does do did in of to and or for this that it on with".split())


def folded(text):
    return F.translate(F.lower(text), MARKED, FOLDED)


def tokens(text):
    """Maximal runs of letters and digits, lower-cased, marks folded; _ separates."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame) -> DataFrame:
    """(id, pos, token) of docs(id, name, description): the name's tokens, then the description's, a gap between them."""
    n = F.coalesce(tokens(F.col("name")), F.array().cast("array<string>"))
    t = F.coalesce(tokens(F.col("description")), F.array().cast("array<string>"))
    both = F.concat(F.transform(n, lambda x, i: F.struct(i.alias("pos"), x.alias("token"))), F.transform(t, lambda x, i: F.struct((i + F.size(n) + 1).alias("pos"), x.alias("token"))))
    return docs.select("id", F.explode(both).alias("p")).select("id", F.col("p.pos").alias("pos"), F.col("p.token").alias("token"))


def idf(n_docs, n_hits):
    """Robertson's, floored where a token is in more than half of the documents."""
    v = F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5))
    return F.when(v > 0, v).otherwise(1e-6)


def search(docs: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, id, score, rank): top ``limit`` of each queries(query_id, text) as a phrase whose last token may be a prefix.

    BM25 over the phrase's hits; ties by id. Queries without a token have no hits. A phrase is met whole: runs of as many
    tokens as queries have, by what stands before the last token and by the prefixes of that one, first among the distinct
    runs; so the work follows the hits, not those of the last token alone. Joins with tables of the documents are merged.
    """
    n, t = (F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in ("name", "description"))
    words = written(docs.select("id", n.alias("n"), t.alias("t")), "words")  # read five times below
    q = queries.select("query_id", tokens(F.col("text")).alias("t")).where("size(t) > 0")
    q = q.select("query_id", F.size("t").alias("k"), F.array_join(F.slice("t", F.lit(1), F.size("t") - 1), " ").alias("lead"), F.element_at("t", -1).alias("prefix"))
    q = written(q, "asked")
    part = words.select("id", F.explode(F.array("n", "t")).alias("w")).join(F.broadcast(q.select("k").distinct()), F.size("w") >= F.col("k"))
    run = part.select("id", "k", F.explode(F.expr("transform(sequence(0, size(w) - k), i -> slice(w, i + 1, k))")).alias("r"))
    runs = run.select("id", "k", F.array_join(F.slice("r", F.lit(1), F.col("k") - 1), " ").alias("lead"), F.element_at("r", -1).alias("last"))
    runs = written(runs.join(q.select("k", "lead").distinct().hint("merge"), ["k", "lead"], "left_semi").groupBy("id", "k", "lead", "last").agg(F.count(F.lit(1)).alias("tf")), "runs")
    vocabulary = runs.select("k", "lead", "last").distinct()
    grown = vocabulary.select("k", "lead", "last", F.explode(F.expr("transform(sequence(1, length(last)), i -> substring(last, 1, i))")).alias("prefix"))
    asked = grown.join(q.hint("merge"), ["k", "lead", "prefix"]).select("query_id", "k", "lead", "last")
    phrase = asked.join(runs.hint("merge"), ["k", "lead", "last"]).select("query_id", "id", "tf")
    tf = phrase.groupBy("query_id", "id").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("query_id").agg(F.count(F.lit(1)).alias("df"))
    length = words.select("id", (F.size("n") + F.size("t")).cast("bigint").alias("len")).groupBy("id").agg(F.sum("len").alias("len"))
    # documents without a token count, with length 0
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    n_tokens = words.agg(F.sum(F.size("n") + F.size("t")).alias("n"))
    s = tf.join(df.hint("merge"), "query_id").join(length.hint("merge"), "id").withColumn("n_docs", n_docs.scalar()).withColumn("avg", n_tokens.scalar() / F.col("n_docs"))
    score = idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return s.select("query_id", "id", F.round(score, 9).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def explore(g: PropertyGraph, queries: DataFrame, semantic: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(query_id, id, score, rank) of queries(query_id, text).

    An exact name wins outright. Otherwise every token (lower case, longer than two bytes, no stop word) brings the best
    forty nodes of the full-text search: 20 points where it is the name, 10 where the name holds it, 3 for the rest; semantic(query_id, id,
    rank), if given, adds 1200 div (60 + rank); up to ten points come from the degree of a node that has any. Without a
    usable token the whole text is searched as one phrase. Ties by name, then id.
    """
    docs = g.nodes.select("id", "name", "description")
    exact = queries.join(g.nodes.select(F.col("name").alias("text"), "id"), "text").select("query_id", "id", F.lit(1000).alias("points"))
    open_ = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda t: (F.octet_length(t) > 2) & ~t.isin(*STOP_WORDS)))
    per = open_.select("query_id", F.explode(words).alias("token"))
    asked = per.select("token").distinct().select(F.col("token").alias("query_id"), F.col("token").alias("text"))
    hit = search(docs, asked, 40).select(F.col("query_id").alias("token"), "id")
    named = per.join(hit.hint("merge"), "token").join(g.nodes.select("id", F.lower("name").alias("low")).hint("merge"), "id")
    points = F.when(F.col("low") == F.col("token"), 20).when(F.col("low").contains(F.col("token")), 10).otherwise(3)
    found = named.select("query_id", "id", points.alias("points"))
    rest = open_.join(per.select("query_id").distinct(), "query_id", "left_anti")
    phrase = search(docs, rest, 20).select("query_id", "id", F.lit(3).alias("points"))
    all_ = exact.unionByName(found).unionByName(phrase)
    if semantic is not None:
        all_ = all_.unionByName(semantic.select("query_id", "id", F.expr("cast(1200 div (60 + rank) as int)").alias("points")))
    total = all_.groupBy("query_id", "id").agg(F.sum("points").alias("points")).join(degrees(g).select("id", "degree").hint("merge"), "id", "left")
    total = total.withColumn("score", F.col("points") + F.least(F.coalesce("degree", F.lit(0)), F.lit(10))).join(g.nodes.select("id", "name").hint("merge"), "id")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "name", "id")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "id", "name", "score", "rank")


def cards(g: PropertyGraph, hits: DataFrame, files: DataFrame) -> DataFrame:
    """(id, name, file_path, source, callers, callees): the lines of a symbol's source and who it calls and is called by."""
    n = hits.select("id").distinct().join(g.nodes, "id")
    text = files.where("text is not null").dropDuplicates(["repo", "file_path"]).select("repo", "file_path", F.split("text", r"\r?\n").alias("lines"))
    length = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    source = F.array_join(F.slice("lines", F.greatest("start_line", F.lit(1)), length), "\n")
    calls = g.edges.where("kind = 'calls'")
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("callees"))
    got = n.join(text, ["repo", "file_path"], "left").select("id", "name", "file_path", source.alias("source"))
    return got.join(into, "id", "left").join(out, "id", "left").fillna(0, ["callers", "callees"])


def embedding_text(g: PropertyGraph) -> DataFrame:
    """What a model would embed of each node; vectors come from the caller."""
    return g.nodes.select("id", F.concat_ws(" ", F.lit("passage:"), "kind", "name", "description").alias("text"))


def semantic_top(vectors: DataFrame, queries: DataFrame, k: int = 40, block: int = 512) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of vectors(id, vector) for each queries(query_id, vector) by cosine, exactly.

    Queries go out in blocks of at most ``block``; a task keeps k rows per query of the block and only these are ranked
    across tasks. Vectors of another length and of norm 0 score 0, null vectors are left out; ties by id.
    """
    spark = vectors.sparkSession
    out: DataFrame | None = None
    rows: list = []
    pending = queries.where("vector is not null").select("query_id", "vector").toLocalIterator(prefetchPartitions=True)

    def ranked(chunk: list) -> DataFrame:
        dims = sorted({len(r["vector"]) for r in chunk})
        state = spark.sparkContext.broadcast({n: ([r["query_id"] for r in chunk if len(r["vector"]) == n], np.array([r["vector"] for r in chunk if len(r["vector"]) == n], np.float64)) for n in dims})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                ids = pdf["id"].to_numpy()
                size = pdf["vector"].map(len).to_numpy()
                for n, (qids, m) in state.value.items():
                    s = np.zeros((len(qids), len(ids)))
                    same = np.flatnonzero(size == n)
                    if len(same):
                        v = np.stack(pdf["vector"].to_numpy()[same]).astype(np.float64)
                        norms = np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
                        s[:, same] = np.divide(m @ v.T, norms, out=np.zeros_like(norms), where=norms > 0)
                    for q, row in zip(qids, np.round(s, 6)):
                        a, b = best.get(q, (np.zeros(0), np.zeros(0, ids.dtype)))
                        score, who = np.concatenate([a, row]), np.concatenate([b, ids])
                        keep = np.lexsort((who, -score))[:k]
                        best[q] = (score[keep], who[keep])
            for q, (score, who) in best.items():
                yield pd.DataFrame({"query_id": q, "id": who, "score": score})

        return vectors.where("vector is not null").select("id", "vector").mapInPandas(run, "query_id bigint, id bigint, score double")

    for r in pending:
        rows.append(r)
        if len(rows) == block:
            part, rows = ranked(rows), []
            out = part if out is None else out.unionByName(part)
    if rows or out is None:
        part = ranked(rows)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# work memory


def entries(raw: DataFrame) -> DataFrame:
    """Distinct entries with a decoded outcome; repeats of an id keep the row that was received first."""
    w = Window.partitionBy("id").orderBy(F.col("received_at").asc_nulls_last(), F.col("recorded").asc_nulls_last())
    one = raw.where("id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return one.withColumn("outcome", schema.outcome(F.col("outcome")))


def save(store: DataFrame, new: DataFrame) -> DataFrame:
    """Append; ids continue after the greatest."""
    top = store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    w = Window.orderBy("recorded", "question")  # what one call saves
    return store.unionByName(new.withColumn("id", (top.scalar() + F.row_number().over(w)).cast("bigint")).select(*store.columns))


def correct(store: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(id, outcome, correction): the new outcome, and the new correction where there is one; unknown ids are an error."""
    unknown = changes.join(store.select("id"), "id", "left_anti").limit(1).collect()
    if unknown:
        raise KeyError(f"no entry {unknown[0]['id']}")
    c = changes.select("id", F.col("outcome").alias("_o"), F.col("correction").alias("_c"))
    j = store.join(c, "id", "left")
    return j.withColumn("outcome", F.coalesce("_o", "outcome")).withColumn("correction", F.coalesce("_c", "correction")).select(*store.columns)


def word_set(text):
    """Sorted distinct words longer than two bytes, without noise."""
    w = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: (F.octet_length(t) > 2) & ~t.isin(*sorted(NOISE)))
    return F.array_sort(F.array_distinct(w))


def recall(store: DataFrame, g: PropertyGraph, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id, overlap, outcome, present, missing, stale, rank) for queries(query_id, repo, text), within the repository.

    overlap counts shared words, found through the words, so only entries that share one are met; a query without words recalls all of its repository's. present
    and missing count an entry's symbols that the graph has or hasn't; it is stale with none present or any missing.
    Order: overlap, then wrong before worked before open, then the latest, then the id.
    """
    e = store.select("id", "repo", word_set(F.col("question")).alias("words"), "outcome", "recorded", "nodes")
    q = queries.select("query_id", "repo", word_set(F.col("text")).alias("words"))
    qw, ew = q.select("query_id", "repo", F.explode("words").alias("w")), e.select("id", "repo", F.explode("words").alias("w"))
    shared = qw.join(ew, ["repo", "w"]).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("overlap"))
    empty = q.where("size(words) = 0").join(e, "repo").select("query_id", "id", F.lit(0).cast("bigint").alias("overlap"))
    names = g.nodes.select("repo", "name").distinct().withColumn("there", F.lit(1))
    sym = e.select("id", "repo", F.explode(F.array_distinct("nodes")).alias("name")).join(names, ["repo", "name"], "left")
    state = sym.groupBy("id").agg(F.count("there").alias("present"), F.count_if(F.col("there").isNull()).alias("missing"))
    got = shared.unionByName(empty).join(e.select("id", "outcome", "recorded"), "id").join(state, "id", "left").fillna(0, ["present", "missing"])
    weight = F.when(F.col("outcome") == "wrong", 0).when(F.col("outcome") == "worked", 1).otherwise(2)
    w = Window.partitionBy("query_id").orderBy(F.col("overlap").desc(), weight, F.col("recorded").desc_nulls_last(), "id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(
        "query_id", "id", "overlap", "outcome", "present", "missing", ((F.col("present") == 0) | (F.col("missing") > 0)).alias("stale"), "rank"
    )


def lessons(store: DataFrame, g: PropertyGraph, least: int = 2) -> DataFrame:
    """(repo, symbol, entries, worked, wrong, supported): symbols of at least ``least`` entries; supported is their number where the graph has the symbol, else 0."""
    e = store.select("id", "repo", "outcome", F.explode(F.array_distinct("nodes")).alias("symbol")).where("symbol is not null")
    s = e.groupBy("repo", "symbol").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("outcome") == "worked").alias("worked"), F.count_if(F.col("outcome") == "wrong").alias("wrong")).where(F.col("entries") >= least)
    names = g.nodes.select("repo", F.col("name").alias("symbol")).distinct().withColumn("there", F.lit(1))
    return s.join(names, ["repo", "symbol"], "left").select("repo", "symbol", "entries", "worked", "wrong", F.when(F.col("there") == 1, F.col("entries")).otherwise(F.lit(0)).alias("supported"))
