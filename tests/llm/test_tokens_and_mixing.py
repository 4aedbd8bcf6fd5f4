"""Tokens: exact against two public libraries. Mixing: caps, shares, permutations, shard draws."""

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import mixing, tokenize

DOCS = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


ODD = [
    "", " ", "  \n\n x", "a\r\nb", "don't we'll I'VE", "x\u00a0y", "<|endoftext|> text", "naïve Ünïcode ﬁ ²³½ Ⅷ", "中文没有空格的一句话", "🧭🇧🇷👩‍💻", "\x1c\x1d a\x85b\u2028c", "e\u0301 \u200b", "=" * 300, " " * 500, "ab" * 3000, "١٢٣ 12345678901234567890", "\u3000全角\u3000", "__init__ snake_case camelCase", "\t\t\tif (x) { return; }\n",
]


def test_encoding_is_exact(spark, reference):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(100, None, "s"), (100, None, "s")]
    got = [(r["doc_id"], r["ids"]) for r in tokenize.encode_corpus(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got) == sorted([(i, reference(t)) for i, t in enumerate(ODD)] + [(100, []), (100, [])])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    flat, offsets = encoder.encode([text, "x"])
    assert flat[: offsets[1]].tolist() == want(text)
    assert b"".join(pieces[i] for i in flat[: offsets[1]]).decode() == text


from tokenizers import Tokenizer  # noqa: E402

_t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
_t.encode_special_tokens = True
want = lambda s: _t.encode(s, add_special_tokens=False).ids
encoder = tokenize.BatchEncoder(bound=50)
pieces = {i: b for b, i in tokenize.encoder().ids.items()}


def test_forgetting_words_changes_nothing():
    small, large = tokenize.BatchEncoder(bound=3), tokenize.BatchEncoder()
    for t in ODD * 2:
        assert small.encode([t])[0].tolist() == large.encode([t])[0].tolist()


def test_counts_agree(spark, reference):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(99, None, "s")]
    got = {r["doc_id"]: r["n_tokens"] for r in tokenize.count_tokens(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()}
    assert got == {**{i: len(reference(t)) for i, t in enumerate(ODD)}, 99: 0}


def test_empty_corpus_and_clashing_columns(spark):
    assert tokenize.encode_corpus(spark.createDataFrame([], DOCS)).collect() == []
    df = spark.createDataFrame([(1, "a", "s", [9])], DOCS + ", ids array<int>")
    assert [r["ids"] for r in tokenize.encode_corpus(df).collect()] == [[64]]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**9))
def test_permutations(n, key):
    p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
    assert sorted(p.tolist()) == list(range(n))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 900), min_size=1, max_size=5))
def test_shards_add_up(totals):
    t = np.array(totals)
    shards = int(-(-t.sum() // mixing.SLOTS_PER_SHARD))
    seen = np.zeros(len(t), np.int64)
    for s in range(shards):
        before, here = mixing.shard_counts(t, shards, s)
        assert (before == seen).all() and here.sum() == (mixing.SLOTS_PER_SHARD if s < shards - 1 else t.sum() - seen.sum())
        seen += here
    assert (seen == t).all()


def test_huge_totals_split_in_proportion():
    before, here = mixing.shard_counts(np.array([3 * 10**9, 10**9]), 4 * 10**9 // mixing.SLOTS_PER_SHARD, 12345)
    assert here.sum() == mixing.SLOTS_PER_SHARD and abs(before[0] / before.sum() - 0.75) < 0.01


def test_splits_are_multinomial_draws_given_their_sum():
    # brute force: independent binomials, kept only where they add up
    here, left = np.array([9, 5, 2, 0]), 7
    rng = np.random.default_rng(5)
    free = rng.binomial(here, left / here.sum(), size=(200_000, 4))
    want = free[free.sum(axis=1) == left]
    got = np.array([mixing.split(here, left, rng) for _ in range(20_000)])
    assert (got.sum(axis=1) == left).all() and (got <= here).all() and (got >= 0).all()
    assert np.allclose(got.mean(0), want.mean(0), atol=0.03) and np.allclose(np.cov(got.T), np.cov(want.T), atol=0.05)


def test_splits_know_no_greatest_size():
    here = np.array([3 * 10**15, 10**15, 7])
    got = np.array([mixing.split(here, 10**15, np.random.default_rng(k)) for k in range(400)])
    assert (got.sum(axis=1) == 10**15).all() and len(set(got[:, 1].tolist())) == 400
    # variance of the hypergeometric: n p q (N - n) / (N - 1)
    assert 0.85 < got[:, 1].std() / np.sqrt(10**15 * 0.25 * 0.75 * 0.75) < 1.15
    assert mixing.split(here, 0, np.random.default_rng(0)).sum() == 0 and (mixing.split(here, 10**17, np.random.default_rng(0)) == here).all()
    known = {}
    assert [(a.tolist(), b.tolist()) for a, b in (mixing.shard_counts(here, 10**13, s, known=known) for s in (5, 6, 10**12))] == [(a.tolist(), b.tolist()) for a, b in (mixing.shard_counts(here, 10**13, s) for s in (5, 6, 10**12))]


TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark):
    rows = [(i, "the graph of calls " * (5 + i % 40), "Repo-Docs " if i % 2 else "repo_docs") for i in range(200)]
    rows += [(1000 + i, "a short note " * 10, "wiki") for i in range(30)] + [(2000, "word " * 20000, "issues"), (2001, None, "issues"), (2002, "", "issues"), (2003, "unlisted", "other"), (2004, "x", None)]
    return spark.createDataFrame(rows, DOCS)


def test_mix_keeps_shares_caps_and_content(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([("repo_docs", 0.5, 2), ("WIKI", 0.1, 3), ("issues", 0.2, 4), ("talks", 0.2, 4)], TARGETS)
    report = {r["source"]: r.asDict() for r in mixing.shares(docs, targets).collect()}
    assert report["talks"]["mixed_tokens"] == 0 and abs(sum(r["share"] for r in report.values()) - 1) < 1e-9
    for r in report.values():
        assert abs((r["actual_share"] or 0) - r["share"]) < 0.06 and r["most_repeats"] <= r["max_repeats"]
    rows = mixing.mix(docs, targets).collect()
    used = {}
    for r in rows:
        assert sum(p["n"] for p in r["parts"]) == r["n_tokens"] <= mixing.BLOCK_TOKENS and [p["at"] for p in r["parts"]] == sorted(p["at"] for p in r["parts"])
        for p in r["parts"]:
            for k in range(p["start"], p["start"] + p["n"], 97):
                used[r["source"], p["doc_id"], k] = used.get((r["source"], p["doc_id"], k), 0) + 1
    caps = {"repo_docs": 2, "wiki": 3, "issues": 4}
    assert all(v <= caps[s] for (s, _, _), v in used.items())
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) and len({(r["source"], r["epoch"], r["block"]) for r in rows}) == len(rows)
    assert {tuple(r)[:5] for r in rows} == {tuple(r)[:5] for r in mixing.mix(docs, targets).collect()}


def test_blocks_cover_every_token_once(spark):
    docs = mixing.sized(corpus(spark), spark.createDataFrame([("repo_docs", 0.5, 2), ("issues", 0.5, 2)], TARGETS))
    got = mixing.fragments(docs, 100).toPandas()
    for (source, doc), g in got.groupby(["source", "doc_id"]):
        g = g.sort_values("start")
        assert g["start"].iloc[0] == 0 and (g["start"].iloc[1:].to_numpy() == (g["start"] + g["n"]).iloc[:-1].to_numpy()).all()
    per = got.groupby(["source", "block"])["n"].sum().reset_index()
    assert all((g.sort_values("block")["n"].iloc[:-1] == 100).all() for _, g in per.groupby("source"))
    assert int(got["n"].sum()) == docs.agg({"n_tokens": "sum"}).first()[0]


def test_larger_totals_fill_up_to_the_caps(spark):
    docs = mixing.sized(corpus(spark), spark.createDataFrame([("repo_docs", 0.5, 1), ("wiki", 0.5, 1)], TARGETS))
    t = spark.createDataFrame([("repo_docs", 0.5, 1), ("wiki", 0.5, 1)], TARGETS)
    p = mixing.plan(docs, t, total_tokens=10**9)
    assert (p["slots"] == p["n_blocks"]).all()
    assert isinstance(p, pd.DataFrame) and json.dumps(p["source"].tolist()) == '["repo_docs", "wiki"]'


def test_mixing_of_nothing(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], TARGETS)
    t = spark.createDataFrame([("wiki", 1.0, 2), ("wiki", None, None), (None, 0.5, 1)], TARGETS)
    assert mixing.mix(empty, t).collect() == [] and mixing.mix(corpus(spark), none).collect() == [] and mixing.shares(corpus(spark), none).collect() == []
    assert mixing.shares(empty, t).first()["mixed_tokens"] == 0
