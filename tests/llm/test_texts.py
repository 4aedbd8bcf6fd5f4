"""Broken pairs, reading levels and foreign files on fixtures: held-out accuracy, brute force and edge cases."""

import datetime as dt
import random

import numpy as np
import pytest

from weftgraph.llm import language, pairs, provenance, reading
from weftgraph.llm.prose import count_words, sentences

MEM = "id bigint, repo string, question string, answer string, nodes array<string>, outcome string, correction string, revision string, recorded timestamp, received_at timestamp"
T0 = dt.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def memory(spark):
    return spark.read.parquet("/root/testdata/sf0.01/memory_entries.parquet")


def test_language_model_learns_from_all_pairs(spark, documents):
    texts = ["Which file declares the parser and who calls it from the server?", "¿Qué archivo declara el servidor y quién lo llama desde ayer?", "12"]
    told = [(texts[k % 3], f"{texts[k % 3]} {texts[k % 3]}") for k in range(4500)]
    first = language.train(documents)
    got = language.pair_counts(spark.createDataFrame(told, "question string, text string").repartition(3), first)
    want = np.zeros_like(got)
    for pair in told[:2]:
        language.add_pairs(want, first, [pair])
    assert want.sum() > 0 and (got == 1500 * want).all()
    # single characters of both sides, with the two blanks of each
    assert got[0, :, language.LANGUAGES.index("en")].sum() == 1500 * sum(len(t) + 2 for t in told[0])


def test_language_model_on_held_out_sentences(documents):
    nb = language.train(documents)
    tests = {
        "en": ["The parser reads every file twice before it starts.", "Nobody calls this function any more."], "es": ["Ningún archivo llama a esta función desde ayer.", "El servidor guarda los datos cada noche."],
        "pt": ["Nenhum arquivo chama essa função desde ontem.", "O servidor não guarda os dados antigos."], "de": ["Niemand ruft diese Funktion seit gestern auf.", "Der Server speichert die Daten jede Nacht."],
        "fr": ["Aucun fichier n'appelle cette fonction depuis hier.", "Le serveur garde les données chaque nuit."], "zh": ["没有文件调用这个函数。", "服务器每天晚上保存数据。"],
    }
    for lang, texts in tests.items():
        assert [language.LANGUAGES[k] for k in nb.scores(texts).argmax(axis=1)] == [lang] * len(texts)
    assert nb.scores([]).shape == (0, len(language.LANGUAGES))


@pytest.mark.parametrize(
    "question, answer, kind",
    [
        ("Who calls run?", None, "empty"), ("Who calls run?", " \u200b\n", "empty"), ("Who calls run?", "N/A", "empty"), ("Who calls run?", "(none)", "empty"), ("Who calls run?", "...", "empty"), ("How many?", "0", None), ("Who?", "Nobody.", None),
        ("Who calls run_all?", "Who calls run_all?", "copy"), ("Who calls run_all?", "You asked: WHO CALLS RUN_ALL", "copy"), ("Who calls run_all?", "> Who calls run_all?\n\nWho calls run_all.", "copy"), ("Who calls run_all?", "Who calls run_all? Two tests do.", None), ("Is it safe?", "Is it safe? Yes.", None),
        ("Who calls run?", "I'm afraid I can't answer that.", "refusal"), ("Who calls run?", "Lo siento, no puedo ayudarte.", "refusal"), ("Who calls run?", "Das darf ich leider nicht beantworten.", "refusal"), ("Who calls run?", "抱歉，我无法回答。", "refusal"),
        ("Does it refuse?", "It refuses them; the request is denied.", None), ("Who?", "I can't see it there, so the parser can't help with it.", None), ("Who?", "The log says “I can't answer that”.", None), ("Who?", "Sorry for the mix-up: it is run.", None),
        ("How?", "Like this:\n```py\nrun(", "truncated"), ("How?", "Steps:\n\n1. first\n2.", "truncated"), ("How?", "See the note (", "truncated"), ("How?", "Call `run", "truncated"), ("How?", "```\nrun()\n```", None), ("How?", "`src/a.py:3`", None),
    ],
)
def test_kinds_by_rule(question, answer, kind):
    assert pairs._kind(question, answer, False) == kind


def test_end_likelihood_against_brute_force(spark):
    rng = random.Random(4)
    whole = ["The index was built again.", "Nothing else depends on it.", "It was read from the file first."]
    texts = [" ".join(rng.choice(whole) for _ in range(rng.randrange(1, 4))) for _ in range(80)]
    cut = ["The index was built aga", "Nothing else depends on", "Nothing else depends on it", "It was read from the file first", "It was read fr"]
    rows = [(i, "answer", "q", t) for i, t in enumerate([*texts, *cut])] + [(500, "answer", "q", None)]
    got = {r["id"]: r for r in pairs.end_likelihood(spark.createDataFrame(rows, "id bigint, field string, question string, text string")).collect()}
    assert sorted(got) == [80, 81, 82, 83, 84]
    for i, t in enumerate(cut):
        r = got[80 + i]
        gram = t[-r["n"] :]
        seen = ended = 0
        for x in [*texts, *cut]:
            at = x.find(gram)
            while at >= 0:
                nxt = x[at + len(gram) : at + len(gram) + 1]
                if nxt:
                    seen += 1
                    ended += nxt == "." and (at + len(gram) + 1 == len(x) or x[at + len(gram) + 1] == " ")
                at = x.find(gram, at + 1)
        assert (r["seen"], r["ended"]) == (seen, ended)
    assert [got[80 + i]["ended"] > got[80 + i]["seen"] / 2 for i in range(5)] == [False, False, True, True, False]


def test_defects_with_nulls_repeats_and_empty_tables(spark, documents, memory):
    q = "Where is the graph of the callers stored and who reads it?"
    rows = [(10**6, "r", q, "El grafo de las llamadas se guarda en la tabla y lo lee el exportador.", None, "wrong", "TODO", None, T0, T0), (10**6 + 1, "r", q + " Please answer in Spanish.", "El grafo de las llamadas se guarda en la tabla y lo lee el exportador.", None, "ok", "TODO", None, T0, T0), (10**6 + 2, None, None, "fine.", None, None, None, None, None, None), (None, "r", "q", None, None, None, None, None, T0, T0)]
    all_ = memory.unionByName(spark.createDataFrame(rows * 2, MEM))
    got = {(r["id"], r["field"], r["defect"]) for r in pairs.defects(all_, documents).collect()}
    mine = {g for g in got if g[0] >= 10**6}
    assert mine == {(10**6, "answer", "language"), (10**6, "correction", "empty")}
    assert pairs.defects(memory.limit(0), documents).collect() == [] and pairs.defects(spark.createDataFrame(rows, MEM), documents.limit(0)).count() >= 1


def test_prose_leaves_other_blocks_out():
    text = "# A title.\n\nFirst sentence here. Second one, too!\n\n- a list item.\n1. another item.\n\n| a | b |\n\n```py\nx = 1.\n```\n\nOver\n====\n\nwrapped\nline ends here.\n\n    code indented.\n\npanic at x:1\n  at f (src/a:3)\n\nkey:\n  other: {a: 1}\n\nNo full stop"
    assert sentences(text) == ["First sentence here.", "Second one, too!", "wrapped line ends here."]
    assert count_words("It is `x_y` – 3 – ok.") == 5
    assert sentences("") == [] and sentences("\r\n\r\n") == []


def test_propagation_matches_dense_iteration(spark):
    rng = random.Random(6)
    vocab = {1: "open the map and look at each box near line".split(), 2: "index query parser option default log commit branch".split(), 3: "lattice monotone invariant modulo functor kernel adjoint lemma".split()}
    docs, grades = [], []
    for i in range(90):
        level = i % 3 + 1
        words = [rng.choice(vocab[level] if rng.random() < 0.8 else ["the", "a", "of", "is"]) for _ in range(60)]
        docs.append((i, ". ".join(" ".join(words[k : k + 10]).capitalize() for k in range(0, 60, 10)) + "."))
        if i < 30:
            grades.append((i, level if i != 4 else 3, "r"))
    grades += [(0, None, "r"), (None, 2, "r"), (777, 1, "r")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    g = spark.createDataFrame(grades, "doc_id bigint, level int, rater string")
    got = {r["doc_id"]: r for r in reading.levels(d, g).collect()}
    # the one wrong grade doesn't stick, and unseen documents come out right
    assert sum(got[i]["level"] != i % 3 + 1 for i in range(90)) == 0
    feats = [np.frombuffer(f[1], np.int32) for f in reading.Features().of([t for _, t in docs])]
    a = np.zeros((90, 1 << reading.BITS), np.float32)
    for i, f in enumerate(feats):
        a[i, f] = 1
    used = np.flatnonzero(a.sum(0))
    a = a[:, used].astype(np.float64)
    y = np.full(90, np.nan)
    for i, lv, _ in grades[:30]:
        y[i] = lv
    value, weight = np.full(len(used), np.nanmean(y)), np.ones(len(used))
    for _ in range(reading.ITERATIONS):
        own = (a @ (value * weight)) / (a @ weight)
        own = np.where(np.isnan(y), own, y)
        value = (a.T @ own) / a.sum(0)
        weight = np.log((a.sum(0).max() + 1) / a.sum(0)) + 0.05
    want = (a @ (value * weight)) / (a @ weight)
    assert np.allclose([got[i]["score"] for i in range(90)], want, atol=1e-5)


def test_levels_without_documents_or_grades(spark):
    D, L = "doc_id bigint, text string", "doc_id bigint, level int, rater string"
    long = "This is a plain sentence that people read. " * 10
    assert reading.levels(spark.createDataFrame([], D), spark.createDataFrame([], L)).collect() == []
    d = spark.createDataFrame([(1, long), (1, long), (2, None), (3, ""), (4, "short."), (5, "```\n" + long + "\n```"), (6, "这是一个句子。" * 60)], D)
    assert [(r["doc_id"], r["level"]) for r in reading.levels(d, spark.createDataFrame([], L)).collect()] == [(1, 2), (1, 2)]
    assert reading.cuts({}) == (1.5, 2.5) and reading.cuts({1: 1.0, 3: 3.0}) == (1.5, 2.5)


SRC = "file_id bigint, repo string, file_path string, text string"
TP = "item_id bigint, package string, file_name string, text string"
CODE = "def load_{0}(rows):\n    total = 0\n    for row in rows:\n        total += row.size_{0}\n    return total\n\n\ndef save_{0}(rows, path):\n    with open(path) as handle:\n        handle.write(str(rows) + 'x{0}')\n\n\nclass Store_{0}:\n    def __init__(self, path):\n        self.path_{0} = path\n"


def test_foreign_files(spark):
    pkg = CODE.format("pkg")
    accessors = "\n\n".join(f"def get_f{i:02d}(m):\n    return m.v[{i}]\n\n\ndef set_f{i:02d}(m, x):\n    m.v[{i}] = x" for i in range(9))
    minified = "!function(e,t){" + "".join(f"var a{i}=e.b{i}?t({i}):void 0,c{i}=!a{i};" for i in range(40)) + "}(this,1);"
    files = [
        (1, "red-api", "src/own.py", CODE.format("own")), (2, "red-api", "vendor/p/a.py", "# header\n\n" + pkg), (3, "blue-web", "src/copy.py", pkg.replace("total = 0", "total = 1  # patched")), (4, "red-api", "a_pb2.py", accessors), (5, "red-api", "x/m.js", minified),
        (6, "red-api", "d.go", "package d\n\nvar T = []int{\n" + "1, 22, 333, 4,\n" * 60 + "}\n"), (7, "red-api", "t.java", "a,b,c\n" + "x,1,2\n" * 9), (8, "red-api", "g.py", '"""Code generated by maker v1.2. DO NOT EDIT."""\n' + CODE.format("g")), (9, "red-api", "codegen.py", 'HEADER = "# Code generated by maker. DO NOT EDIT."\n' + CODE.format("h")),
        (10, "red-api", "ids.py", "# ids of a node are generated by the server\n" + CODE.format("i")), (11, "red-api", "p.py", "<!DOCTYPE html>\n<html></html>"), (12, "red-api", "c.json", '{"a": [1, 2]}'), (13, "red-api", "n.py", None), (14, "red-api", "e.py", ""), (15, "blue-web", "deep/lib/one.py", CODE.format("s1")), (16, "blue-web", "deep/lib/two.py", CODE.format("s2")),
        (17, "green", "their/one.py", CODE.format("s1")), (18, "green", "their/two.py", CODE.format("s2")), (19, "red-web", "src/own.py", CODE.format("own")), (20, "red-api", "short.py", "LIMITS = [1, 2, 3]\n" + CODE.format("z")), (2, "red-api", "vendor/p/a.py", "# header\n\n" + pkg), (None, "r", "x.py", pkg), (21, None, None, CODE.format("q")),
    ]
    got = {r["file_id"]: r["kind"] for r in provenance.foreign(spark.createDataFrame(files, SRC), spark.createDataFrame([(1, "p", "a.py", pkg)], TP)).collect()}
    assert got == {2: "vendored", 3: "vendored", 4: "generated", 5: "minified", 6: "data", 7: "data", 8: "generated", 15: "vendored", 16: "vendored", 17: "vendored", 18: "vendored"}
    summary = spark.createDataFrame([("red-api", T0, 1, 9)], "repo string, indexed_at timestamp, pass_id bigint, files int")
    h = {r["repo"]: (r["n_files"], r["n_handwritten"], r["indexed_files"]) for r in provenance.handwritten(spark.createDataFrame(files, SRC), spark.createDataFrame([], TP), summary).collect()}
    assert h["red-api"] == (14, 8, 9)


def test_small_and_deep_files_count_through_their_directories(spark):
    def tree(repo, first, at, small="DEPTH = 3\n"):
        return [(first, repo, f"{at}/one.py", CODE.format("s1")), (first + 1, repo, f"{at}/two.py", CODE.format("s2")), (first + 2, repo, f"{at}/sub/tiny.py", small), (first + 3, repo, f"{at}/cfg.json", "{}"), (first + 4, repo, f"{at}/__init__.py", "")]

    deep = "/".join(f"d{i}" for i in range(50))
    files = [*tree("red-api", 1, "vendor/p"), *tree("blue-web", 11, deep), (21, "green", "a/tiny.py", "DEPTH = 3\n"), (22, "green", "a/b.py", CODE.format("g"))]
    got = {r["file_id"]: r["kind"] for r in provenance.foreign(spark.createDataFrame(files, SRC), spark.createDataFrame([], TP)).collect()}
    # the same few characters elsewhere prove nothing; .json and empty files are no case
    assert got == {i: "vendored" for i in (1, 2, 3, 11, 12, 13)}
    other = [*tree("red-api", 1, "vendor/p"), *tree("blue-web", 11, deep, "DEPTH = 4\n")]
    got = {r["file_id"] for r in provenance.foreign(spark.createDataFrame(other, SRC), spark.createDataFrame([], TP)).collect()}
    assert got == {1, 2, 11, 12}  # a tree that differs in a small file is another tree
    kin = provenance.foreign(spark.createDataFrame(files, SRC), spark.createDataFrame([], TP), related=lambda repo: "one house")
    assert kin.collect() == []


def test_tables_are_judged_over_the_whole_text():
    rows = "".join(f"n{i},{i},x\n" for i in range(2000))
    assert provenance.is_table(rows) and provenance.is_table("a(b),1,x\n" + rows) and not provenance.is_table("a,b\n" * 4)
    code = "".join(f"f{i}(a, b)\n" for i in range(3000))
    assert not provenance.is_table(rows + code) and not provenance.is_table(code)


def test_foreign_files_of_empty_tables(spark):
    assert provenance.foreign(spark.createDataFrame([], SRC), spark.createDataFrame([], TP)).collect() == []
    assert provenance.foreign(spark.createDataFrame([(1, "a", "b.py", CODE.format("x"))], SRC), spark.createDataFrame([], TP)).collect() == []


def test_subtree_hashes_ignore_names_but_not_structure(spark):
    rows = [("a", "x/lib/one.py", 1), ("a", "x/lib/sub/two.py", 2), ("b", "y/z/p.py", 1), ("b", "y/z/q/r.py", 2), ("c", "k/one.py", 1), ("c", "k/two.py", 2)]
    df = spark.createDataFrame([(r, p, k, 200) for r, p, k in rows], "repo string, path string, file_key bigint, chars int")
    k = {(r["repo"], r["dir"]): r["k"] for r in provenance.subtrees(df).collect()}
    assert k["a", "x/lib"] == k["b", "y/z"] != k["c", "k"]
