"""Graph algorithms against plain Python on random graphs, and edge cases."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import graph as G
from weftgraph.graph import PropertyGraph
from weftgraph.operators import graph_algos as A

N = "id bigint, repo string, kind string, name string, file_path string, start_line int, end_line int, description string, perspective string, evidence_kind string, evidence_source string"
E = "src bigint, dst bigint, kind string, confidence string"


def build(spark, nodes, edges):
    rows = [(i, "r", k, n, f, 1, 2, None, "observed", None, None) for i, k, n, f in nodes]
    return PropertyGraph(spark.createDataFrame(rows, N), spark.createDataFrame(edges, E))


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(5)
    nodes = [(i, rng.choice(["function", "method", "struct"]), f"n{i % 17}", f"d/f{i % 6}.py") for i in range(60)]
    edges = sorted({(rng.randrange(45), rng.randrange(45), rng.choice(["calls", "references"])) for _ in range(70)})
    edges = [(a, b, k, rng.choice(["EXTRACTED", "INFERRED", "AMBIGUOUS"])) for a, b, k in edges]
    return nodes, edges, build(spark, nodes, edges)


def test_degrees(random_graph):
    nodes, edges, g = random_graph
    got = {r["id"]: (r["in_degree"], r["out_degree"], r["degree"]) for r in A.degrees(g).collect()}
    for i, *_ in nodes:
        want = (sum(e[1] == i for e in edges), sum(e[0] == i for e in edges))
        assert got.get(i, (0, 0, 0)) == (*want, sum(want))


def test_impact_is_reverse_breadth_first(random_graph, spark):
    _, edges, g = random_graph
    got = {(r["root"], r["id"]): r["depth"] for r in A.impact(g, spark.createDataFrame([(0, 3), (0, 9), (1, 20)], "root bigint, id bigint")).collect()}
    for root, seeds in ((0, [3, 9]), (1, [20])):
        depth, todo = {s: 0 for s in seeds}, deque(seeds)
        while todo:
            x = todo.popleft()
            for a, b, *_ in edges:
                if b == x and a not in depth:
                    depth[a] = depth[x] + 1
                    todo.append(a)
        want = {(root, i): d for i, d in depth.items() if 0 < d <= 20}
        assert {k: v for k, v in got.items() if k[0] == root} == want
    assert A.impact_summary(g, spark.createDataFrame([(1, 20)], "root bigint, id bigint")).count() <= 1


def test_depth_is_bounded(spark):
    g = build(spark, [(i, "function", f"n{i}", "f") for i in range(30)], [(i + 1, i, "calls", "EXTRACTED") for i in range(29)])
    seed = spark.createDataFrame([(0, 0)], "root bigint, id bigint")
    assert A.impact(g, seed).agg(F.max("depth")).first()[0] == 20
    assert A.dependents(g, seed).count() == 29


def test_shortest_path(random_graph, spark):
    _, edges, g = random_graph
    around = {}
    for a, b, *_ in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    dist, todo = {0: 0}, deque([0])
    while todo:
        x = todo.popleft()
        for y in sorted(around.get(x, ())):
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    far = max(dist, key=lambda i: (dist[i], i))
    got = [(r["step"], r["id"]) for r in A.shortest_path(g, 0, far).collect()]
    assert [s for s, _ in got] == list(range(dist[far] + 1)) and got[0][1] == 0 and got[-1][1] == far
    assert all(b in around[a] for (_, a), (_, b) in zip(got, got[1:]))
    assert A.shortest_path(g, 0, 59).collect() == []
    assert [r["id"] for r in A.shortest_path(g, 0, 0).collect()] == [0]


def test_components(random_graph):
    nodes, edges, g = random_graph
    root = {i: i for i, *_ in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, *_ in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r["id"]: r["component"] for r in A.components(g).collect()} == {i: find(i) for i, *_ in nodes}


def test_components_of_a_long_chain_and_a_star(spark):
    n = 120
    chain = build(spark, [(i, "function", "x", "f") for i in range(n)], [(i, i + 1, "calls", "EXTRACTED") for i in range(n - 1)])
    assert {r["component"] for r in A.components(chain).collect()} == {0}
    star = build(spark, [(i, "function", "x", "f") for i in range(n)], [(i, 50, "calls", "EXTRACTED") for i in range(n)])
    assert {r["component"] for r in A.components(star).collect()} == {0}


def test_communities_are_the_sequential_ones(random_graph):
    nodes, edges, g = random_graph
    want = A.sequential_labels([i for i, *_ in nodes], [(a, b) for a, b, *_ in edges])
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert {r["id"]: r["community"] for r in A.communities(g).collect()} == {i: c for i, c in want.items() if sizes[c] > 1}


@pytest.mark.parametrize("block_rows", [60])
def test_communities_keep_the_order_in_large_components(random_graph, block_rows):
    nodes, edges, g = random_graph
    want = A.sequential_labels([i for i, *_ in nodes], [(a, b) for a, b, *_ in edges])
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    got = A.communities(g, most_nodes=5, block_rows=block_rows)
    assert {r["id"]: r["community"] for r in got.collect()} == {i: c for i, c in want.items() if sizes[c] > 1}


def test_synchronous_labels_split_two_cliques(spark):
    clique = lambda ids: [(a, b, "calls", "EXTRACTED") for a in ids for b in ids if a != b]
    a, b = range(10), range(100, 110)
    g = build(spark, [(i, "function", f"n{i}", "f") for i in [*a, *b]], [*clique(a), *clique(b), (100, 0, "calls", "EXTRACTED")])
    for got in (A.label_propagation(g), A.communities(g), A.communities(g, most_nodes=5)):
        labels = {r["id"]: r["community"] for r in got.collect()}
        assert len({labels[i] for i in a}) == len({labels[i] for i in b}) == 1 and labels[0] != labels[100]


def test_entrypoints_and_processes(spark):
    nodes = [(1, "function", "main", "f"), (2, "function", "b", "f"), (3, "method", "c", "f"), (4, "struct", "S", "f"), (5, "function", "h", "f"), (6, "endpoint", "GET /x", "f")]
    edges = [(1, 3, "calls", "EXTRACTED"), (1, 2, "calls", "EXTRACTED"), (2, 5, "calls", "EXTRACTED"), (3, 2, "calls", "EXTRACTED"), (1, 4, "calls", "EXTRACTED"), (5, 6, "implements", "EXTRACTED")]
    g = build(spark, nodes, edges)
    assert {r["id"] for r in A.entrypoints(g).collect()} == {1, 5}
    assert sorted((r["root"], r["step"], r["id"]) for r in A.processes(g).collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 5)]
    assert sorted(r["step"] for r in A.processes(g, most_steps=2).collect()) == [1, 2]


def test_affected_tests_and_diffs(spark):
    nodes = [(1, "function", "core", "src/core.py"), (2, "function", "use", "src/use.py"), (3, "function", "check", "tests/test_core.py"), (4, "function", "own", "src/core_test.py")]
    g = build(spark, nodes, [(2, 1, "calls", "EXTRACTED"), (3, 2, "calls", "EXTRACTED"), (4, 1, "references", "EXTRACTED")])
    d = spark.createDataFrame([(7, "--- a/src/core.py\n+++ b/src/core.py\n@@\n+++ /dev/null\n+++ b/src/core.py\tx")], "root bigint, text string")
    changed = A.changed_files(d).withColumn("repo", F.lit("r"))
    assert {(r["root"], r["file_path"]) for r in A.affected_tests(g, changed).collect()} == {(7, "tests/test_core.py"), (7, "src/core_test.py")}


def test_rename_plan(spark):
    nodes = [(1, "function", "go", "a.py"), (2, "function", "use", "b.py"), (3, "function", "other", "c.py"), (4, "function", "twice", "a.py"), (5, "function", "twice", "b.py")]
    g = build(spark, nodes, [(2, 1, "calls", "EXTRACTED"), (3, 1, "calls", "AMBIGUOUS")])
    files = spark.createDataFrame([("r", "a.py", "def go(): go_on(); ego(); go"), ("r", "b.py", "go(go)"), ("r", "c.py", "go")], "repo string, file_path string, text string")
    names = spark.createDataFrame([("go", "r"), ("twice", "r")], "name string, repo string")
    assert {(r["file_path"], r["occurrences"]) for r in A.rename_plan(g, files, names).collect()} == {("a.py", 2), ("b.py", 2)}


def test_empty_graph(spark):
    g = build(spark, [], [])
    assert A.components(g).collect() == [] and A.communities(g).collect() == [] and A.processes(g).collect() == [] and A.label_propagation(g).collect() == []
    assert A.kind_classes(g).first()["edges"] == 0 and A.god_nodes(g).collect() == [] and A.report_god_nodes(g).collect() == []


def test_cleaning_and_upserts(spark):
    e = spark.createDataFrame([(1, 2, " Calls", "inferred "), (1, 2, "calls", "EXTRACTED"), (1, 2, "odd", None), (None, 2, "calls", "EXTRACTED"), (3, 4, "imports", "maybe")], E)
    assert sorted(tuple(r) for r in G.clean_edges(e).collect()) == [(1, 2, "calls", "EXTRACTED"), (3, 4, "imports", "AMBIGUOUS")]
    n = spark.createDataFrame([(1, "r", "Widget", None, None, None, None, None, None, None, None), (None, "r", "file", "x", "x", 1, 1, None, None, None, None)], N)
    assert [(r["kind"], r["perspective"]) for r in G.clean_nodes(n).collect()] == [("interface", "observed")]
    a = spark.createDataFrame([(1, 2, "calls", "AMBIGUOUS", 1)], E + ", rule_seq int")
    b = spark.createDataFrame([(1, 2, "calls", "EXTRACTED", 3)], E + ", rule_seq int")
    assert [r["confidence"] for r in G.upsert_edges(b, a).collect()] == ["EXTRACTED"]
    g = build(spark, [(1, "function", "x", "a"), (2, "function", "x", "b")], [(1, 2, "calls", "EXTRACTED")])
    left = G.remove_files(g, spark.createDataFrame([("b",)], "file_path string"))
    assert [r["id"] for r in left.nodes.collect()] == [1] and left.edges.collect() == []
    assert G.find_by_name(g, "x").first()["id"] == 1 and G.find_by_name(g, "x", "b").first()["id"] == 2
    ids = [r["external_id"] for r in G.stable_ids(g.nodes).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 23 for i in ids)


def test_repositories_are_kept_apart(spark):
    rows = [(1, "a", "function", "f", "src/x.py", 1, 2, None, "observed", None, None), (2, "b", "function", "f", "src/x.py", 1, 2, None, "observed", None, None), (3, None, "function", "f", "src/x.py", 1, 2, None, "observed", None, None)]
    g = PropertyGraph(spark.createDataFrame(rows, N), spark.createDataFrame([(1, 2, "calls", "EXTRACTED"), (2, 2, "calls", "EXTRACTED")], E))
    left = G.remove_files(g, spark.createDataFrame([("a", "src/x.py")], "repo string, file_path string"))
    assert sorted(r["id"] for r in left.nodes.collect()) == [2, 3] and [tuple(r)[:2] for r in left.edges.collect()] == [(2, 2)]
    none = G.remove_files(g, spark.createDataFrame([(None, "src/x.py")], "repo string, file_path string"))
    assert sorted(r["id"] for r in none.nodes.collect()) == [1, 2] and none.edges.count() == 2
    assert G.remove_files(g, spark.createDataFrame([("src/x.py",)], "file_path string")).nodes.count() == 0
    ids = {r["id"]: r["external_id"] for r in G.stable_ids(g.nodes).collect()}
    assert len(set(ids.values())) == 3
    R = "repo string, file_path string, kind string, owner string, target string"
    one = spark.createDataFrame([("a", "x.py", "call", "f", "g")], R)
    both = G.insert_references(one, spark.createDataFrame([("b", "x.py", "call", "f", "g"), ("a", "x.py", "call", "f", "g")], R))
    assert sorted(r["repo"] for r in both.collect()) == ["a", "b"]


@pytest.mark.parametrize("most_rows", [0, 1_000_000])
def test_touched_makes_no_pair_inside_a_whole(spark, most_rows):
    """Counts equal brute force on random graphs of several components; what a core's dependents are, no root repeats."""
    rng = random.Random(4)
    ends = [(a, b) for base in (0, 100) for a, b in ((base + rng.randrange(60), base + rng.randrange(60)) for _ in range(90))]
    g = build(spark, [(i, "function", f"n{i}", "f") for i in range(200)], [(a, b, "calls", "EXTRACTED") for a, b in set(ends)])
    pairs = {(r, rng.randrange(170)) for r in range(40) for _ in range(3)} | {(41, 199)}
    seeds = spark.createDataFrame(sorted(pairs), "root bigint, id bigint")
    users = {}
    for a, b in ends:
        users.setdefault(b, set()).add(a)
    want = {}
    for root in {r for r, _ in pairs}:
        own = {i for r, i in pairs if r == root}
        got, todo = set(own), list(own)
        while todo:
            new = users.get(todo.pop(), set()) - got
            got |= new
            todo += new
        want[root] = got - own
    rest, covers, whole = A.touched(g, seeds, most_rows)
    assert {r["root"]: r["n"] for r in A.touched_counts(seeds, rest, covers, whole).collect()} == {r: len(x) for r, x in want.items() if x}
    all_ = rest.unionByName(covers.join(whole, "core").select("root", "id"))
    made = [tuple(r) for r in all_.collect()]
    assert len(made) == len(set(made)) and set(made) == {(r, i) for r, x in want.items() for i in x} | pairs
    assert covers.count() and rest.count() < len(made)


@pytest.mark.parametrize("most_rows", [0, 1_000_000])
def test_communities_as_arrays_are_the_sequential_ones(random_graph, most_rows):
    """Large components as arrays in one task, or in blocks where no task holds them: the same labels."""
    nodes, edges, g = random_graph
    want = A.sequential_labels([i for i, *_ in nodes], [(a, b) for a, b, *_ in edges])
    got = {r["id"]: r["community"] for r in A.communities(g, most_nodes=5, block_rows=60, most_rows=most_rows).collect()}
    sizes = {c: list(want.values()).count(c) for c in set(want.values())}
    assert got == {i: c for i, c in want.items() if sizes[c] > 1}


def test_array_labels_keep_the_order_inside_a_stretch():
    """Chains of near ids, hubs and repeated edges: what is settled together is settled in order."""
    rng = random.Random(1)
    for t in range(12):
        n = (5, 50, 700)[t % 3]
        ends = [(a, min(n - 1, a + rng.randrange(1, 5)) if t % 2 else rng.randrange(min(n, 4))) for a in (rng.randrange(n) for _ in range(3 * n))]
        rows = {}
        for a, b in ends:
            if a != b:
                rows[a, b], rows[b, a] = rows.get((a, b), 0) + 1, rows.get((b, a), 0) + 1
        counts = [0] * n
        for a, _ in rows:
            counts[a] += 1
        order = sorted(rows)
        got = A.array_labels(np.cumsum(counts), np.array([b for _, b in order]), np.array([rows[x] for x in order]))
        want = A.sequential_labels(list(range(n)), ends)
        assert got.tolist() == [want[i] for i in range(n)]


def test_label_propagation_broadcasts_no_labels(spark):
    """The labels of all nodes, small when compressed, are merged, not sent to the driver."""
    g = build(spark, [(i, "function", f"n{i}", "f") for i in range(6)], [(0, 1, "calls", "EXTRACTED"), (1, 2, "calls", "EXTRACTED"), (3, 4, "calls", "EXTRACTED")])
    plans, write = [], A.written
    try:
        A.written = lambda df, *names: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *names))[1]
        A.label_propagation(g, 2).collect()
    finally:
        A.written = write
    assert len(plans) > 2 and not any("BroadcastHashJoin" in p for p in plans)
