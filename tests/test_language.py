"""The pattern query language on a small parcel-sorting graph, against lists made in plain Python, and its truth table."""

import itertools

import pytest

from weftgraph.graph import PropertyGraph
from weftgraph.plans.lexer import QueryError
from weftgraph.plans.parser import parse
from weftgraph.plans.planner import Plan, cypher, plan
from weftgraph.plans.render import to_json, to_table

N = "id bigint, repo string, kind string, name string, file_path string, start_line int, end_line int, description string, perspective string, evidence_kind string, evidence_source string"
E = "src bigint, dst bigint, kind string, confidence string"

# id: kind, name, file, line
NODES = {
    30: ("endpoint", "POST /parcels", "api/http.go", 15), 31: ("struct", "Parcel", "api/http.go", 40), 32: ("function", "idle", "api/http.go", 70), 33: ("function", "feed", "sort/belt.go", 7), 34: ("method", "scan", "sort/belt.go", 31),
    35: ("function", "route", "sort/plan.go", 4), 36: ("function", "eject", "sort/plan.go", 58), 37: ("interface", "Chute", "sort/plan.go", 90), 38: ("file", "belt.go", "sort/belt.go", None), 39: ("doc", "belt.md", "docs/belt.md", 1), 40: ("schema", "Label", None, 2),
}
EDGES = [
    (33, 34, "calls", "EXTRACTED"), (34, 35, "calls", "INFERRED"), (35, 36, "calls", "EXTRACTED"), (35, 33, "calls", "AMBIGUOUS"), (36, 36, "calls", "EXTRACTED"), (33, 30, "implements", "EXTRACTED"), (34, 31, "references", "EXTRACTED"),
    (35, 31, "references", "INFERRED"), (39, 35, "explains", "INFERRED"), (39, 37, "explains", "AMBIGUOUS"), (31, 37, "inherits", "EXTRACTED"), (38, 31, "imports", "EXTRACTED"), (32, 99, "calls", "AMBIGUOUS"),
]
KIND, NAME, FILE, LINE = range(4)


def of(column, *kinds):
    return {i: n[column] for i, n in NODES.items() if not kinds or n[KIND] in kinds}


def hops(*kinds):
    """(src, dst) of the edges of these kinds whose ends exist."""
    return [(a, b) for a, b, k, _ in EDGES if k in kinds and b in NODES]


def name(i):
    return NODES[i][NAME]


@pytest.fixture(scope="module")
def g(spark):
    nodes = [(i, "r", k, n, f, s, None if s is None else s + 9, None, "observed", None, None) for i, (k, n, f, s) in NODES.items()]
    return PropertyGraph(spark.createDataFrame(nodes, N), spark.createDataFrame(EDGES, E))


def rows(g, q):
    return [tuple(r) for r in cypher(g, q).collect()]


def test_hops_and_directions(g):
    calls = hops("calls")
    assert sorted(rows(g, "MATCH (a)-[:CALLS]->(b) RETURN a.id, b.id")) == sorted(calls)
    assert sorted(rows(g, "MATCH (a)<-[:CALLS]-(b) RETURN b.id, a.id")) == sorted(calls)
    # undirected: from both ends, a loop counts twice
    assert sorted(rows(g, "MATCH (a)-[:CALLS]-(b) RETURN a.id, b.id")) == sorted(calls + [(b, a) for a, b in calls])
    assert sorted(rows(g, "MATCH (a:Method)-[]->(b) RETURN a.id, b.id")) == sorted((a, b) for a, b, *_ in EDGES if NODES[a][KIND] == "method")
    assert rows(g, "MATCH (a {name: 'idle'})-[:CALLS]->(b) RETURN b.id") == []


def paths(low, high):
    """All call paths without a repeated edge, as lists of edges."""
    out, level = [], [[e] for e in hops("calls")]
    for k in range(1, high + 1):
        out += level if k >= low else []
        level = [[*p, e] for p in level for e in hops("calls") if e[0] == p[-1][1] and e not in p]
    return out


@pytest.mark.parametrize("text, low, high", [("*", 1, 5), ("*2", 2, 2), ("*2..3", 2, 3), ("*..2", 1, 2), ("*3..", 3, 5)])
def test_variable_length_paths(g, text, low, high):
    got = rows(g, f"MATCH (a)-[:CALLS{text}]->(b) RETURN a.id, b.id LIMIT 1000")
    assert sorted(got) == sorted((p[0][0], p[-1][1]) for p in paths(low, high))


def test_returned_paths_show_names_and_nodes_their_properties(g):
    got = rows(g, "MATCH (a {name: 'feed'})-[r:CALLS*2]->(b) RETURN r, b")
    assert [[(e["type"], e["source"], e["target"]) for e in r] for r, _ in got] == [[("CALLS", name(a), name(b)) for a, b in p] for p in paths(2, 2) if p[0][0] == 33]
    assert got[0][1].asDict() == {"id": 35, "kind": "function", "name": "route", "file": "sort/plan.go", "line": 4, "end_line": 13}
    assert rows(g, "MATCH (a)-[r:CALLS*2]->(b) RETURN r.type AS t, count(*) AS n") == [(None, len(paths(2, 2)))]
    assert sorted(rows(g, "MATCH (a)-[r:CALLS]->(b) RETURN r.type, r.confidence")) == sorted((("CALLS", c) for _, b, k, c in EDGES if k == "calls" and b in NODES))


def test_predicates_and_their_order(g):
    line = of(LINE)
    assert rows(g, "MATCH (n) WHERE n.line > 10 AND n.line <= 58 RETURN n.id ORDER BY n.id") == [(i,) for i, x in line.items() if x is not None and 10 < x <= 58]
    ids = lambda q: [r[0] for r in rows(g, f"MATCH (n) WHERE {q} RETURN n.id AS id ORDER BY id")]
    doc, late, fn = (lambda i: NODES[i][KIND] == "doc"), (lambda i: (NODES[i][LINE] or 0) > 20), (lambda i: NODES[i][KIND] == "function")
    d, l, f = "n.kind = 'doc'", "n.line > 20", "n.kind = 'function'"
    assert ids(f"{d} OR {f} AND {l}") == [i for i in NODES if doc(i) or fn(i) and late(i)]
    assert ids(f"({d} OR {f}) AND {l}") == [i for i in NODES if (doc(i) or fn(i)) and late(i)]
    assert ids(f"NOT {f} AND {l}") == [i for i in NODES if not fn(i) and late(i)]
    assert ids(f"NOT ({f} AND NOT ({l} OR {d}))") == [i for i in NODES if not (fn(i) and not (late(i) or doc(i)))]
    assert ids(f"NOT NOT {f}") == [i for i in NODES if fn(i)]
    assert ids("n.name STARTS WITH 'P' OR n.name ENDS WITH 'e' OR n.name CONTAINS 'md'") == [i for i in NODES if name(i)[0] == "P" or name(i)[-1] == "e" or "md" in name(i)]
    assert ids("n.kind IN ['schema', 'file', 4]") == [i for i in NODES if NODES[i][KIND] in ("schema", "file")]
    assert ids("n.file IS NULL OR n.line IS NULL") == [i for i in NODES if NODES[i][FILE] is None or NODES[i][LINE] is None]
    assert ids("n.Name = 'route' AND n.LINE = 4") == [35]  # properties in any case
    with pytest.raises(QueryError):
        ids(f"({d} OR {f}")


def test_optional_keeps_rows(g):
    calls = hops("calls")
    want = [(i, b) for i in of(NAME, "function") for b in [b for a, b in calls if a == i] or [None]]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(rows(g, "MATCH (n:Function) OPTIONAL MATCH (n)-[:CALLS]->(m) RETURN n.id, m.id"), key=key) == sorted(want, key=key)
    # WHERE filters the final rows
    assert sorted(rows(g, "MATCH (n:Function) OPTIONAL MATCH (n)-[:CALLS]->(m) WHERE m.kind = 'method' RETURN n.id, m.id")) == [(a, b) for a, b in calls if NODES[a][KIND] == "function" and NODES[b][KIND] == "method"]
    # a variable that stayed null stays null in later patterns
    assert (32, None, None) in rows(g, "MATCH (n:Function) OPTIONAL MATCH (n)-[:CALLS]->(m) OPTIONAL MATCH (m)-[:CALLS]->(k) RETURN n.id, m.id, k.id")
    # patterns may end at the bound node, or hold it in the middle
    assert rows(g, "MATCH (n:Struct) OPTIONAL MATCH (f:File)-[:IMPORTS]->(n) RETURN f.name") == [("belt.go",)]
    both = [(a, i, b) for i in of(NAME, "function", "method") for a, b in ([(a, b) for a, x in calls if x == i for y, b in calls if y == i] or [(None, None)])]
    for order in ("(a)-[:CALLS]->(n)-[:CALLS]->(b)", "(b)<-[:CALLS]-(n)<-[:CALLS]-(a)"):
        got = rows(g, f"MATCH (n) OPTIONAL MATCH {order} WHERE n.kind = 'function' OR n.kind = 'method' RETURN a.id, n.id, b.id")
        assert sorted(got, key=key) == sorted(both, key=key)


def test_shared_variables_and_unions(g):
    want = [(a, d) for a, b in hops("calls") for d, x in hops("explains") if x == b]
    assert sorted(rows(g, "MATCH (a)-[:CALLS]->(b), (d:Doc)-[:EXPLAINS]->(b) RETURN a.id, d.id")) == sorted(want)
    docs = [(39,)]
    assert rows(g, "MATCH (n:Doc) RETURN n.id UNION MATCH (n:Doc) RETURN n.id") == docs
    assert rows(g, "MATCH (n:Doc) RETURN n.id UNION ALL MATCH (n:Doc) RETURN n.id") == docs * 2


def test_aggregates(g):
    lines = [x for i, x in of(LINE, "function").items()]
    q = "MATCH (n:Function) RETURN count(*) AS c, min(n.line) AS lo, max(n.line) AS hi, sum(n.line) AS s, avg(n.line) AS a, collect(n.name) AS l, sum(n.name) AS z"
    assert rows(g, q) == [(len(lines), min(lines), max(lines), sum(lines), sum(lines) / len(lines), list(of(NAME, "function").values()), None)]
    count = {}
    for a, _ in hops("calls"):
        count[name(a)] = count.get(name(a), 0) + 1
    assert rows(g, "MATCH (a)-[:CALLS]->(b) RETURN a.name AS n, count(b) AS c ORDER BY c DESC, n") == sorted(count.items(), key=lambda x: (-x[1], x[0]))
    assert rows(g, "MATCH (n:Component) RETURN count(*) AS c") == []


def test_order_and_paging(g):
    # null is greatest: first in descending order
    assert rows(g, "MATCH (n) RETURN n.id AS id, n.line AS line ORDER BY line DESC LIMIT 2") == [(38, None), (37, 90)]
    a = plan(g, parse("MATCH (n) RETURN n.name LIMIT 2"))
    assert a.rows.count() == 2 and a.truncated()
    b = plan(g, parse(f"MATCH (n) RETURN n.name SKIP {len(NODES) - 1}"))
    assert b.rows.count() == 1 and not b.truncated()
    assert plan(g, parse("MATCH (n) RETURN n.name LIMIT 5000")).truncated()


def test_truth_table(g):
    """Every pair of {null, int, text, node} under every comparison is two-valued and never coerced."""
    values = {"a.confidence": None, "a.line": 7, "'7'": "7", "7": 7, "a.name": "feed", "'feed'": "feed", "a": ("node", 33), "b": ("node", 34)}

    def want(op, x, y):
        node = lambda v: isinstance(v, tuple)
        if op == "<>":
            return not (x is None and y is None) and (node(x) or node(y) or type(x) is not type(y) or x != y) and x != y
        if x is None or y is None or node(x) or node(y) or type(x) is not type(y):
            return False
        if op in ("CONTAINS", "STARTS WITH", "ENDS WITH"):
            return isinstance(x, str) and {"CONTAINS": y in x if isinstance(y, str) else False, "STARTS WITH": str(x).startswith(str(y)), "ENDS WITH": str(x).endswith(str(y))}[op]
        return {"=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    cases = [(p, op, q) for p, q in itertools.product(values, values) for op in ("=", "<>", "<", "<=", ">", ">=", "CONTAINS", "STARTS WITH", "ENDS WITH")]
    p = Plan(g, parse("MATCH (a {name: 'feed'})-[:CALLS]->(b {name: 'scan'}) RETURN a.id").arms[0])
    r = p.rows()
    tests = [p.truth(parse(f"MATCH (a)-[:CALLS]->(b) WHERE {x} {op} {y} RETURN a.id").arms[0].where).alias(f"t{i}") for i, (x, op, y) in enumerate(cases)]
    got = r.select(*tests).first()
    wrong = [(c, got[i]) for i, c in enumerate(cases) if got[i] is not want(c[1], values[c[0]], values[c[2]])]
    assert not wrong, wrong[:10]


@pytest.mark.parametrize(
    "text, word",
    [
        ("MATCH (n) DELETE n", "read-only"), ("MATCH (n) WITH n RETURN n", "WITH"), ("MATCH (n:Nope) RETURN n", "unknown label"), ("MATCH (a)-[:NOPE]->(b) RETURN a", "unknown relationship"), ("MATCH (n) RETURN m.name", "not bound"),
        ("MATCH (n) RETURN upper(n.name)", "unknown function"), ("MATCH (n) RETURN n.name ORDER BY n.line", "ORDER BY"), ("MATCH (n) RETURN n.size", "unknown property"), ("MATCH (a)-[*1..9]->(b) RETURN a", "hops"), ("OPTIONAL MATCH (n) RETURN n", "must follow"),
        ("MATCH (n) RETURN n.name UNION MATCH (n) RETURN n.line", "same columns"), ("MATCH (n) RETURN 'open", "never closed"), ("MATCH (n) RETURN n.name; x", "unexpected character"), ("UNWIND [1] RETURN 1", "UNWIND"),
    ],
)
def test_refusals(g, text, word):
    with pytest.raises(QueryError, match=word):
        cypher(g, text)


def test_errors_carry_positions():
    with pytest.raises(QueryError, match=r"line 2, column 11"):
        parse("MATCH (n)\nRETURN n. 5")


def test_budget_and_rendering(g):
    with pytest.raises(QueryError, match="more than 3 rows"):
        cypher(g, "MATCH (n) RETURN n.id", budget=3)
    a = plan(g, parse("MATCH (a:Function)-[r:CALLS]->(b:Method) RETURN a, r, b.line AS line LIMIT 1"))
    text = to_table(a)
    assert "feed (sort/belt.go:7)" in text and "feed -> scan" in text
    import json

    got = json.loads(to_json(a))
    assert got["columns"] == ["a", "r", "line"] and got["rows"][0][2] == 31 and got["truncated"] is False
    page = plan(g, parse("MATCH (n) RETURN n.id LIMIT 1"))
    assert to_table(page).endswith("1 rows, more were left out") and to_table(plan(g, parse("MATCH (n:Component) RETURN n"))) == "no rows"


def test_counts_multiply_at_a_shared_node(spark):
    """Two patterns that meet at a hot node are counted from one row a node, not from the pairs of their matches."""
    n = spark.createDataFrame([(i, "r", "function" if i < 50 else "method", f"n{i}", "f", 1, 2, None, "observed", None, None) for i in range(100)], N)
    e = spark.createDataFrame([(i, 0, "calls" if i < 50 else "references", "EXTRACTED") for i in range(1, 100)] + [(7, 3, "calls", "EXTRACTED")], E)
    hot = PropertyGraph(n, e)
    text = "MATCH (a:Function)-[:CALLS]->(b), (c:Method)-[:REFERENCES]->(b) RETURN b.id AS id, count(*) AS n ORDER BY n DESC, id"
    assert [tuple(r) for r in cypher(hot, text).collect()] == [(0, 49 * 50)]
    assert Plan(hot, parse(text).arms[0]).rows(fold=True).count() == 50
    where = "MATCH (a:Function)-[:CALLS]->(b), (c:Method)-[:REFERENCES]->(b) WHERE a.id < 3 RETURN a.name AS name, count(*) AS n ORDER BY name"
    assert [tuple(r) for r in cypher(hot, where).collect()] == [("n1", 50), ("n2", 50)]
    assert [tuple(r) for r in cypher(hot, "MATCH (a:Function)-[:CALLS]->(b), (c:Struct)-[:REFERENCES]->(b) RETURN count(*) AS n").collect()] == []
