"""Plans of stored graphs: pruning, pushed filters, narrow scans, no Python and no cross joins in pattern queries."""

import re

import pytest

from weftgraph.graph import load
from weftgraph.operators import hot_keys
from weftgraph.plans.planner import cypher
from weftgraph.sinks import export
from weftgraph.session import table


@pytest.fixture(scope="module")
def stored(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("graph"))
    g = load(spark, data)
    export.write_columnar(g, path)
    return export.read_columnar(spark, path), g


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


QUERY = "MATCH (a:Function)-[:CALLS]->(b) WHERE a.line > 5 RETURN b.kind AS kind, count(*) AS n ORDER BY kind"


def test_stored_graph_answers_alike(stored):
    for q in (QUERY, "MATCH (a:Endpoint)-[:CALLS*1..2]->(b) RETURN count(*) AS n", "MATCH (a:Struct) OPTIONAL MATCH (a)-[r:IMPORTS]->(b) RETURN a.id AS id, r.confidence AS c, b.name AS name LIMIT 1000"):
        assert sorted(map(str, cypher(stored[0], q).collect())) == sorted(map(str, cypher(stored[1], q).collect()))


def test_labels_prune_and_filters_are_pushed(stored):
    plan = plan_of(cypher(stored[0], QUERY))
    assert re.search(r"PartitionFilters: \[[^\]]*kind[^\]]*function", plan) and re.search(r"PartitionFilters: \[[^\]]*kind[^\]]*calls", plan)
    assert "GreaterThan(start_line,5)" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_scans_read_only_what_is_used(stored):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(cypher(stored[0], QUERY)))
    assert schemas and all("name" not in s and "description" not in s and "confidence" not in s for s in schemas)


def test_hot_key_counts_combine_before_they_shuffle(spark, data):
    plan = plan_of(hot_keys.pair_counts(table(spark, data, "edges"), "dst", "src", "kind"))
    assert plan.count("Exchange hashpartitioning") == 3 and "ReadSchema: struct<src:bigint,dst:bigint,kind:string>" in plan
    # no raw row is shuffled: below each exchange stands an aggregate of the same task
    lines = plan.split("\n")
    assert all("HashAggregate" in lines[k + 1] for k, x in enumerate(lines) if "Exchange hashpartitioning" in x)


def test_loops_clean_their_edges_once(spark, data):
    from weftgraph.operators import graph_algos as A

    g = load(spark, data)
    seeds = g.nodes.where("kind = 'endpoint'").selectExpr("0L as root", "id")
    # what comes back reads rounds that were written, never the raw edges
    assert "edges.parquet" not in plan_of(A.reach(A.against(g), seeds, 3))


def test_searches_tokenise_once(spark, data):
    from weftgraph.operators import retrieval as R

    n = load(spark, data).nodes.select("id", "name", "description")
    found = R.search(n, n.where("id < 20").selectExpr("id as query_id", "name as text"))
    assert plan_of(found).count("Generate explode(concat") == 0
