"""Pattern queries over the whole graph, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.graph import load, with_graph
from weftgraph.plans.planner import cypher

_PAGE = "ORDER BY {0} LIMIT {1}"

#: name: (query text, DuckDB text over g_nodes and g_edges)
PAIRS: dict[str, tuple[str, str]] = {
    "a01_busiest_callers": (
        "MATCH (a:Function)-[:CALLS]->(b) RETURN a.file AS file, count(*) AS calls ORDER BY calls DESC LIMIT 10",
        "SELECT a.file_path AS file, count(*) AS calls FROM g_nodes a JOIN g_edges e ON e.src = a.id AND e.kind = 'calls' JOIN g_nodes b ON b.id = e.dst WHERE a.kind = 'function' GROUP BY 1 ORDER BY calls DESC, file LIMIT 10",
    ),
    "q03_label_scan": (
        "MATCH (n:Component) RETURN n.id AS id, n.name AS name, n.file AS file, n.line AS line LIMIT 1000",
        "SELECT id, name, file_path AS file, CAST(start_line AS BIGINT) AS line FROM g_nodes WHERE kind = 'component' ORDER BY id LIMIT 1000",
    ),
    "q04_property_map": (
        "MATCH (n {kind: 'struct'}) WHERE n.line < 40 RETURN n.id AS id, n.line AS line LIMIT 1000",
        "SELECT id, CAST(start_line AS BIGINT) AS line FROM g_nodes WHERE kind = 'struct' AND start_line < 40 ORDER BY id LIMIT 1000",
    ),
    "q05_hop_out": (
        "MATCH (a:Function)-[:CALLS]->(b:Method) RETURN a.file AS file, b.kind AS kind, count(*) AS n ORDER BY n DESC, file LIMIT 1000",
        "SELECT a.file_path AS file, b.kind AS kind, count(*) AS n FROM g_nodes a JOIN g_edges e ON e.src = a.id AND e.kind = 'calls' JOIN g_nodes b ON b.id = e.dst WHERE a.kind = 'function' AND b.kind = 'method' GROUP BY 1, 2 ORDER BY n DESC, file LIMIT 1000",
    ),
    "q06_hop_in": (
        "MATCH (a:Struct)<-[:IMPLEMENTS]-(b) RETURN a.name AS name, count(b) AS n ORDER BY n DESC, name LIMIT 1000",
        "SELECT a.name AS name, count(b.id) AS n FROM g_nodes a JOIN g_edges e ON e.dst = a.id AND e.kind = 'implements' JOIN g_nodes b ON b.id = e.src WHERE a.kind = 'struct' GROUP BY 1 ORDER BY n DESC, name LIMIT 1000",
    ),
    "q07_undirected": (
        "MATCH (a:Doc)-[:EXPLAINS]-(b) RETURN a.id AS id, count(*) AS n ORDER BY n DESC, id LIMIT 1000",
        "SELECT a.id AS id, count(*) AS n FROM g_nodes a JOIN (SELECT src AS f, dst AS t FROM g_edges WHERE kind = 'explains' UNION ALL SELECT dst, src FROM g_edges WHERE kind = 'explains') e ON e.f = a.id JOIN g_nodes b ON b.id = e.t WHERE a.kind = 'doc' GROUP BY 1 ORDER BY n DESC, id LIMIT 1000",
    ),
    "q08_type_filter": (
        "MATCH (a)-[r:INHERITS|IMPLEMENTS]->(b) RETURN r.type AS type, r.confidence AS confidence, count(*) AS n ORDER BY type, confidence",
        "SELECT upper(e.kind) AS type, e.confidence AS confidence, count(*) AS n FROM g_edges e JOIN g_nodes a ON a.id = e.src JOIN g_nodes b ON b.id = e.dst WHERE e.kind IN ('inherits', 'implements') GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 100",
    ),
    "q09_variable_length": (
        "MATCH (a:Endpoint)-[:IMPORTS|INHERITS*1..3]->(b:File) RETURN a.kind AS source, b.kind AS target, count(*) AS paths",
        """SELECT 'endpoint' AS source, 'file' AS target, count(*) AS paths FROM (
            WITH e AS (SELECT g.src, g.dst, g.kind FROM g_edges g JOIN g_nodes b ON b.id = g.dst WHERE g.kind IN ('imports', 'inherits'))
            SELECT e1.dst AS t FROM g_nodes a JOIN e e1 ON e1.src = a.id WHERE a.kind = 'endpoint'
            UNION ALL SELECT e2.dst FROM g_nodes a JOIN e e1 ON e1.src = a.id JOIN e e2 ON e2.src = e1.dst WHERE a.kind = 'endpoint' AND (e1.src, e1.dst, e1.kind) <> (e2.src, e2.dst, e2.kind)
            UNION ALL SELECT e3.dst FROM g_nodes a JOIN e e1 ON e1.src = a.id JOIN e e2 ON e2.src = e1.dst JOIN e e3 ON e3.src = e2.dst WHERE a.kind = 'endpoint'
              AND (e1.src, e1.dst, e1.kind) <> (e2.src, e2.dst, e2.kind) AND (e1.src, e1.dst, e1.kind) <> (e3.src, e3.dst, e3.kind) AND (e2.src, e2.dst, e2.kind) <> (e3.src, e3.dst, e3.kind)
          ) p JOIN g_nodes b ON b.id = p.t WHERE b.kind = 'file' HAVING count(*) > 0""",
    ),
    "q10_path_properties": (
        "MATCH (a:Endpoint)-[r:CALLS*2]->(b) RETURN count(r.type) AS typed, count(r) AS paths",
        """SELECT CAST(0 AS BIGINT) AS typed, count(*) AS paths FROM g_nodes a JOIN g_edges e1 ON e1.src = a.id AND e1.kind = 'calls' JOIN g_nodes m ON m.id = e1.dst
           JOIN g_edges e2 ON e2.src = m.id AND e2.kind = 'calls' JOIN g_nodes b ON b.id = e2.dst WHERE a.kind = 'endpoint' AND (e1.src, e1.dst) <> (e2.src, e2.dst) HAVING count(*) > 0""",
    ),
    "q11_shared_variable": (
        "MATCH (a:Function)-[:CALLS]->(b), (c:Method)-[:REFERENCES]->(b) RETURN b.id AS id, count(*) AS n ORDER BY n DESC, id LIMIT 1000",
        """SELECT b.id AS id, count(*) AS n FROM g_nodes a JOIN g_edges e ON e.src = a.id AND e.kind = 'calls' JOIN g_nodes b ON b.id = e.dst
           JOIN g_edges f ON f.dst = b.id AND f.kind = 'references' JOIN g_nodes c ON c.id = f.src AND c.kind = 'method' WHERE a.kind = 'function' GROUP BY 1 ORDER BY n DESC, id LIMIT 1000""",
    ),
    "q12_optional": (
        "MATCH (a:Endpoint) OPTIONAL MATCH (a)-[:IMPLEMENTS]->(b:Struct) RETURN a.id AS id, count(b) AS n ORDER BY n DESC, id LIMIT 1000",
        """SELECT a.id AS id, count(p.dst) AS n FROM g_nodes a LEFT JOIN (SELECT e.src, e.dst FROM g_edges e JOIN g_nodes b ON b.id = e.dst AND b.kind = 'struct' WHERE e.kind = 'implements') p ON p.src = a.id
           WHERE a.kind = 'endpoint' GROUP BY 1 ORDER BY n DESC, id LIMIT 1000""",
    ),
    "q13_comparisons": (
        "MATCH (a)-[:REFERENCES]->(b) WHERE a.line <= b.line AND a.kind <> b.kind AND NOT a.name = 10 RETURN a.kind AS kind, count(*) AS n ORDER BY kind",
        "SELECT a.kind AS kind, count(*) AS n FROM g_nodes a JOIN g_edges e ON e.src = a.id AND e.kind = 'references' JOIN g_nodes b ON b.id = e.dst WHERE coalesce(a.start_line <= b.start_line, false) AND a.kind IS DISTINCT FROM b.kind GROUP BY 1 ORDER BY 1 LIMIT 100",
    ),
    "q14_text_tests": (
        "MATCH (n) WHERE n.name STARTS WITH 'parse' AND n.file ENDS WITH '.py' AND NOT n.name CONTAINS 'token' RETURN n.kind AS kind, count(*) AS n ORDER BY kind",
        "SELECT kind, count(*) AS n FROM g_nodes WHERE coalesce(starts_with(name, 'parse'), false) AND coalesce(suffix(file_path, '.py'), false) AND NOT coalesce(contains(name, 'token'), false) GROUP BY 1 ORDER BY 1 LIMIT 100",
    ),
    "q15_in_list": (
        "MATCH (n) WHERE n.kind IN ['doc', 'schema', 3] RETURN n.kind AS kind, count(*) AS n ORDER BY kind",
        "SELECT kind, count(*) AS n FROM g_nodes WHERE kind IN ('doc', 'schema') GROUP BY 1 ORDER BY 1 LIMIT 100",
    ),
    "q16_is_null": (
        "MATCH (n) WHERE n.confidence IS NULL AND n.name IS NOT NULL RETURN count(*) AS n",
        "SELECT count(*) AS n FROM g_nodes WHERE name IS NOT NULL HAVING count(*) > 0",
    ),
    "q17_precedence": (
        "MATCH (n) WHERE n.kind = 'doc' OR n.kind = 'method' AND NOT (n.line > 100 OR n.line < 50) RETURN n.kind AS kind, count(*) AS n ORDER BY kind",
        "SELECT kind, count(*) AS n FROM g_nodes WHERE kind = 'doc' OR (kind = 'method' AND NOT (coalesce(start_line > 100, false) OR coalesce(start_line < 50, false))) GROUP BY 1 ORDER BY 1 LIMIT 100",
    ),
    "q21_distinct": (
        "MATCH (a:Endpoint)-[:CALLS]->(b) RETURN DISTINCT b.kind AS kind, a.file AS file ORDER BY file DESC, kind LIMIT 1000",
        "SELECT DISTINCT b.kind AS kind, a.file_path AS file FROM g_nodes a JOIN g_edges e ON e.src = a.id AND e.kind = 'calls' JOIN g_nodes b ON b.id = e.dst WHERE a.kind = 'endpoint' ORDER BY file DESC NULLS FIRST, kind LIMIT 1000",
    ),
    "q22_order": (
        "MATCH (n:Method) RETURN n.name AS name, n.line AS line, n.id AS id ORDER BY name DESC, line SKIP 20 LIMIT 500",
        "SELECT name, CAST(start_line AS BIGINT) AS line, id FROM g_nodes WHERE kind = 'method' ORDER BY name DESC NULLS FIRST, line NULLS LAST, id LIMIT 500 OFFSET 20",
    ),
    "q24_union": (
        "MATCH (n:Doc) RETURN n.kind AS kind, count(*) AS n UNION MATCH (n:Schema) RETURN n.kind AS kind, count(*) AS n UNION ALL MATCH (n:Doc) RETURN n.kind AS kind, count(*) AS n",
        "SELECT kind, count(*) AS n FROM g_nodes WHERE kind = 'doc' GROUP BY 1 UNION ALL SELECT kind, count(*) FROM g_nodes WHERE kind = 'schema' GROUP BY 1 UNION ALL SELECT kind, count(*) FROM g_nodes WHERE kind = 'doc' GROUP BY 1",
    ),
    "a02_count_values": (
        "MATCH (n) RETURN n.kind AS kind, count(*) AS rows, count(n.line) AS lines ORDER BY kind",
        "SELECT kind, count(*) AS rows, count(start_line) AS lines FROM g_nodes GROUP BY 1 ORDER BY 1 LIMIT 100",
    ),
    "a04_min_max": (
        "MATCH (n)-[:CALLS]->(m) RETURN n.kind AS kind, min(m.line) AS low, max(m.line) AS high, min(m.name) AS first, max(m.name) AS last ORDER BY kind",
        "SELECT n.kind AS kind, CAST(min(m.start_line) AS BIGINT) AS low, CAST(max(m.start_line) AS BIGINT) AS high, min(m.name) AS first, max(m.name) AS last FROM g_nodes n JOIN g_edges e ON e.src = n.id AND e.kind = 'calls' JOIN g_nodes m ON m.id = e.dst GROUP BY 1 ORDER BY 1 LIMIT 100",
    ),
    "a05_sum_avg": (
        "MATCH (n) RETURN n.kind AS kind, sum(n.line) AS total, avg(n.end_line) AS mean, sum(n.name) AS nothing ORDER BY kind",
        "SELECT kind, CAST(sum(start_line) AS BIGINT) AS total, avg(end_line) AS mean, CAST(NULL AS DOUBLE) AS nothing FROM g_nodes GROUP BY 1 ORDER BY 1 LIMIT 100",
    ),
}


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: cypher(load(spark, d), text)


def a03_collect(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    got = cypher(load(spark, d), "MATCH (a:Schema)<-[:REFERENCES]-(b) RETURN a.id AS id, collect(b.kind) AS kinds ORDER BY id LIMIT 1000")
    return got.select("id", F.array_join("kinds", ",").alias("kinds"))


def q20_return_node(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    got = cypher(load(spark, d), "MATCH (a:Endpoint)-[r:CALLS]->(b) RETURN a, r, b LIMIT 50")
    return got.select(F.to_json("a").alias("a"), F.to_json("r").alias("r"), F.to_json("b").alias("b"))


def q20_return_path(spark: SparkSession, d: str) -> DataFrame:
    """Returned paths, whose steps show the names of their ends."""
    from pyspark.sql import functions as F

    got = cypher(load(spark, d), "MATCH (a:Endpoint)-[r:CALLS*2]->(b:Method) RETURN a.id AS id, r, b.id AS last LIMIT 1000")
    show = F.array_join(F.transform("r", lambda e: F.concat_ws(" ", e["source"], e["type"], e["target"], e["confidence"])), "; ")
    return got.select("id", show.alias("path"), "last")


QUERIES = {k: _run(text) for k, (text, _) in PAIRS.items()} | {"a03_collect": a03_collect, "q20_return_node": q20_return_node, "q20_return_path": q20_return_path}
ORACLE = {k: with_graph(sql) for k, (_, sql) in PAIRS.items()} | {
    "q20_return_path": with_graph(
        """SELECT id, path, last FROM (SELECT a.id AS id, concat_ws(' ', a.name, 'CALLS', m.name, e.confidence) || '; ' || concat_ws(' ', m.name, 'CALLS', b.name, f.confidence) AS path, b.id AS last, row_number() OVER (ORDER BY a.id, e.src, e.dst, e.kind, f.dst, f.kind, b.id) AS k
        FROM g_nodes a JOIN g_edges e ON e.src = a.id AND e.kind = 'calls' JOIN g_nodes m ON m.id = e.dst JOIN g_edges f ON f.src = m.id AND f.kind = 'calls' AND (f.src, f.dst) <> (e.src, e.dst) JOIN g_nodes b ON b.id = f.dst AND b.kind = 'method' WHERE a.kind = 'endpoint') x WHERE k <= 1000"""
    ),
    "a03_collect": with_graph(
        """SELECT a.id AS id, string_agg(b.kind, ',' ORDER BY b.id) AS kinds FROM g_nodes a JOIN g_edges e ON e.dst = a.id AND e.kind = 'references' JOIN g_nodes b ON b.id = e.src WHERE a.kind = 'schema' GROUP BY 1 ORDER BY 1 LIMIT 1000"""
    ),
}
