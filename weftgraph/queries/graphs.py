"""Graph algorithms over the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import load, lookup_table, stable_ids, with_graph
from weftgraph.operators import graph_algos as A
from weftgraph.operators.views import distribution
from weftgraph.session import table

_TEST = r"regexp_matches(lower({0}), '(^|/)tests/|test_|_test\.|\.test\.|\.spec\.')"
_DEG = "d AS (SELECT id, sum(i) AS in_degree, sum(o) AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM g_edges UNION ALL SELECT dst, 1, 0 FROM g_edges) x GROUP BY id)"


def s21_nodes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).nodes.select("id", "kind", "name", "file_path", "start_line", "end_line", "perspective")


def s21_edges(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).edges


def s22_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup_table(load(spark, d))


def a06_degree(spark: SparkSession, d: str) -> DataFrame:
    return A.degrees(load(spark, d))


def a07_confidence(spark: SparkSession, d: str) -> DataFrame:
    return A.confidence_histogram(load(spark, d))


def a08_kind_classes(spark: SparkSession, d: str) -> DataFrame:
    return A.kind_classes(load(spark, d))


def a15_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of the files per index pass, by repository."""
    return distribution(table(spark, d, "index_summaries"), "repo", "files")


def t01_god_nodes(spark: SparkSession, d: str) -> DataFrame:
    return A.god_nodes(load(spark, d))


def t02_report_gods(spark: SparkSession, d: str) -> DataFrame:
    return A.report_god_nodes(load(spark, d))


def t03_digest_hubs(spark: SparkSession, d: str) -> DataFrame:
    return A.digest_hubs(load(spark, d))


def t04_hot_symbols(spark: SparkSession, d: str) -> DataFrame:
    return A.hot_symbols(load(spark, d))


def t05_search_hints(spark: SparkSession, d: str) -> DataFrame:
    return A.search_hints(load(spark, d))


def _hundredth(spark: SparkSession, d: str) -> DataFrame:
    """The query set of searches: every node whose id is divisible by 100."""
    return load(spark, d).nodes.where("id % 100 = 0").select("id")


def g01_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return A.one_hop(load(spark, d), "both", _hundredth(spark, d))


def g02_impact(spark: SparkSession, d: str) -> DataFrame:
    """What a change of all database tables touches, as one root."""
    g = load(spark, d)
    seeds = g.nodes.where("kind = 'database_table'").select(F.lit(0).cast("bigint").alias("root"), "id")
    return A.impact(g, seeds).select("id", "depth", "name", "file_path")


def g02_impact_each(spark: SparkSession, d: str) -> DataFrame:
    """Two levels around each node of the query set."""
    g = load(spark, d)
    return A.impact(g, _hundredth(spark, d).select(F.col("id").alias("root"), "id"), 2).select("root", "id", "depth", "edge_kind", "confidence")


def g03_affected_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests that depend on the files that were fetched first of each repository."""
    g = load(spark, d)
    changed = table(spark, d, "source_files").groupBy("repo").agg(F.min_by("file_path", F.struct("fetched_at", "file_id")).alias("file_path")).select(F.lit(0).cast("bigint").alias("root"), "repo", "file_path")
    return A.affected_tests(g, changed).select("repo", "file_path")


def g05_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    ends = g.nodes.where("kind = 'doc'").agg(F.min("id"), F.max("id")).first()
    return A.shortest_path(g, ends[0], ends[1]).select("step", "id")


def g05_path_length(spark: SparkSession, d: str) -> DataFrame:
    """How many steps the shortest path has between the first and the last document."""
    return g05_shortest_path(spark, d).agg(F.max("step").alias("steps"))


def g06_dependents(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return A.dependents(g, g.nodes.where("kind = 'endpoint'").select(F.lit(0).cast("bigint").alias("root"), "id")).select("id")


def g07_components(spark: SparkSession, d: str) -> DataFrame:
    return A.components(load(spark, d))


def g07_label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return A.label_propagation(load(spark, d))


def g07_communities(spark: SparkSession, d: str) -> DataFrame:
    return A.communities(load(spark, d))


def g08_entrypoints(spark: SparkSession, d: str) -> DataFrame:
    return A.entrypoints(load(spark, d))


def g09_processes(spark: SparkSession, d: str) -> DataFrame:
    return A.processes(load(spark, d))


def g10_listing(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return A.listing(A.communities(g), g, "parse")


def g11_stats(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return A.graph_stats(g, A.communities(g), A.processes(g))


def g12_rename_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a rename of every uniquely defined function would touch."""
    g = load(spark, d)
    names = g.nodes.where("kind = 'function'").select("repo", "name")
    return A.rename_plan(g, table(spark, d, "source_files"), names)


def x08_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return stable_ids(load(spark, d).nodes).select("id", "external_id")


QUERIES = {
    f.__name__: f
    for f in (
        s21_nodes, s21_edges, s22_lookup, a06_degree, a07_confidence, a08_kind_classes, a15_distribution, t01_god_nodes, t02_report_gods, t03_digest_hubs, t04_hot_symbols, t05_search_hints, g01_neighbors, g02_impact,
        g02_impact_each, g03_affected_tests, g05_shortest_path, g05_path_length, g06_dependents, g07_components, g07_label_propagation, g07_communities, g08_entrypoints, g09_processes, g10_listing, g11_stats, g12_rename_plan, x08_stable_ids,
    )
}

_ORACLE = {
    "s21_nodes": "SELECT id, kind, name, file_path, start_line, end_line, perspective FROM g_nodes",
    "s21_edges": "SELECT src, dst, kind, confidence FROM g_edges",
    "s22_lookup": "SELECT name, min(id) AS id, count(DISTINCT file_path) AS files FROM g_nodes GROUP BY name",
    "a06_degree": f"WITH {_DEG} SELECT id, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, degree FROM d",
    "a07_confidence": "SELECT kind, confidence, count(*) AS edges FROM g_edges GROUP BY 1, 2",
    "a08_kind_classes": """SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'doc') AS docs, count(*) FILTER (kind IN ('endpoint', 'schema')) AS contracts,
        count(*) FILTER (kind IN ('database_table', 'database_column', 'infra_resource')) AS artifacts, count(*) FILTER (kind NOT IN ('file', 'doc', 'endpoint', 'schema', 'database_table', 'database_column', 'infra_resource')) AS symbols,
        (SELECT count(*) FROM g_edges) AS edges FROM g_nodes""",
    "a15_distribution": """WITH r AS (SELECT repo, files, row_number() OVER (PARTITION BY repo ORDER BY files) - 1 AS k, count(*) OVER (PARTITION BY repo) - 1 AS last FROM index_summaries WHERE files IS NOT NULL)
        SELECT repo, min(files) AS low, max(files) FILTER (k = ceil(last * 50 / 100)) AS p50, max(files) FILTER (k = ceil(last * 95 / 100)) AS p95, max(files) AS high, round(avg(files), 6) AS mean FROM r GROUP BY repo""",
    "t01_god_nodes": f"WITH {_DEG} SELECT n.id, name, kind, file_path, coalesce(degree, 0) AS degree FROM g_nodes n LEFT JOIN d ON d.id = n.id ORDER BY degree DESC, name NULLS FIRST, n.id LIMIT 10",
    "t02_report_gods": f"WITH {_DEG} SELECT n.id, name, kind, file_path, coalesce(degree, 0) AS degree FROM g_nodes n LEFT JOIN d ON d.id = n.id WHERE (SELECT count(*) FROM g_nodes WHERE kind = 'file') >= 5 ORDER BY degree DESC, n.id LIMIT 10",
    "t03_digest_hubs": f"WITH {_DEG} SELECT n.id, concat_ws(':', file_path, name) AS label, CAST(in_degree AS BIGINT) AS in_degree FROM g_nodes n JOIN d ON d.id = n.id WHERE kind NOT IN ('file', 'doc') AND in_degree > 0 ORDER BY in_degree DESC, label, n.id LIMIT 5",
    "t04_hot_symbols": f"""WITH {_DEG}, r AS (SELECT repo, file_path, name, n.id, CAST(in_degree AS BIGINT) AS in_degree, row_number() OVER (PARTITION BY repo, file_path ORDER BY in_degree DESC, name NULLS FIRST, n.id) AS rank
        FROM g_nodes n JOIN d ON d.id = n.id WHERE in_degree >= 5 AND kind NOT IN ('file', 'doc')) SELECT * FROM r WHERE rank <= 3""",
    "t05_search_hints": """WITH n AS (SELECT name, file_path FROM g_nodes WHERE kind NOT IN ('file', 'doc') AND regexp_matches(name, '^[A-Za-z_]\\w*$')),
        f AS (SELECT name, file_path, row_number() OVER (PARTITION BY name ORDER BY file_path) AS r FROM (SELECT DISTINCT name, file_path FROM n) x)
        SELECT n.name, n.definitions, f.files FROM (SELECT name, count(*) AS definitions FROM n GROUP BY 1) n JOIN (SELECT name, string_agg(file_path, ', ' ORDER BY file_path) AS files FROM f WHERE r <= 3 GROUP BY 1) f ON f.name = n.name""",
    "g01_neighbors": """WITH e AS (SELECT dst AS id, src AS other, kind, confidence, 'in' AS direction FROM g_edges UNION ALL SELECT src, dst, kind, confidence, 'out' FROM g_edges)
        SELECT e.id, direction, e.kind, confidence, other, o.kind AS other_kind, o.name AS other_name, o.file_path AS other_file FROM e JOIN g_nodes q ON q.id = e.id AND q.id % 100 = 0 JOIN g_nodes o ON o.id = e.other""",
    "g02_impact": """WITH RECURSIVE b(id, depth) AS (SELECT id, 0 FROM g_nodes WHERE kind = 'database_table' UNION SELECT e.src, b.depth + 1 FROM b JOIN g_edges e ON e.dst = b.id WHERE b.depth < 20)
        SELECT n.id, m.depth, n.name, n.file_path FROM (SELECT id, min(depth) AS depth FROM b GROUP BY id) m JOIN g_nodes n ON n.id = m.id WHERE m.depth > 0""",
    "g02_impact_each": """WITH s AS (SELECT id FROM g_nodes WHERE id % 100 = 0),
        one AS (SELECT s.id AS root, e.src AS id, min((e.dst, e.kind, e.confidence)) AS f FROM s JOIN g_edges e ON e.dst = s.id WHERE e.src <> s.id GROUP BY 1, 2),
        two AS (SELECT root, e.src AS id, min((e.dst, e.kind, e.confidence)) AS f FROM one JOIN g_edges e ON e.dst = one.id WHERE e.src <> root GROUP BY 1, 2),
        u AS (SELECT root, id, 1 AS depth, f FROM one UNION ALL SELECT root, id, 2, f FROM two WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.root = two.root AND o.id = two.id))
        SELECT root, u.id, depth, f[2] AS edge_kind, f[3] AS confidence FROM u JOIN g_nodes n ON n.id = u.id""",
    "g03_affected_tests": f"""WITH RECURSIVE c AS (SELECT repo, arg_min(file_path, (fetched_at, file_id)) AS file_path FROM source_files GROUP BY repo),
        b(id, depth) AS (SELECT n.id, 0 FROM g_nodes n JOIN c ON c.repo = n.repo AND c.file_path = n.file_path UNION SELECT e.src, b.depth + 1 FROM b JOIN g_edges e ON e.dst = b.id WHERE b.depth < 21)
        SELECT DISTINCT n.repo, n.file_path FROM (SELECT DISTINCT id FROM b WHERE depth > 0) x JOIN g_nodes n ON n.id = x.id WHERE {_TEST.format('n.file_path')} AND NOT EXISTS (SELECT 1 FROM c WHERE c.repo = n.repo AND c.file_path = n.file_path)""",
    "g05_path_length": """WITH RECURSIVE und AS (SELECT src AS a, dst AS b FROM g_edges UNION SELECT dst, src FROM g_edges), b(id, depth) AS (SELECT min(id), 0 FROM g_nodes WHERE kind = 'doc' UNION SELECT u.b, b.depth + 1 FROM b JOIN und u ON u.a = b.id JOIN g_nodes n ON n.id = u.b WHERE b.depth < 16)
        SELECT min(depth) AS steps FROM b WHERE id = (SELECT max(id) FROM g_nodes WHERE kind = 'doc')""",
    "g06_dependents": """WITH RECURSIVE b(id) AS (SELECT id FROM g_nodes WHERE kind = 'endpoint' UNION SELECT e.src FROM b JOIN g_edges e ON e.dst = b.id) SELECT id FROM b WHERE id NOT IN (SELECT id FROM g_nodes WHERE kind = 'endpoint')""",
    "g07_components": """WITH RECURSIVE und AS (SELECT src AS a, dst AS b FROM g_edges UNION SELECT dst, src FROM g_edges), r(id, root) AS (SELECT id, id FROM (SELECT min(id) AS id FROM g_nodes) x UNION SELECT u.b, r.root FROM r JOIN und u ON u.a = r.id),
        giant AS (SELECT id FROM r) SELECT id, id AS component FROM g_nodes WHERE id NOT IN (SELECT id FROM giant) UNION ALL SELECT id, (SELECT min(id) FROM giant) FROM g_nodes WHERE id IN (SELECT id FROM giant)""",
    "g08_entrypoints": "SELECT id FROM g_nodes WHERE kind = 'function' AND name IN ('main', 'Main') UNION SELECT e.src FROM g_edges e JOIN g_nodes n ON n.id = e.dst AND n.kind = 'endpoint' JOIN g_nodes s ON s.id = e.src WHERE e.kind = 'implements'",
    "g12_rename_plan": """WITH own AS (SELECT n.repo, n.name, count(*) AS k, min(n.id) AS id, min(n.file_path) AS file_path FROM g_nodes n JOIN (SELECT DISTINCT repo, name FROM g_nodes WHERE kind = 'function') f ON f.repo = n.repo AND f.name = n.name WHERE n.kind NOT IN ('file', 'doc') GROUP BY 1, 2 HAVING count(*) = 1),
        touched AS (SELECT repo, name, file_path FROM own UNION SELECT o.repo, o.name, s.file_path FROM own o JOIN g_edges e ON e.dst = o.id AND e.confidence <> 'AMBIGUOUS' AND e.kind <> 'explains' JOIN g_nodes s ON s.id = e.src AND s.repo = o.repo),
        t AS (SELECT DISTINCT repo, file_path, text FROM source_files WHERE text IS NOT NULL),
        c AS (SELECT x.name, x.repo, x.file_path, len(regexp_extract_all(' ' || replace(t.text, x.name, ' ' || chr(1) || ' '), chr(1))) AS any_hits, len(regexp_extract_all(t.text, '(^|[^\\p{L}\\p{N}_])' || regexp_escape(x.name) || '\\b')) AS occurrences FROM touched x JOIN t ON t.repo = x.repo AND t.file_path = x.file_path)
        SELECT name, repo, file_path, CAST(occurrences AS BIGINT) AS occurrences FROM c WHERE occurrences > 0""",
}
ORACLE = {k: with_graph(v) for k, v in _ORACLE.items()}
