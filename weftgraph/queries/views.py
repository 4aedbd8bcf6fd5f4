"""Derived views and retrieval over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph, load, with_graph
from weftgraph.operators import graph_algos as A
from weftgraph.operators import retrieval as R
from weftgraph.operators import views as V
from weftgraph.session import table, written


def _states(g: PropertyGraph) -> tuple[PropertyGraph, PropertyGraph]:
    """Two states of one graph: what was declared, and all that is known now."""
    declared = g.nodes.where("perspective = 'declared'")
    return PropertyGraph(declared, g.edges.where("confidence = 'EXTRACTED'")), PropertyGraph(g.nodes, g.edges)


def v01_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return V.surfaces(load(spark, d))


def v02_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return V.mismatch_summary(V.surfaces(load(spark, d)))


def v02_route_map(spark: SparkSession, d: str) -> DataFrame:
    return V.surface_map(load(spark, d))


def v04_api_impact(spark: SparkSession, d: str) -> DataFrame:
    return V.api_impact(load(spark, d))


def _last_fetches(files: DataFrame) -> DataFrame:
    """(repo, number, files): a request of each repository, the files fetched on its last day; the day, as yyyymmdd, is its number."""
    f = files.where("repo is not null and fetched_at is not null").select("repo", F.to_date("fetched_at").alias("day"), "file_path")
    last = f.groupBy("repo").agg(F.max("day").alias("day"))
    return f.join(last, ["repo", "day"]).groupBy("repo", F.date_format("day", "yyyyMMdd").cast("bigint").alias("number")).agg(F.collect_set("file_path").alias("files"))


def v06_pr_insight(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose changed files are those of the repositories' latest fetches."""
    g = load(spark, d)
    prs = _last_fetches(table(spark, d, "source_files")).withColumn("draft", F.lit(False)).withColumn("checks", F.array(F.lit("SUCCESS")))
    return V.pr_insight(g, prs).select("repo", "number", "symbols", "hubs", "blast_radius", "tests", "risk", "band")


def v07_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """For each pull request whose number is divisible by 100: who else of its repository touches its hubs and communities."""
    last = written(V.latest_insights(table(spark, d, "insights")), "insights")
    return V.overlaps(last, last.where("number % 100 = 0").select("repo", "number"))


def v07_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.overlap_counts(table(spark, d, "insights"))


def v09_triage(spark: SparkSession, d: str) -> DataFrame:
    return V.triage(table(spark, d, "insights"))


def v10_diff(spark: SparkSession, d: str) -> DataFrame:
    return V.compare(*_states(load(spark, d)))


def v10_edge_diff(spark: SparkSession, d: str) -> DataFrame:
    return V.compare_edges(*_states(load(spark, d))).groupBy("kind", "change").agg(F.count(F.lit(1)).alias("edges"))


def a16_fan_in(spark: SparkSession, d: str) -> DataFrame:
    return V.fan_in_shift(*_states(load(spark, d)))


def v12_drift(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d).nodes
    return V.drift(n.where("kind = 'database_table' and perspective = 'declared'").select("name"), n.where("kind = 'database_table' and perspective = 'observed'").select("name"))


def v13_links(spark: SparkSession, d: str) -> DataFrame:
    return V.links_by_name(load(spark, d))


def v16_status(spark: SparkSession, d: str) -> DataFrame:
    return V.workspace_status(table(spark, d, "index_summaries"))


def v17_markers(spark: SparkSession, d: str) -> DataFrame:
    return V.why_hack(table(spark, d, "source_files"))


def _communities(spark: SparkSession, d: str):
    g = load(spark, d)
    return g, written(A.communities(g), "communities")


def a09_community_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.community_summary(*_communities(spark, d))


def a10_bundles(spark: SparkSession, d: str) -> DataFrame:
    return V.bundles(*_communities(spark, d))


def a11_folding(spark: SparkSession, d: str) -> DataFrame:
    return V.fold_tiny(*_communities(spark, d))


def _file_groups(g: PropertyGraph) -> DataFrame:
    """A stated partition for the SQL checks: the members of a file, numbered by its least id."""
    first = g.nodes.groupBy("repo", "file_path").agg(F.min("id").alias("community"))
    return g.nodes.select("id", "repo", "file_path").join(first, ["repo", "file_path"]).select("id", "community")


def a09_file_summary(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return V.community_summary(g, _file_groups(g))


def a10_file_bundles(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return V.bundles(g, _file_groups(g))


def a12_area_names(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return V.distinct_area_names(g, _file_groups(g))


def a13_areas(spark: SparkSession, d: str) -> DataFrame:
    return V.areas(*_communities(spark, d))


def a14_coupling(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    groups = _file_groups(g)
    return V.area_coupling(g, V.area_names(g, groups), groups)


# retrieval


def f01_search(spark: SparkSession, d: str) -> DataFrame:
    """The names of the query set as phrases, the last word a prefix."""
    n = load(spark, d).nodes
    return R.search(n.select("id", "name", "description"), n.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("name").alias("text"))).select("query_id", "id", "score")


def f01_word_search(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct first word of a name as an exact-or-prefix query."""
    n = load(spark, d).nodes.select("id", "name", "description")
    first = n.select(F.element_at(F.filter(R.tokens(F.col("name")), lambda t: t != ""), 1).alias("text")).where("text is not null").distinct()
    return R.search(n, first.select(F.col("text").alias("query_id"), "text"), 5).select("query_id", "id", "score", "rank")


def f02_explore(spark: SparkSession, d: str) -> DataFrame:
    """The questions of all entries, each text ranked once."""
    q = written(R.entries(table(spark, d, "memory_entries")).where("question is not null").select("id", F.col("question").alias("text")), "questions")
    texts = written(q.groupBy("text").agg(F.min("id").alias("query_id")), "texts")
    got = R.explore(load(spark, d), texts)
    same = q.join(texts.hint("merge"), "text").select(F.col("id").alias("own"), "query_id")
    return got.join(same.hint("merge"), "query_id").select(F.col("own").alias("query_id"), *(c for c in got.columns if c != "query_id"))


def f03_cards(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d)
    return R.cards(g, g.nodes, table(spark, d, "source_files"))


def f04_semantic(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return R.semantic_top(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)


def f05_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return R.embedding_text(load(spark, d))


def f07_recall(spark: SparkSession, d: str) -> DataFrame:
    e = written(R.entries(table(spark, d, "memory_entries")), "entries")
    return R.recall(e, load(spark, d), e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "repo", F.col("question").alias("text")))


def a17_lessons(spark: SparkSession, d: str) -> DataFrame:
    return R.lessons(R.entries(table(spark, d, "memory_entries")), load(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        v01_surfaces, v02_mismatches, v02_route_map, v04_api_impact, v06_pr_insight, v07_overlaps, v07_overlap_counts, v09_triage, v10_diff, v10_edge_diff, a16_fan_in, v12_drift, v13_links, v16_status, v17_markers, a09_community_summary, a10_bundles, a11_folding,
        a09_file_summary, a10_file_bundles, a12_area_names, a13_areas, a14_coupling, f01_search, f01_word_search, f02_explore, f03_cards, f04_semantic, f05_embedding_text, f07_recall, a17_lessons,
    )
}

_SHAPE = """upper(regexp_extract({0}, '^(\\S+)\\s+', 1)) || ' ' || array_to_string(list_transform(string_split(CASE WHEN length(regexp_replace({0}, '^\\S+\\s+', '')) > 1 THEN regexp_replace(regexp_replace({0}, '^\\S+\\s+', ''), '/+$', '') ELSE regexp_replace({0}, '^\\S+\\s+', '') END, '/'), lambda p: CASE WHEN regexp_matches(p, '^(\\{{.*\\}}|:.+|<.*>|\\$.+|\\*|\\d+)$') THEN '*' ELSE p END), '/')"""
_SURF = f"""e AS (SELECT id, repo, name, {_SHAPE.format('name')} AS shape, perspective = 'declared' AS dec FROM g_nodes WHERE kind = 'endpoint'),
    u AS (SELECT e.repo, e.shape, count(DISTINCT x.src) FILTER (x.kind = 'implements') AS handlers, count(DISTINCT x.src) FILTER (x.kind = 'calls') AS consumers FROM e JOIN g_edges x ON x.dst = e.id AND x.kind IN ('implements', 'calls') GROUP BY 1, 2),
    s AS (SELECT repo, shape, coalesce(min(name) FILTER (dec), min(name)) AS name, bool_or(dec) AS declared, bool_or(NOT dec) AS observed FROM e GROUP BY 1, 2),
    f AS (SELECT s.repo, s.shape, name, declared, observed, coalesce(handlers, 0) AS handlers, coalesce(consumers, 0) AS consumers FROM s LEFT JOIN u ON u.repo IS NOT DISTINCT FROM s.repo AND u.shape = s.shape),
    t AS (SELECT *, CASE WHEN declared AND (observed OR handlers > 0) THEN 'matched' WHEN declared THEN 'declared only' WHEN observed AND handlers > 0 AND consumers = 0 THEN 'exposed' WHEN observed AND handlers > 0 THEN 'undeclared' ELSE 'unknown' END AS state FROM f)"""
_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, number ORDER BY computed_at DESC NULLS LAST, risk DESC NULLS LAST, blast_radius DESC NULLS LAST, title DESC NULLS LAST) AS r FROM insights) x WHERE r = 1)"
_ENT = "ent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at NULLS LAST, recorded NULLS LAST) AS r FROM memory_entries WHERE id IS NOT NULL) x WHERE r = 1)"
_GROUPS = "grp AS (SELECT n.id, f.community FROM g_nodes n JOIN (SELECT repo, file_path, min(id) AS community FROM g_nodes GROUP BY 1, 2) f ON f.repo = n.repo AND f.file_path = n.file_path)"
_Q = lambda perspective: f"(SELECT repo, kind || ' ' || name AS symbol, max(file_path) AS file_path FROM g_nodes WHERE name IS NOT NULL{perspective} GROUP BY 1, 2)"
_FOLD = "string_split_regex(translate(lower({0}), '" + R.MARKED + "', '" + R.FOLDED + "'), '[^\\p{{L}}\\p{{N}}]+')"
_DIR = "CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE file_path END"

ORACLE = {
    k: with_graph(v)
    for k, v in {
        "v01_surfaces": f"WITH {_SURF} SELECT * FROM t",
        "v02_mismatches": f"WITH {_SURF} SELECT repo, state, count(*) AS surfaces, CAST(sum(consumers) AS BIGINT) AS consumers FROM t GROUP BY 1, 2",
        "v02_route_map": f"""WITH {_SURF}, w AS (SELECT DISTINCT e.repo, e.shape, CASE x.kind WHEN 'implements' THEN 'handler' ELSE 'consumer' END AS role, n.name AS symbol, n.file_path, n.start_line AS line, x.confidence FROM e JOIN g_edges x ON x.dst = e.id AND x.kind IN ('implements', 'calls') JOIN g_nodes n ON n.id = x.src)
            SELECT t.repo, t.name, state, role, symbol, file_path, line, confidence FROM t LEFT JOIN w ON w.repo IS NOT DISTINCT FROM t.repo AND w.shape = t.shape WHERE NOT starts_with(t.shape, 'TOOL ')""",
        "v04_api_impact": """WITH RECURSIVE s AS (SELECT DISTINCT e.dst AS root, e.src AS id FROM g_edges e JOIN g_nodes n ON n.id = e.dst AND n.kind = 'endpoint' WHERE e.kind = 'implements'),
            b(root, id) AS (SELECT root, id FROM s UNION SELECT b.root, e.src FROM b JOIN g_edges e ON e.dst = b.id) SELECT root, count(*) AS dependents FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.root = b.root AND s.id = b.id) GROUP BY 1""",
        "v06_pr_insight": """WITH RECURSIVE f AS (SELECT repo, CAST(fetched_at AS DATE) AS day, file_path FROM source_files WHERE repo IS NOT NULL AND fetched_at IS NOT NULL), l AS (SELECT repo, max(day) AS day FROM f GROUP BY 1),
            p AS (SELECT DISTINCT f.repo, CAST(strftime(f.day, '%Y%m%d') AS BIGINT) AS number, f.file_path FROM f JOIN l ON l.repo = f.repo AND l.day = f.day),
            y AS (SELECT DISTINCT p.repo, p.number, n.id FROM p JOIN g_nodes n ON n.repo = p.repo AND n.file_path = p.file_path AND n.kind <> 'file'),
            hub AS (SELECT dst AS id FROM g_edges GROUP BY 1 HAVING count(*) >= 10),
            b(repo, number, id) AS (SELECT repo, number, id FROM y UNION SELECT b.repo, b.number, e.src FROM b JOIN g_edges e ON e.dst = b.id),
            d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.repo = b.repo AND y.number = b.number AND y.id = b.id)),
            u AS (SELECT p.repo, p.number, (SELECT count(*) FROM y WHERE y.repo = p.repo) AS symbols, (SELECT count(*) FROM y JOIN hub ON hub.id = y.id WHERE y.repo = p.repo) AS hubs, (SELECT count(*) FROM d WHERE d.repo = p.repo) AS blast_radius,
              (SELECT count(DISTINCT n.file_path) FROM d JOIN g_nodes n ON n.id = d.id WHERE d.repo = p.repo AND regexp_matches(lower(n.file_path), '(^|/)tests/|test_|_test\\.|\\.test\\.|\\.spec\\.')) AS tests FROM (SELECT DISTINCT repo, number FROM p) p),
            r AS (SELECT *, CAST(hubs * 3 + blast_radius // 25 + CASE WHEN symbols > 0 AND tests = 0 THEN 4 ELSE 0 END AS BIGINT) AS risk FROM u)
            SELECT repo, number, symbols, hubs, blast_radius, tests, risk, CASE WHEN risk >= 10 THEN 'high' WHEN risk >= 4 THEN 'medium' ELSE 'low' END AS band FROM r""",
        "f07_recall": f"""WITH {_ENT}, e AS (SELECT id, repo, recorded, nodes, CASE WHEN lower(trim(coalesce(outcome, ''))) IN ('worked', 'ok', 'good') THEN 'worked' WHEN lower(trim(coalesce(outcome, ''))) IN ('wrong', 'bad', 'failed') THEN 'wrong' ELSE 'open' END AS outcome,
              list_distinct(list_filter(string_split_regex(lower(question), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: strlen(x) > 2 AND x NOT IN ({', '.join(f"'{w}'" for w in sorted(R.NOISE))}))) AS words FROM ent),
            w AS (SELECT id, repo, unnest(words) AS w FROM e), s AS (SELECT q.id AS query_id, w.id, count(*) AS overlap FROM w q JOIN w ON w.repo = q.repo AND w.w = q.w WHERE q.id % 100 = 0 GROUP BY 1, 2),
            z AS (SELECT q.id AS query_id, e.id, 0 AS overlap FROM e q JOIN e ON e.repo = q.repo WHERE q.id % 100 = 0 AND len(q.words) = 0), a AS (SELECT * FROM s UNION ALL SELECT * FROM z),
            n AS (SELECT id, count(*) FILTER (there) AS present, count(*) FILTER (NOT there) AS missing FROM (SELECT x.id, EXISTS (SELECT 1 FROM g_nodes g WHERE g.repo = x.repo AND g.name = x.name) AS there FROM (SELECT DISTINCT id, repo, unnest(nodes) AS name FROM e) x) y GROUP BY 1),
            k AS (SELECT query_id, a.id, overlap, e.outcome, coalesce(present, 0) AS present, coalesce(missing, 0) AS missing, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, CASE e.outcome WHEN 'wrong' THEN 0 WHEN 'worked' THEN 1 ELSE 2 END, recorded DESC NULLS LAST, a.id) AS rank FROM a JOIN e ON e.id = a.id LEFT JOIN n ON n.id = a.id)
            SELECT query_id, id, overlap, outcome, present, missing, present = 0 OR missing > 0 AS stale, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10""",
        "v07_overlaps": f"""WITH {_LAST}, h AS (SELECT DISTINCT repo, number, unnest(hubs) AS k FROM last), c AS (SELECT DISTINCT repo, number, unnest(communities) AS k FROM last),
            x AS (SELECT a.repo, a.number AS l, b.number AS r, count(*) AS n FROM h a JOIN h b ON b.repo = a.repo AND b.k = a.k AND b.number <> a.number WHERE a.number % 100 = 0 GROUP BY 1, 2, 3),
            y AS (SELECT a.repo, a.number AS l, b.number AS r, count(*) AS n FROM c a JOIN c b ON b.repo = a.repo AND b.k = a.k AND b.number <> a.number WHERE a.number % 100 = 0 GROUP BY 1, 2, 3)
            SELECT coalesce(x.repo, y.repo) AS repo, coalesce(x.l, y.l) AS "left", coalesce(x.r, y.r) AS "right", coalesce(x.n, 0) AS shared_hubs, coalesce(y.n, 0) AS shared_communities, CASE WHEN coalesce(x.n, 0) > 0 THEN 'semantic' ELSE 'adjacent' END AS severity
            FROM x FULL JOIN y ON y.repo = x.repo AND y.l = x.l AND y.r = x.r""",
        "v07_overlap_counts": f"WITH {_LAST} SELECT repo, hub, count(*) AS pull_requests, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS pairs FROM (SELECT DISTINCT repo, number, unnest(hubs) AS hub FROM last) h WHERE hub IS NOT NULL GROUP BY 1, 2",
        "v09_triage": f"WITH {_LAST} SELECT repo, count(*) FILTER (risk < 4) AS low, count(*) FILTER (risk >= 4 AND risk < 10) AS medium, count(*) FILTER (risk >= 10) AS high, round(avg(risk), 6) AS mean_risk, max(risk) AS worst FROM last WHERE risk IS NOT NULL GROUP BY 1",
        "v10_diff": f"""WITH a AS {_Q(" AND perspective = 'declared'")}, b AS {_Q('')}
            SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.symbol, b.symbol) AS symbol, CASE WHEN a.symbol IS NULL THEN 'added' WHEN b.symbol IS NULL THEN 'removed' ELSE 'moved' END AS change, a.file_path AS old_file, b.file_path AS new_file
            FROM a FULL JOIN b ON a.repo IS NOT DISTINCT FROM b.repo AND a.symbol = b.symbol WHERE a.symbol IS NULL OR b.symbol IS NULL OR a.file_path IS DISTINCT FROM b.file_path""",
        "v10_edge_diff": """WITH a AS (SELECT DISTINCT s.kind || ' ' || s.name AS source, t.kind || ' ' || t.name AS target, e.kind FROM g_edges e JOIN g_nodes s ON s.id = e.src AND s.perspective = 'declared' JOIN g_nodes t ON t.id = e.dst AND t.perspective = 'declared' WHERE e.confidence = 'EXTRACTED' AND s.name IS NOT NULL AND t.name IS NOT NULL),
            b AS (SELECT DISTINCT s.kind || ' ' || s.name AS source, t.kind || ' ' || t.name AS target, e.kind FROM g_edges e JOIN g_nodes s ON s.id = e.src JOIN g_nodes t ON t.id = e.dst WHERE s.name IS NOT NULL AND t.name IS NOT NULL)
            SELECT kind, change, count(*) AS edges FROM (SELECT kind, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) x UNION ALL SELECT kind, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y) z GROUP BY 1, 2""",
        "a16_fan_in": """WITH a AS (SELECT n.kind || ' ' || n.name AS symbol, count(*) AS was FROM g_edges e JOIN g_nodes n ON n.id = e.dst AND n.perspective = 'declared' WHERE e.confidence = 'EXTRACTED' AND n.name IS NOT NULL GROUP BY 1),
            b AS (SELECT n.kind || ' ' || n.name AS symbol, count(*) AS now FROM g_edges e JOIN g_nodes n ON n.id = e.dst WHERE n.name IS NOT NULL GROUP BY 1)
            SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(was, 0) AS was, coalesce(now, 0) AS now FROM a FULL JOIN b ON b.symbol = a.symbol WHERE coalesce(was, 0) <> coalesce(now, 0)""",
        "v12_drift": """WITH x AS (SELECT DISTINCT lower(regexp_extract(name, '([^."`]+)["`]?\\s*$', 1)) AS t, perspective FROM g_nodes WHERE kind = 'database_table' AND name IS NOT NULL)
            SELECT t AS "table", CASE WHEN count(*) = 2 THEN 'matched' WHEN min(perspective) = 'declared' THEN 'declared_only' ELSE 'live_only' END AS state FROM x GROUP BY 1""",
        "v13_links": f"""WITH p AS (SELECT repo, kind, CASE WHEN kind = 'endpoint' THEN {_SHAPE.format('name')} ELSE name END AS k, bool_or(perspective = 'declared') AS dec FROM g_nodes WHERE kind IN ('endpoint', 'schema', 'database_table', 'component') AND name IS NOT NULL AND repo IS NOT NULL GROUP BY 1, 2, 3)
            SELECT c.kind, c.repo AS consumer, p.repo AS producer, count(*) AS links FROM p c JOIN p ON p.kind = c.kind AND p.k = c.k AND p.dec AND NOT c.dec AND p.repo <> c.repo GROUP BY 1, 2, 3""",
        "v16_status": "SELECT repo, count(*) AS passes, max(indexed_at) AS indexed_at, arg_max_null(files, (indexed_at, pass_id)) AS files, arg_max_null(nodes, (indexed_at, pass_id)) AS nodes, arg_max_null(edges, (indexed_at, pass_id)) AS edges FROM index_summaries GROUP BY 1",
        "v17_markers": """WITH f AS (SELECT repo, file_path, any_value(text) AS text FROM source_files WHERE text IS NOT NULL GROUP BY file_id, repo, file_path), l AS (SELECT repo, file_path, unnest(string_split_regex(text, '\\r?\\n')) AS t, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS line FROM f)
            SELECT repo, file_path, CAST(line AS INT) AS line, trim(t) AS text FROM l WHERE contains(t, 'WHY:') OR contains(t, 'HACK:')""",
        "a09_file_summary": f"""WITH {_GROUPS}, e AS (SELECT a.community AS ca, b.community AS cb, CASE confidence WHEN 'EXTRACTED' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END AS w FROM g_edges x JOIN grp a ON a.id = x.src JOIN grp b ON b.id = x.dst),
            i AS (SELECT ca AS community, count(*) AS internal, max(w) AS w FROM e WHERE ca = cb GROUP BY 1), o AS (SELECT community, count(*) AS external FROM (SELECT ca AS community FROM e WHERE ca <> cb UNION ALL SELECT cb FROM e WHERE ca <> cb) y GROUP BY 1),
            ep AS (SELECT id FROM g_nodes WHERE kind = 'function' AND name IN ('main', 'Main') UNION SELECT e.src FROM g_edges e JOIN g_nodes n ON n.id = e.dst AND n.kind = 'endpoint' WHERE e.kind = 'implements'),
            p AS (SELECT community, count(*) AS entrypoints FROM ep JOIN grp ON grp.id = ep.id GROUP BY 1),
            dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM g_edges UNION ALL SELECT dst FROM g_edges) z GROUP BY 1),
            tn AS (SELECT community, n.name, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, grp.id) AS r FROM grp JOIN g_nodes n ON n.id = grp.id LEFT JOIN dg ON dg.id = grp.id),
            rep AS (SELECT community, string_agg(name, ', ' ORDER BY r) AS representatives FROM tn WHERE r <= 5 GROUP BY 1)
            SELECT g.community, count(*) AS size, coalesce(max(internal), 0) AS internal, coalesce(max(external), 0) AS external, coalesce(max(entrypoints), 0) AS entrypoints, CASE max(w) WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' WHEN 2 THEN 'AMBIGUOUS' END AS worst, max(representatives) AS representatives
            FROM grp g LEFT JOIN i ON i.community = g.community LEFT JOIN o ON o.community = g.community LEFT JOIN p ON p.community = g.community LEFT JOIN rep ON rep.community = g.community GROUP BY 1""",
        "a10_file_bundles": f"""WITH {_GROUPS} SELECT least(a.community, b.community) AS low, greatest(a.community, b.community) AS high, x.kind, count(*) FILTER (confidence = 'EXTRACTED') AS extracted, count(*) FILTER (confidence = 'INFERRED') AS inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous
            FROM g_edges x JOIN grp a ON a.id = x.src JOIN grp b ON b.id = x.dst WHERE a.community <> b.community GROUP BY 1, 2, 3""",
        "a12_area_names": f"""WITH {_GROUPS}, c AS (SELECT community, min(file_path) AS file_path, count(*) AS symbols FROM grp JOIN g_nodes n ON n.id = grp.id WHERE file_path IS NOT NULL AND NOT regexp_matches(lower(file_path), '\\.min\\.|(^|/)(vendor|vendored|third_party|thirdparty)(/|$)') GROUP BY 1),
            d AS (SELECT *, {_DIR} AS dir FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY symbols DESC, community) AS k FROM d), o AS (SELECT *, CASE WHEN k = 1 THEN dir ELSE file_path END AS own FROM r),
            q AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY least(k, 2), community) AS q FROM o) SELECT community, CASE WHEN q = 1 THEN own ELSE own || ' #' || community END AS area, symbols FROM q""",
        "a14_coupling": f"""WITH {_GROUPS}, ar AS (SELECT grp.id, community, {_DIR} AS area FROM grp JOIN g_nodes n ON n.id = grp.id WHERE file_path IS NOT NULL AND NOT regexp_matches(lower(file_path), '\\.min\\.|(^|/)(vendor|vendored|third_party|thirdparty)(/|$)'))
            SELECT least(a.area, b.area) AS a, greatest(a.area, b.area) AS b, count(*) AS edges FROM g_edges e JOIN ar a ON a.id = e.src JOIN ar b ON b.id = e.dst WHERE a.area <> b.area GROUP BY 1, 2""",
        "f01_word_search": f"""WITH t AS (SELECT id, list_filter({_FOLD.format("coalesce(name, '')")}, lambda x: x <> '') AS n, list_filter({_FOLD.format("coalesce(description, '')")}, lambda x: x <> '') AS d FROM g_nodes),
            p AS (SELECT id, unnest(list_concat(n, d)) AS token FROM t), q AS (SELECT DISTINCT n[1] AS q FROM t WHERE len(n) > 0),
            voc AS (SELECT DISTINCT token FROM p), g AS (SELECT q, token FROM q JOIN voc ON starts_with(token, q)), h AS (SELECT q, id, count(*) AS tf FROM g JOIN p ON p.token = g.token GROUP BY 1, 2), df AS (SELECT q, count(*) AS df FROM h GROUP BY 1), l AS (SELECT id, count(*) AS len FROM p GROUP BY 1),
            k AS (SELECT (SELECT count(*) FROM g_nodes) AS n, (SELECT count(*) FROM p) AS toks),
            s AS (SELECT h.q, h.id, round((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / (toks / n))), 9) AS score FROM h JOIN df ON df.q = h.q JOIN l ON l.id = h.id CROSS JOIN k)
            SELECT * FROM (SELECT q AS query_id, id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INT) AS rank FROM s) z WHERE rank <= 5""",
        "f04_semantic": """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings)
            SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s) x WHERE rank <= 10""",
        "f05_embedding_text": "SELECT id, concat_ws(' ', 'passage:', kind, name, description) AS text FROM g_nodes",
        "a17_lessons": f"""WITH {_ENT}, e AS (SELECT DISTINCT id, repo, CASE WHEN lower(trim(outcome)) IN ('worked', 'ok', 'good') THEN 'worked' WHEN lower(trim(outcome)) IN ('wrong', 'bad', 'failed') THEN 'wrong' ELSE 'open' END AS outcome, unnest(nodes) AS symbol FROM ent),
            s AS (SELECT repo, symbol, count(*) AS entries, count(*) FILTER (outcome = 'worked') AS worked, count(*) FILTER (outcome = 'wrong') AS wrong FROM e WHERE symbol IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
            SELECT s.repo, s.symbol, entries, worked, wrong, CASE WHEN EXISTS (SELECT 1 FROM g_nodes n WHERE n.repo = s.repo AND n.name = s.symbol) THEN entries ELSE 0 END AS supported FROM s""",
    }.items()
}
