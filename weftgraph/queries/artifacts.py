"""Program analysis, artifact sources, streams and sinks over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import load, with_graph
from weftgraph.operators import flow, shapes
from weftgraph.session import shared_dir, table
from weftgraph.sinks import export
from weftgraph.sources import artifacts
from weftgraph.streaming import watch


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where("text is not null").dropDuplicates(["file_id"]).select("repo", "file_path", "text")


def p01_cfg_blocks(spark: SparkSession, d: str) -> DataFrame:
    return flow.control_flow(_files(spark, d), "blocks")


def p01_cfg_edges(spark: SparkSession, d: str) -> DataFrame:
    return flow.control_flow(_files(spark, d), "edges")


def p02_definitions(spark: SparkSession, d: str) -> DataFrame:
    return flow.control_flow(_files(spark, d), "defs")


def p07_dependences(spark: SparkSession, d: str) -> DataFrame:
    return flow.dependences(_files(spark, d))


def p09_taint(spark: SparkSession, d: str) -> DataFrame:
    return flow.taint(_files(spark, d))


def p11_program_taint(spark: SparkSession, d: str) -> DataFrame:
    return flow.program_taint(_files(spark, d))


def a18_nearest_below(spark: SparkSession, d: str) -> DataFrame:
    """For the document and schema nodes of a file, the first callable at or below their line."""
    n = load(spark, d).nodes.where("file_path is not null and start_line is not null")
    markers = n.where("kind not in ('function', 'method', 'file')").select("repo", "file_path", F.col("start_line").alias("line")).distinct()
    return shapes.nearest_below(markers, n.where("kind in ('function', 'method')").select("repo", "file_path", "start_line", F.lpad(F.col("id").cast("string"), 20, "0").alias("target")), ["repo", "file_path"])


def a19_innermost(spark: SparkSession, d: str) -> DataFrame:
    """The smallest type that holds each callable of its file."""
    n = load(spark, d).nodes
    spans = n.where("kind in ('function', 'method')").select("repo", "file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end")).distinct()
    ranges = n.where("kind in ('struct', 'interface', 'component')").select("repo", "file_path", "start_line", "end_line", F.col("id").alias("owner"))
    return shapes.innermost(spans, ranges, ["repo", "file_path"])


def s02_relevance(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d).nodes
    return n.select("file_path").distinct().select("file_path", artifacts.relevant(F.col("file_path")).alias("relevant"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id is not null").select("repo", F.col("doc_id").cast("string").alias("file_path"), "text")


def s08_ddl_tables(spark: SparkSession, d: str) -> DataFrame:
    """CREATE TABLE statements at the start of a piece of any document's text."""
    t = artifacts.ddl_tables(_documents(spark, d))
    return t.select("repo", "file_path", "k", "name", F.array_join("refs", ",").alias("refs"))


def s09_terraform(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.terraform(_documents(spark, d))


def w01_events_windows(spark: SparkSession, d: str) -> DataFrame:
    return watch.windowed_events(table(spark, d, "events"))


def w02_file_stream(spark: SparkSession, d: str) -> DataFrame:
    """The source files as a change feed in bursts, applied file by file to a stored table; then what is stored."""
    root = f"{shared_dir(spark)}/watch-{abs(hash((d, id(spark)))):x}-{F.rand()._jc.hashCode():x}"
    src = table(spark, d, "source_files").select("file_id", "repo", "file_path", "text")
    schema = src.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    src.repartition(4, "file_id").write.parquet(f"{root}/feed")
    events = watch.change_events(spark, f"{root}/feed", schema)
    store = watch.Revision(spark, f"{root}/store")

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["file_id"]).select("file_id", "repo", "file_path", F.length("text").alias("n_chars"))
        store.replace(rows.select("file_id"), rows, number, "file_id")

    q = events.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return store.read()


def x01_json(spark: SparkSession, d: str) -> DataFrame:
    return export.json_lines(load(spark, d))


def x03_graphml(spark: SparkSession, d: str) -> DataFrame:
    return export.graphml(load(spark, d))


def x04_import_script(spark: SparkSession, d: str) -> DataFrame:
    return export.import_script(load(spark, d))


def x06_wiki(spark: SparkSession, d: str) -> DataFrame:
    return export.wiki_pages(load(spark, d))


def x08_relationships(spark: SparkSession, d: str) -> DataFrame:
    return export.manifest(load(spark, d))[1]


def x09_validation(spark: SparkSession, d: str) -> DataFrame:
    return export.validate_manifest(*export.manifest(load(spark, d))[:2])


QUERIES = {
    # the names of program analysis begin with fl, as p with a number is a data problem's
    "fl01_cfg_blocks": p01_cfg_blocks, "fl01_cfg_edges": p01_cfg_edges, "fl02_definitions": p02_definitions, "fl07_dependences": p07_dependences, "fl09_taint": p09_taint, "fl11_program_taint": p11_program_taint,
} | {f.__name__: f for f in (a18_nearest_below, a19_innermost, s02_relevance, s08_ddl_tables, s09_terraform, w01_events_windows, w02_file_stream, x01_json, x03_graphml, x04_import_script, x06_wiki, x08_relationships, x09_validation)}

ORACLE = {
    "a18_nearest_below": with_graph("""WITH n AS (SELECT * FROM g_nodes WHERE file_path IS NOT NULL AND start_line IS NOT NULL), m AS (SELECT DISTINCT repo, file_path, start_line AS line FROM n WHERE kind NOT IN ('function', 'method', 'file'))
        SELECT m.repo, m.file_path, m.line, lpad(CAST(arg_min(n.id, (n.start_line, lpad(CAST(n.id AS VARCHAR), 20, '0'))) AS VARCHAR), 20, '0') AS target FROM m JOIN n ON n.repo = m.repo AND n.file_path = m.file_path AND n.kind IN ('function', 'method') AND n.start_line >= m.line GROUP BY 1, 2, 3"""),
    "a19_innermost": with_graph("""WITH s AS (SELECT DISTINCT repo, file_path, start_line AS a, end_line AS b FROM g_nodes WHERE kind IN ('function', 'method')), r AS (SELECT * FROM g_nodes WHERE kind IN ('struct', 'interface', 'component'))
        SELECT s.repo, s.file_path, s.a AS "start", s.b AS "end", arg_min(r.id, (r.end_line - r.start_line, -r.start_line, r.id)) AS owner FROM s JOIN r ON r.repo = s.repo AND r.file_path = s.file_path AND r.start_line <= s.a AND s.b <= r.end_line GROUP BY 1, 2, 3, 4"""),
    "s02_relevance": "SELECT DISTINCT file_path, (lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) IN ({0}) OR regexp_extract(file_path, '[^/]*$') IN ({1})) AND len(list_intersect(string_split(file_path, '/'), [{2}])) = 0 AND regexp_extract(file_path, '[^/]*$') NOT IN ({3}) AS relevant FROM nodes WHERE id IS NOT NULL".format(
        *(", ".join(f"'{x}'" for x in names) for names in ((*artifacts.CODE, *artifacts.TEXT_DOCS, *artifacts.OTHER), artifacts.MANIFESTS, artifacts.SKIP_DIRS, artifacts.SKIP_FILES))
    ),
    "x09_validation": with_graph("""WITH t AS (SELECT n.*, dense_rank() OVER (ORDER BY repo, kind, file_path, name, start_line, end_line) AS e FROM g_nodes n), r AS (SELECT a.e AS s, b.e AS t, g.kind, g.confidence FROM g_edges g JOIN t a ON a.id = g.src JOIN t b ON b.id = g.dst)
        SELECT 'entity ids are unique' AS rule, (SELECT count(*) FROM (SELECT e FROM t GROUP BY e HAVING count(*) > 1) x) AS violations UNION ALL SELECT 'relationship ids are unique', (SELECT count(*) FROM (SELECT s, t, kind FROM r GROUP BY ALL HAVING count(*) > 1) x)
        UNION ALL SELECT 'sources exist', 0 UNION ALL SELECT 'targets exist', 0
        UNION ALL SELECT 'places lie inside the repository', count(*) FROM t WHERE file_path IS NULL OR starts_with(file_path, '/') OR contains('/' || file_path || '/', '/../') UNION ALL SELECT 'lines are in order', count(*) FROM t WHERE start_line < 1 OR end_line < start_line
        UNION ALL SELECT 'entity kinds are known', 0 UNION ALL SELECT 'confidences are known', 0"""),
    "w01_events_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "w02_file_stream": "SELECT DISTINCT file_id, repo, file_path, CAST(length(text) AS INT) AS n_chars FROM source_files",
    "s08_ddl_tables": """WITH s AS (SELECT repo, CAST(doc_id AS VARCHAR) AS file_path, unnest(string_split(regexp_replace(text, '--[^\\n]*|/\\*[\\s\\S]*?\\*/', ' ', 'g'), ';')) AS st, generate_subscripts(string_split(regexp_replace(text, '--[^\\n]*|/\\*[\\s\\S]*?\\*/', ' ', 'g'), ';'), 1) - 1 AS k FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
        SELECT repo, file_path, CAST(k AS INT) AS k, regexp_extract(st, '(?is)^\\s*create\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?([\\w."]+)', 1) AS name, array_to_string(list_sort(list_distinct(regexp_extract_all(st, '(?i)references\\s+([\\w."]+)', 1))), ',') AS refs FROM s WHERE regexp_extract(st, '(?is)^\\s*create\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?([\\w."]+)', 1) <> ''""",
    "x01_json": with_graph("SELECT CAST(count(*) AS BIGINT) AS n FROM g_nodes"),
}
del ORACLE["x01_json"]
