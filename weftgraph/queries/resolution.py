"""Extraction and resolution: the source files to declarations, references and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import load, with_graph
from weftgraph.operators import resolve as R
from weftgraph.session import table, written
from weftgraph.sources import frontends


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where("text is not null").dropDuplicates(["file_id"]).select("repo", "file_path", "text")


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    declarations, refs = frontends.extract(_files(spark, d))
    return written(frontends.declared_nodes(declarations), "nodes"), written(refs, "refs")


def s05_declarations(spark: SparkSession, d: str) -> DataFrame:
    return frontends.extract(_files(spark, d))[0]


def s05_references(spark: SparkSession, d: str) -> DataFrame:
    return frontends.extract(_files(spark, d))[1]


def r01_doc_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of the graph's symbols in the documents of their repository; documents are numbered apart from nodes."""
    docs = table(spark, d, "documents").where("doc_id is not null").select((-F.col("doc_id")).alias("id"), "repo", "text")
    return R.doc_mentions(load(spark, d).nodes, docs).select("src", "dst", "kind", "confidence")


def r21_described_docs(spark: SparkSession, d: str) -> DataFrame:
    """The same without the bound on candidates, counted per document."""
    docs = table(spark, d, "documents").where("doc_id is not null").select((-F.col("doc_id")).alias("id"), "repo", "text")
    return R.doc_mentions(load(spark, d).nodes, docs, None).groupBy("src", "confidence").agg(F.count(F.lit(1)).alias("mentions"))


def r02_imports(spark: SparkSession, d: str) -> DataFrame:
    nodes, refs = _extracted(spark, d)
    imports = refs.where("kind = 'import'").select("repo", "file_path", F.from_json("target", R.IMPORT)["module"].alias("module"))
    files = R.file_nodes(nodes)
    return R.import_edges(refs, R.resolve_modules(files, imports), R.symbols(nodes), files)


def r05_calls(spark: SparkSession, d: str) -> DataFrame:
    nodes, refs = _extracted(spark, d)
    files = R.file_nodes(nodes)
    imports = refs.where("kind = 'import'").select("repo", "file_path", F.from_json("target", R.IMPORT)["module"].alias("module"))
    bound = R.bindings(refs, R.resolve_modules(files, imports))
    return R.call_edges(refs, R.symbols(nodes), files, bound, nodes).select("src", "dst", "kind", "confidence")


def r18_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The whole build: extraction, then all nine rules."""
    nodes, refs = _extracted(spark, d)
    return R.resolve(nodes, refs)[1]


def r17_affected(spark: SparkSession, d: str) -> DataFrame:
    """Which files an edit of each repository's last fetched file makes stale."""
    nodes, refs = _extracted(spark, d)
    edges = written(R.resolve(nodes, refs)[1], "edges")
    last = table(spark, d, "source_files").where("text is not null").groupBy("repo").agg(F.max_by("file_path", F.struct("fetched_at", "file_id")).alias("file_path"))
    return R.affected_files(nodes, edges, refs, last, nodes)


QUERIES = {f.__name__: f for f in (s05_declarations, s05_references, r01_doc_mentions, r21_described_docs, r02_imports, r05_calls, r18_rebuild, r17_affected)}

_MENTION = """WITH t AS (SELECT DISTINCT -doc_id AS src, repo, unnest(list_filter(string_split_regex(text, '[^\\p{L}\\p{N}_]+'), lambda x: strlen(x) > 2)) AS name FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
    n AS (SELECT repo, name, id, count(*) OVER (PARTITION BY repo, name) AS k FROM g_nodes WHERE kind NOT IN ('file', 'doc') AND name IS NOT NULL)"""
ORACLE = {
    "r01_doc_mentions": with_graph(f"{_MENTION} SELECT t.src, n.id AS dst, 'explains' AS kind, CASE WHEN k = 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence FROM t JOIN n ON n.repo = t.repo AND n.name = t.name WHERE k <= 2"),
    "r21_described_docs": with_graph(f"{_MENTION} SELECT t.src, CASE WHEN k = 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence, count(*) AS mentions FROM t JOIN n ON n.repo = t.repo AND n.name = t.name GROUP BY 1, 2"),
}
