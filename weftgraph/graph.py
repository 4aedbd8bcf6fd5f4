"""The property graph: node and edge frames, cleaned, with the operations that change them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.session import table


@dataclass(frozen=True)
class PropertyGraph:
    """nodes(id, repo, kind, name, file_path, start_line, end_line, description, ...), edges(src, dst, kind, confidence, ...)."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


#: The cleaning of the stored tables, as SQL that Spark and DuckDB both run; every checked query builds on it.
CLEAN_SQL = """
g_nodes AS (
  SELECT id, repo, CASE WHEN lower(trim(kind)) IN ({nodes}) THEN lower(trim(kind)) ELSE 'interface' END AS kind, name, file_path, start_line, end_line, description,
    CASE WHEN lower(trim(perspective)) = 'declared' THEN 'declared' ELSE 'observed' END AS perspective, evidence_kind, evidence_source
  FROM nodes WHERE id IS NOT NULL),
g_edges AS (
  SELECT src, dst, kind, CASE min(CASE upper(trim(confidence)) WHEN 'EXTRACTED' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END) WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence
  FROM (SELECT src, dst, CASE WHEN lower(trim(kind)) IN ({edges}) THEN lower(trim(kind)) ELSE 'calls' END AS kind, confidence FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL) e
  GROUP BY src, dst, kind)
""".format(nodes=", ".join(f"'{k}'" for k in schema.NODE_KINDS), edges=", ".join(f"'{k}'" for k in schema.EDGE_KINDS)).strip()


def with_graph(query: str) -> str:
    """A DuckDB text over g_nodes and g_edges; further CTEs of the query follow theirs."""
    q = query.strip()
    if q.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {CLEAN_SQL}, {q[15:]}"
    return f"WITH {CLEAN_SQL}, {q[5:]}" if q.upper().startswith("WITH ") else f"WITH {CLEAN_SQL} {q}"


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """Known kinds and perspectives; rows without an id are left out."""
    n = nodes.where("id is not null")
    if "repo" not in n.columns:
        n = n.withColumn("repo", F.lit(None).cast("string"))
    return n.select(
        "id", "repo", schema.node_kind(F.col("kind")).alias("kind"), "name", "file_path", "start_line", "end_line", "description",
        F.when(F.lower(F.trim("perspective")) == "declared", "declared").otherwise("observed").alias("perspective"), "evidence_kind", "evidence_source",
    )


def clean_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, kind) with the strongest confidence of its repeats; rows without an end are left out.

    The aggregate combines map-side; its key holds both ends, so a hub spreads over all tasks.
    """
    rank = F.create_map(*(x for k, c in enumerate(schema.CONFIDENCES) for x in (F.lit(k), F.lit(c))))
    e = edges.where("src is not null and dst is not null").select("src", "dst", schema.edge_kind(F.col("kind")).alias("kind"), schema.confidence(F.col("confidence")).alias("c"))
    level = F.when(F.col("c") == "EXTRACTED", 0).when(F.col("c") == "INFERRED", 1).otherwise(2)
    return e.groupBy("src", "dst", "kind").agg(F.min(level).alias("level")).select("src", "dst", "kind", rank[F.col("level")].alias("confidence"))


def load(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph(clean_nodes(table(spark, sf_dir, "nodes")), clean_edges(table(spark, sf_dir, "edges")))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Last writer wins on (src, dst, kind): both frames carry rule_seq, the greatest stays."""
    w = Window.partitionBy("src", "dst", "kind").orderBy(F.col("rule_seq").desc(), F.col("confidence"))
    return edges.unionByName(new).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def insert_references(refs: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore on all four columns, within a repository where the references have one."""
    own = ["repo"] if "repo" in refs.columns else []
    return refs.unionByName(new).dropDuplicates([*own, "file_path", "kind", "owner", "target"])


def remove_files(graph: PropertyGraph, paths: DataFrame) -> PropertyGraph:
    """The graph without the nodes of the files in ``paths(repo, file_path)`` and without every edge that touched one.

    Paths without a repo column mean the path in every repository; a null repo means the nodes without one.
    """
    keys = [c for c in ("repo", "file_path") if c in paths.columns]
    out = paths.select(*(F.col(c).alias(f"_{c}") for c in keys)).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    gone = graph.nodes.join(out, same, "left_semi").select("id")
    nodes = graph.nodes.join(out, same, "left_anti")
    edges = graph.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return PropertyGraph(nodes.select(*graph.nodes.columns), edges.select(*graph.edges.columns))


def find_by_name(graph: PropertyGraph, name: str, file_path: str | None = None) -> DataFrame:
    """The node of the least id with this name, in this file if one is given; no row if there is none."""
    got = graph.nodes.where(F.col("name") == name)
    if file_path is not None:
        got = got.where(F.col("file_path") == file_path)
    return got.orderBy("id").limit(1)


def lookup_table(graph: PropertyGraph) -> DataFrame:
    """(name, id, files): the point lookup of every name at once: its least id, and how many files hold it."""
    return graph.nodes.groupBy("name").agg(F.min("id").alias("id"), F.count_distinct("file_path").alias("files"))


def names_in_file(graph: PropertyGraph, file_path: str) -> DataFrame:
    return graph.nodes.where((F.col("file_path") == file_path) & (F.col("kind") != "file")).select("name").distinct()


def stable_ids(nodes: DataFrame) -> DataFrame:
    """external_id 'entity:<16 hex>' from what a node is, its repository among it, not from where it was stored."""
    return nodes.withColumn("external_id", F.concat(F.lit("entity:"), F.lower(F.lpad(F.hex(F.xxhash64("repo", "kind", "file_path", "name", "start_line", "end_line")), 16, "0"))))
