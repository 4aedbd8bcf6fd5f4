"""Queries of the general data problems: drifting schemas (p1) and hot keys (p4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import hot_keys, schema_drift
from weftgraph.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "run_records"), table(spark, d, "run_files")).distinct()


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.typed_runs(table(spark, d, "run_records"), table(spark, d, "run_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.heavy_keys(table(spark, d, "edges"), table(spark, d, "insights"))


def p4_dst(spark: SparkSession, d: str) -> DataFrame:
    got = hot_keys.pair_counts(table(spark, d, "edges"), "dst", "src", "kind")
    return got.select("dst", F.col("n_rows").alias("n_edges"), F.col("n_partners").alias("n_src"))


def p4_hubs(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.hub_results(table(spark, d, "insights"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_runs, p4_found, p4_dst, p4_hubs)
}

ORACLE: dict[str, str] = {
    "p4_dst": "SELECT dst, count(*) AS n_edges, count(DISTINCT src) AS n_src FROM (SELECT DISTINCT src, dst, kind FROM edges) WHERE dst IS NOT NULL GROUP BY dst",
    "p4_hubs": """
        WITH last AS (SELECT repo, number, arg_max(risk, (coalesce(computed_at, TIMESTAMP '0001-01-01'), coalesce(risk, -1))) AS risk FROM insights GROUP BY repo, number),
        h AS (SELECT DISTINCT repo, number, hub FROM (SELECT repo, number, unnest(hubs) AS hub FROM insights) WHERE hub IS NOT NULL)
        SELECT hub, count(*) AS pull_requests, CAST(sum(risk) AS DOUBLE) / count(risk) AS mean_risk
        FROM h JOIN last ON h.repo IS NOT DISTINCT FROM last.repo AND h.number IS NOT DISTINCT FROM last.number GROUP BY hub""",
    "p4_found": """
        WITH e AS (SELECT dst, count(*) AS n FROM (SELECT DISTINCT src, dst, kind FROM edges) WHERE dst IS NOT NULL GROUP BY dst),
        h AS (SELECT hub, count(*) AS n FROM (SELECT DISTINCT repo, number, hub FROM (SELECT repo, number, unnest(hubs) AS hub FROM insights) WHERE hub IS NOT NULL) GROUP BY hub)
        SELECT 'dst' AS field, CAST(dst AS VARCHAR) AS key_value FROM e WHERE n * 100 >= 2 * (SELECT sum(n) FROM e)
        UNION ALL SELECT 'hubs', hub FROM h WHERE n * 100 >= 2 * (SELECT sum(n) FROM h)""",
}
