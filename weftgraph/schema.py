"""The data model: closed vocabularies with their decode rules, table schemas and default provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed vocabularies of the graph.
NODE_KINDS = ("file", "function", "struct", "method", "interface", "doc", "endpoint", "schema", "database_table", "infra_resource", "database_column", "component")
EDGE_KINDS = ("imports", "calls", "inherits", "implements", "explains", "references")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
PERSPECTIVES = ("declared", "observed")
EVIDENCE_KINDS = ("ast_definition", "ast_import", "ast_call", "ast_inheritance", "text_reference", "openapi_contract", "sql_schema", "infrastructure_definition", "inferred_relationship")
REFERENCE_KINDS = ("import", "call", "inherit", "member", "local", "route", "tool", "consumer", "event_emit", "event_listen", "tool_call", "alias", "doc", "operation")
WORKED, WRONG = ("worked", "ok", "good"), ("wrong", "bad", "failed")

NODES = T.StructType(
    [
        T.StructField("id", T.LongType(), False), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("description", T.StringType()),
        T.StructField("perspective", T.StringType()), T.StructField("evidence_kind", T.StringType()), T.StructField("evidence_source", T.StringType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False), T.StructField("kind", T.StringType()), T.StructField("confidence", T.StringType()),
        T.StructField("perspective", T.StringType()), T.StructField("evidence_kind", T.StringType()), T.StructField("evidence_source", T.StringType()),
    ]
)
RAW_REFERENCES = T.StructType([T.StructField(c, T.StringType()) for c in ("file_path", "kind", "owner", "target")])


def decode(col: Column, known: tuple[str, ...], fallback: str, upper: bool = False) -> Column:
    """A stored word of a closed vocabulary, trimmed and in its case; unknown and null words become the fallback."""
    word = F.upper(F.trim(col)) if upper else F.lower(F.trim(col))
    return F.when(word.isin(*known), word).otherwise(F.lit(fallback))


def node_kind(col: Column) -> Column:
    return decode(col, NODE_KINDS, "interface")


def edge_kind(col: Column) -> Column:
    return decode(col, EDGE_KINDS, "calls")


def confidence(col: Column) -> Column:
    return decode(col, CONFIDENCES, "AMBIGUOUS", upper=True)


def outcome(col: Column) -> Column:
    word = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(word.isin(*WORKED), "worked").when(word.isin(*WRONG), "wrong").otherwise("open")


def node_provenance(kind: Column, file_path: Column) -> tuple[Column, Column, Column]:
    """(perspective, evidence_kind, evidence_source) of a node that carries none."""
    declared = kind.isin("doc", "endpoint", "schema")
    return F.when(declared, "declared").otherwise("observed"), F.when(declared, "text_reference").otherwise("ast_definition"), file_path


def edge_provenance(kind: Column, conf: Column) -> tuple[Column, Column]:
    """(perspective, evidence_kind) of an edge that carries none; the rules hold in this order."""
    perspective = F.when(kind.isin("explains", "references"), "declared").otherwise("observed")
    evidence = (
        F.when(kind == "explains", "text_reference").when(kind == "references", "openapi_contract").when(conf == "AMBIGUOUS", "inferred_relationship")
        .when(kind == "imports", "ast_import").when(kind == "calls", "ast_call").otherwise("ast_inheritance")
    )
    return perspective, evidence
