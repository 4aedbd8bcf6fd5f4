"""Queries of the text problems (p2, p3, p5, p6, p7, p8); the SQL of those that SQL can express is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import mixing, pairs, provenance, reading, tokenize, unparsable
from weftgraph.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.foreign(table(spark, d, "source_files"), table(spark, d, "third_party_files")).select("file_id").distinct()


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    return provenance.foreign(table(spark, d, "source_files"), table(spark, d, "third_party_files"))


def p5_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return provenance.handwritten(table(spark, d, "source_files"), table(spark, d, "third_party_files"), table(spark, d, "index_summaries"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return unparsable.verdicts(table(spark, d, "source_files"), effort=None).where("cost > 0").select("file_id").distinct()


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return unparsable.verdicts(table(spark, d, "source_files"), effort=None).where("cost > 0")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return unparsable.rates(table(spark, d, "source_files"), table(spark, d, "nodes"), table(spark, d, "track_b_python"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "memory_entries"), table(spark, d, "documents")).distinct()


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    got = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return got.withColumn("parts", F.to_json("parts"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "level").distinct()


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_files, p2_rates, p3_found, p5_found, p5_kinds, p5_handwritten, p6_ids, p7_mix, p7_shares, p8_found, p8_levels)}

ORACLE: dict[str, str] = {}
