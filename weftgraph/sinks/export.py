"""Exports of a graph: JSON, columnar payload, GraphML, import script, manifest, report and benchmark records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import script_escape, xml_escape
from weftgraph.graph import PropertyGraph, stable_ids

def json_lines(g: PropertyGraph) -> DataFrame:
    """(value): one JSON object a node, then one an edge; text as it lies in a text sink."""
    n = g.nodes.select(F.to_json(F.struct(F.lit("node").alias("record"), "id", "kind", "name", F.col("file_path").alias("file"), "start_line", "end_line")).alias("value"))
    return n.unionByName(g.edges.select(F.to_json(F.struct(F.lit("edge").alias("record"), "src", "dst", "kind", "confidence")).alias("value")))


def write_json(g: PropertyGraph, path: str) -> None:
    json_lines(g).write.mode("overwrite").text(path)


def write_columnar(g: PropertyGraph, path: str) -> None:
    """Parquet, which is columnar and dictionary-coded, clustered by kind for pruning."""
    g.nodes.repartition("kind", F.pmod(F.col("id"), F.lit(64))).sortWithinPartitions("kind", "id").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes")
    g.edges.repartition("kind", F.pmod(F.col("src"), F.lit(64))).sortWithinPartitions("kind", "src").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")


def read_columnar(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph stored by ``write_columnar``: already clean, so labels and relationship types prune partitions and filters reach the scan."""
    return PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def graphml(g: PropertyGraph) -> DataFrame:
    """(part, value): the elements of a GraphML file between its head (part 0) and foot (part 3)."""
    spark = g.spark
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(
        f'<key id="{k}" for="{w}" attr.name="{k}" attr.type="string"/>\n' for k, w in (("kind", "node"), ("name", "node"), ("file", "node"), ("relation", "edge"), ("confidence", "edge"))
    ) + '<graph edgedefault="directed">'
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), xml_escape(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</data>"))
    n = g.nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="n'), F.col("id"), F.lit('">'), data("kind", F.col("kind")), data("name", F.col("name")), data("file", F.col("file_path")), F.lit("</node>")).alias("value"))
    e = g.edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="n'), F.col("src"), F.lit('" target="n'), F.col("dst"), F.lit('">'), data("relation", F.col("kind")), data("confidence", F.col("confidence")), F.lit("</edge>")).alias("value"))
    ends = spark.createDataFrame([(0, head), (3, "</graph>\n</graphml>")], "part int, value string")
    return ends.unionByName(n).unionByName(e)


def import_script(g: PropertyGraph) -> DataFrame:
    """(part, value): statements that create the nodes, then the edges."""
    q = lambda c: F.concat(F.lit("'"), script_escape(F.coalesce(c.cast("string"), F.lit(""))), F.lit("'"))
    label = F.replace(F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    n = g.nodes.select(F.lit(1).alias("part"), F.concat(F.lit("CREATE (:"), label, F.lit(" {id: "), F.col("id"), F.lit(", name: "), q(F.col("name")), F.lit(", file: "), q(F.col("file_path")), F.lit("});")).alias("value"))
    e = g.edges.select(F.lit(2).alias("part"), F.concat(F.lit("MATCH (a {id: "), F.col("src"), F.lit("}), (b {id: "), F.col("dst"), F.lit("}) CREATE (a)-[:"), F.upper("kind"), F.lit(" {confidence: "), q(F.col("confidence")), F.lit("}]->(b);")).alias("value"))
    return n.unionByName(e)


def write_parts(df: DataFrame, path: str) -> None:
    """A (part, value) frame as text files whose names sort in the order of the parts."""
    df.repartitionByRange("part").sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)


# manifest


def manifest(g: PropertyGraph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, uncertainties) with ids from what things are."""
    n = stable_ids(g.nodes)
    entities = n.select(F.col("external_id").alias("id"), "kind", "name", "file_path", "start_line", "end_line", "perspective", "evidence_kind", "evidence_source")
    ids = n.select(F.col("id").alias("n"), "external_id")
    e = g.edges.join(ids.select(F.col("n").alias("src"), F.col("external_id").alias("source")), "src").join(ids.select(F.col("n").alias("dst"), F.col("external_id").alias("target")), "dst")
    rel = e.select(F.concat(F.lit("relationship:"), F.lower(F.lpad(F.hex(F.xxhash64("source", "kind", "target")), 16, "0"))).alias("id"), "source", "target", "kind", "confidence")
    uncertain = rel.where("confidence = 'AMBIGUOUS'").select(F.col("id").alias("about"), F.lit("several candidates answer this reference").alias("reason"))
    return entities, rel, uncertain


def validate_manifest(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(rule, violations): unique ids, ends that exist, places inside the repository, known words, lines in order."""
    from weftgraph import schema

    spark = entities.sparkSession
    many = lambda df, name: df.groupBy("id").count().where("count > 1").agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit(name))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit(name))
    ids = entities.select("id")
    checks = [
        many(entities, "entity ids are unique"), many(relationships, "relationship ids are unique"),
        n(relationships.join(ids.withColumnRenamed("id", "source"), "source", "left_anti"), "sources exist"), n(relationships.join(ids.withColumnRenamed("id", "target"), "target", "left_anti"), "targets exist"),
        n(entities.where("file_path is null or file_path like '/%' or concat('/', file_path, '/') like '%/../%'"), "places lie inside the repository"), n(entities.where("start_line < 1 or end_line < start_line"), "lines are in order"),
        n(entities.where(~F.col("kind").isin(*schema.NODE_KINDS)), "entity kinds are known"), n(relationships.where(~F.col("confidence").isin(*schema.CONFIDENCES)), "confidences are known"),
    ]
    out = spark.createDataFrame([], "rule string, violations bigint")
    for c in checks:
        out = out.unionByName(c.select("rule", "violations"))
    return out


# report and pages


def report(g: PropertyGraph, top: int = 10) -> str:
    """A Markdown report from small aggregates."""
    from weftgraph.operators import graph_algos as A

    kinds = A.kind_classes(g).first().asDict()
    conf = {r["confidence"]: r["edges"] for r in g.edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("edges")).collect()}
    gods = A.god_nodes(g, top, by_name=False).collect()
    lines = ["# Graph report", "", *(f"- {k}: {v}" for k, v in kinds.items()), "", "## Confidence", "", *(f"- {k}: {conf.get(k, 0)}" for k in ("EXTRACTED", "INFERRED", "AMBIGUOUS")), "", "## Most connected", ""]
    return "\n".join([*lines, *(f"{i}. {r['name']} ({r['file_path']}): {r['degree']}" for i, r in enumerate(gods, 1))]) + "\n"


def wiki_pages(g: PropertyGraph) -> DataFrame:
    """(repo, file_path, page): one Markdown page a file: its symbols with lines, and how many edges leave and enter."""
    from weftgraph.operators.graph_algos import with_degrees

    d = with_degrees(g).where("kind not in ('file', 'doc') and file_path is not null")
    line = F.concat(F.lit("- "), F.coalesce("name", F.lit("?")), F.lit(" ("), F.col("kind"), F.lit(", line "), F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.lit("), used by "), F.col("in_degree"), F.lit(", uses "), F.col("out_degree"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", line.alias("line")))), lambda s: s["line"])
    return d.groupBy("repo", "file_path").agg(F.concat_ws("\n", F.concat(F.lit("# "), F.first("file_path")), F.lit(""), F.array_join(body, "\n")).alias("page"))


def openapi(surfaces: DataFrame, title: str = "observed") -> str:
    """An OpenAPI 3.1 document of observed surfaces(name, ...), operation ids made unique; one document, so it is built on the driver."""
    import re

    paths: dict[str, dict] = {}
    used: set[str] = set()
    for r in surfaces.select("name").where("name is not null").distinct().orderBy("name").toLocalIterator():
        verb, _, path = r["name"].partition(" ")
        path = re.sub(r":(\w+)|<(?:\w+:)?(\w+)>", lambda m: "{" + (m[1] or m[2]) + "}", path)
        base = re.sub(r"\W+", "_", f"{verb.lower()}{path}").strip("_")
        name, k = base, 2
        while name in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name)
        params = [{"name": p, "in": "path", "required": True, "schema": {"type": "string"}} for p in re.findall(r"\{(\w+)\}", path)]
        paths.setdefault(path, {})[verb.lower()] = {"operationId": name, "parameters": params, "responses": {"default": {"description": ""}}}
    return json.dumps({"openapi": "3.1.0", "info": {"title": title, "version": "0"}, "paths": paths}, indent=1, sort_keys=True)


# benchmark records


def append_records(spark: SparkSession, rows: list[dict], path: str) -> None:
    spark.createDataFrame([(json.dumps(r, sort_keys=True),) for r in rows], "value string").coalesce(1).write.mode("append").text(path)


def load_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
