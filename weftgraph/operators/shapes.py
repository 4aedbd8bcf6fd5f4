"""Response shapes: what a contract promises against what a handler returns; and the budget of embedded sources."""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_DEPTH = 4


def flatten_schema(schema: object, schemas: dict[str, dict]) -> dict[str, bool]:
    """Dotted paths of a schema's fields, MOST_DEPTH deep, with whether each is required all the way; lists are looked through, references followed once a branch."""
    out: dict[str, bool] = {}

    def walk(node: object, at: str, required: bool, depth: int, seen: frozenset) -> None:
        while isinstance(node, dict):
            if isinstance(node.get("$ref"), str):
                name = node["$ref"].rpartition("/")[2]
                if name in seen:
                    return
                node, seen = schemas.get(name), seen | {name}
            elif node.get("type") == "array" or "items" in node:
                node = node.get("items")
            else:
                break
        if not isinstance(node, dict):
            return
        for part in node.get("allOf") or []:
            walk(part, at, required, depth, seen)
        need = set(node.get("required") or [])
        for k, v in (node.get("properties") or {}).items():
            path = f"{at}.{k}" if at else k
            out[path] = required and k in need
            if depth < MOST_DEPTH:
                walk(v, path, out[path], depth + 1, seen)

    walk(schema, "", True, 1, frozenset())
    return out


def response_schema(operation: dict) -> object:
    """The schema of the first successful response of an operation, of either generation of the contract language."""
    for code, r in sorted((operation.get("responses") or {}).items()):
        if str(code).startswith("2") or code == "default":
            if not isinstance(r, dict):
                return None
            if "$ref" in r or "schema" in r:
                return r.get("schema", r)
            for media in (r.get("content") or {}).values():
                return media.get("schema")
    return None


def returned_fields(source: str, function: str) -> set[str] | None:
    """Dotted paths of the mappings that a Python function returns: literals, spreads of and subscripts on local mappings; None if it isn't there."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    fn = next((n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == function), None)
    if fn is None:
        return None
    known: dict[str, list[ast.AST]] = {}
    extra: dict[str, list[tuple[str, ast.AST]]] = {}
    for n in ast.walk(fn):
        if isinstance(n, ast.Assign) and len(n.targets) == 1:
            t = n.targets[0]
            if isinstance(t, ast.Name):
                known.setdefault(t.id, []).append(n.value)
            elif isinstance(t, ast.Subscript) and isinstance(t.value, ast.Name) and isinstance(t.slice, ast.Constant) and isinstance(t.slice.value, str):
                extra.setdefault(t.value.id, []).append((t.slice.value, n.value))
    out: set[str] = set()

    def collect(node: ast.AST, at: str, depth: int, seen: frozenset) -> None:
        join = lambda k: f"{at}.{k}" if at else k
        if isinstance(node, ast.Dict):
            for k, v in zip(node.keys, node.values):
                if k is None:
                    collect(v, at, depth, seen)
                elif isinstance(k, ast.Constant) and isinstance(k.value, str):
                    out.add(join(k.value))
                    if depth < MOST_DEPTH:
                        collect(v, join(k.value), depth + 1, seen)
        elif isinstance(node, ast.Name) and node.id not in seen:
            for v in known.get(node.id, ()):
                collect(v, at, depth, seen | {node.id})
            for k, v in extra.get(node.id, ()):
                out.add(join(k))
                if depth < MOST_DEPTH:
                    collect(v, join(k), depth + 1, seen | {node.id})
        elif isinstance(node, (ast.List, ast.Tuple)):
            for x in node.elts[:1]:
                collect(x, at, depth, seen)
        elif isinstance(node, (ast.ListComp, ast.GeneratorExp)):
            collect(node.elt, at, depth, seen)
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name) and node.func.id == "dict":
                for k in node.keywords:
                    if k.arg:
                        out.add(join(k.arg))
                        collect(k.value, join(k.arg), depth + 1, seen)
            elif node.args:
                collect(node.args[0], at, depth, seen)  # a wrapper such as jsonify(...)
        elif isinstance(node, ast.IfExp):
            collect(node.body, at, depth, seen)
            collect(node.orelse, at, depth, seen)

    for n in ast.walk(fn):
        if isinstance(n, ast.Return) and n.value is not None:
            collect(n.value, "", 1, frozenset())
    return out


def shape_check(pairs: DataFrame) -> DataFrame:
    """(repo, endpoint, handler, missing, extra, missing_required) of pairs(repo, endpoint, operation, schemas, handler, text).

    operation and schemas are JSON texts, text the handler's file. Contracts without a response shape and handlers that
    can't be read give no row; lists are sorted and joined by commas.
    """
    names = ["repo", "endpoint", "handler", "missing", "extra", "missing_required"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, end, op, schemas, handler, text in zip(pdf["repo"], pdf["endpoint"], pdf["operation"], pdf["schemas"], pdf["handler"], pdf["text"]):
                try:
                    want = flatten_schema(response_schema(json.loads(op)), json.loads(schemas) if schemas else {})
                except (ValueError, AttributeError, TypeError):
                    continue
                got = returned_fields(text, handler)
                if got is None or not want:
                    continue
                lost = sorted(set(want) - got)
                rows.append((repo, end, handler, ",".join(lost), ",".join(sorted(got - set(want))), ",".join(p for p in lost if want[p])))
            yield pd.DataFrame(rows, columns=names)

    src = pairs.where("operation is not null and text is not null").select("repo", "endpoint", "operation", "schemas", "handler", "text")
    return src.mapInPandas(run, ", ".join(f"{n} string" for n in names))


def source_budget(nodes: DataFrame, files: DataFrame, budget: int = 3 * 1024 * 1024) -> list[tuple[str, str]]:
    """The (repo, file_path) whose sources fit a byte budget, taken by number of symbols, then path; a file that doesn't fit is skipped.

    Greedy with skips is sequential; the ranked list is read as a stream and stops once the smallest file no longer fits.
    """
    n = nodes.where("kind not in ('file', 'doc')").groupBy("repo", "file_path").agg(F.count(F.lit(1)).alias("symbols"))
    size = files.where("text is not null").groupBy("repo", "file_path").agg(F.max(F.octet_length("text")).alias("bytes"))
    j = n.join(size, ["repo", "file_path"])
    least = j.agg(F.min("bytes")).first()[0]
    out, left = [], budget
    for r in j.orderBy(F.col("symbols").desc(), "file_path", "repo").toLocalIterator():
        if r["bytes"] <= left:
            out.append((r["repo"], r["file_path"]))
            left -= r["bytes"]
        if left < least:
            break
    return out


def nearest_below(markers: DataFrame, declarations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, target): for each marker line the first declaration at or below it; a forward as-of join by one window.

    markers(keys, line) and declarations(keys, start_line, target) are merged in the order of lines, so no pair is made.
    """
    m = markers.select(*keys, "line", F.lit(None).cast("string").alias("target"), F.lit(0).alias("side"))
    d = declarations.select(*keys, F.col("start_line").alias("line"), F.col("target").cast("string").alias("target"), F.lit(1).alias("side"))
    w = Window.partitionBy(*keys).orderBy(F.col("line").asc(), F.col("side").asc(), F.col("target").asc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return m.unionByName(d).withColumn("target", F.first("target", ignorenulls=True).over(w)).where("side = 0 and target is not null").select(*keys, "line", "target")


def innermost(spans: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, owner): the smallest range(keys, start_line, end_line, owner) that contains each span(keys, start, end)."""
    j = spans.join(ranges, keys).where("start_line <= start and end <= end_line")
    w = Window.partitionBy(*keys, "start", "end").orderBy(F.col("end_line") - F.col("start_line"), F.col("start_line").desc(), "owner")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "start", "end", "owner")
