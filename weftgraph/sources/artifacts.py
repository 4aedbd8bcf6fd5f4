"""Artifact sources: repository walk, DDL, Terraform, documents, contracts, manifests and live catalogs."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import collapse, extension, file_name, strip_cues, strip_json_comments

# Directories and files that a walk skips (its own state first), and the extensions by how they are read.
SKIP_DIRS = (".git", ".weftgraph", "target", "node_modules", ".playwright-mcp", ".claude", ".cursor", ".agents", ".venv", "venv", "__pycache__", ".tox")
SKIP_FILES = (".weftgraph.lock",)
TEXT_DOCS = ("md", "txt", "rst", "adoc", "srt", "vtt")
CODE = ("py", "pyw", "js", "mjs", "cjs", "jsx", "ts", "tsx", "rs", "go", "java", "vue", "svelte", "astro", "rb", "php", "cs", "kt", "swift", "c", "h", "cpp", "hpp", "scala")
OTHER = ("sql", "tf", "hcl", "yaml", "yml", "json", "pdf", "docx", "xlsx", "pptx", "odt", "ods", "csv", "svg", "png", "jpg", "jpeg", "mp4")
MANIFESTS = ("tsconfig.json", "jsconfig.json", "package.json", "go.mod", "Cargo.toml", "pyproject.toml")
MOST_TEXT = 40_000


def ignore_rules(text: str) -> list[tuple[re.Pattern, bool]]:
    """The patterns of an ignore file, last match wins: (pattern over the relative path, whether it excludes)."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        p = line.lstrip("!").rstrip("/")
        anchored = "/" in p
        body = re.escape(p.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out.append((re.compile(("^" if anchored else "(?:^|.*/)") + body + "(?:/.*)?$"), not keep))
    return out


def relevant(path: Column) -> Column:
    """Whether a path can change the graph: a known extension or manifest, outside the skipped directories and files."""
    inside = F.exists(F.split(path, "/"), lambda p: p.isin(*SKIP_DIRS))
    return (extension(path).isin(*CODE, *TEXT_DOCS, *OTHER) | file_name(path).isin(*MANIFESTS)) & ~inside & ~file_name(path).isin(*SKIP_FILES)


def walk(spark: SparkSession, root: str, ignore: str = "") -> DataFrame:
    """(file_path, length, modified, content) of the relevant files below a folder; ``ignore`` is the text of an ignore file."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/").split(":")[-1].lstrip("/")) + "/", "")
    got = got.select(path.alias("file_path"), "length", F.col("modificationTime").alias("modified"), "content").where(relevant(F.col("file_path")))
    rules = ignore_rules(ignore)
    if rules:
        ignored = F.lit(False)
        for p, excludes in rules:
            ignored = F.when(F.col("file_path").rlike(p.pattern), F.lit(excludes)).otherwise(ignored)
        got = got.where(~ignored)
    return got


# DDL and infrastructure


def ddl_statements(files: DataFrame) -> DataFrame:
    """(repo, file_path, line, statement) of files(repo, file_path, text): pieces between semicolons, comments blanked."""
    clean = F.regexp_replace(F.col("text"), r"--[^\n]*|/\*[\s\S]*?\*/", " ")
    s = files.where("text is not null").select("repo", "file_path", F.posexplode(F.split(clean, ";")).alias("k", "statement"))
    return s.where("trim(statement) <> ''")


def ddl_tables(files: DataFrame) -> DataFrame:
    """(repo, file_path, name, columns, references) of CREATE TABLE statements, also IF NOT EXISTS; names without quotes."""
    name = F.regexp_extract("statement", r"(?is)^\s*create\s+(?:temporary\s+|temp\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)", 1)
    bare = F.regexp_replace(name, r"[\"`\[\]]", "")
    refs = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("statement", F.lit(r"(?i)references\s+([\w.\"`\[\]]+)"), F.lit(1)), lambda r: F.regexp_replace(r, r"[\"`\[\]]", ""))))
    body = F.regexp_extract("statement", r"(?s)\((.*)\)", 1)
    columns = F.size(F.filter(F.split(F.regexp_replace(body, r"\([^()]*\)", ""), ","), lambda c: ~F.lower(F.trim(c)).rlike(r"^(primary|foreign|unique|check|constraint|key|index|exclude)\b") & (F.trim(c) != "")))
    t = ddl_statements(files).select("repo", "file_path", "k", bare.alias("name"), columns.alias("columns"), refs.alias("refs"))
    return t.where("name <> ''")


def ddl_references(files: DataFrame, across: bool = False) -> DataFrame:
    """(repo, file_path, source, target): foreign keys to a table declared in the same file, or, ``across``, in the repository."""
    t = ddl_tables(files)
    asked = t.select("repo", "file_path", F.col("name").alias("source"), F.explode("refs").alias("wanted"))
    known = t.select("repo", *([] if across else ["file_path"]), F.col("name").alias("target"), F.lower("name").alias("low")).distinct()
    keys = ["repo", "low"] if across else ["repo", "file_path", "low"]
    return asked.withColumn("low", F.lower("wanted")).join(known, keys).select("repo", "file_path", "source", "target").distinct()


def terraform(files: DataFrame) -> DataFrame:
    """(repo, file_path, line, block, type, name) of resource, data and module blocks."""
    lines = files.where("text is not null").select("repo", "file_path", F.posexplode(F.split("text", r"\r?\n")).alias("k", "line"))
    rule = r'^\s*(resource|data|module)\s+"([^"]+)"(?:\s+"([^"]+)")?\s*\{?'
    hit = lines.where(F.col("line").rlike(rule))
    return hit.select("repo", "file_path", (F.col("k") + 1).alias("line"), F.regexp_extract("line", rule, 1).alias("block"), F.regexp_extract("line", rule, 2).alias("type"), F.regexp_extract("line", rule, 3).alias("name"))


# documents


def ooxml_text(data: bytes) -> str:
    """Paragraphs of a zipped office document, and rows of its sheets."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        for n in names:
            if re.fullmatch(r"(word/document\.xml|ppt/slides/slide\d+\.xml|content\.xml)", n):
                for p in ElementTree.fromstring(z.read(n)).iter():
                    if p.tag.endswith("}p") or p.tag.endswith("}h"):
                        text = "".join(p.itertext()).strip()
                        if text:
                            out.append(text)
            elif re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n):
                out.append(n.rpartition("/")[2].rpartition(".")[0])
                for row in ElementTree.fromstring(z.read(n)).iter():
                    if row.tag.endswith("}row"):
                        cells = []
                        for c in row:
                            v = next((x.text or "" for x in c.iter() if x.tag.endswith("}v") or x.tag.endswith("}t")), "")
                            cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
                        out.append(" | ".join(cells))
    return "\n".join(out)


def binary_text(path: str, data: bytes | None) -> str | None:
    """The text of a document; None while no reader is there for it (PDF, pictures without text) or it is broken."""
    ext = path.rpartition(".")[2].lower()
    if data is None:
        return None
    try:
        if ext in ("docx", "pptx", "xlsx", "xlsm", "odt", "ods", "odp"):
            return ooxml_text(data)
        if ext == "svg":
            return " ".join(t.strip() for t in ElementTree.fromstring(data).itertext() if t.strip())
        if ext == "png" and data[:8] == b"\x89PNG\r\n\x1a\n":
            return f"image {int.from_bytes(data[16:20], 'big')}x{int.from_bytes(data[20:24], 'big')}"
        if ext in (*TEXT_DOCS, "csv"):
            return data.decode("utf-8", "replace")
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return None
    return None


def documents(walked: DataFrame) -> DataFrame:
    """(file_path, description) of walked document files; text documents are whole, cues apart; white space of others is reduced, to at most MOST_TEXT characters; null while pending."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file_path": pdf["file_path"], "text": [binary_text(p, d) for p, d in zip(pdf["file_path"], pdf["content"])]})

    docs = walked.where(extension(F.col("file_path")).isin(*TEXT_DOCS, "pdf", "docx", "pptx", "xlsx", "xlsm", "odt", "ods", "csv", "svg", "png", "jpg"))
    got = docs.select("file_path", "content").mapInPandas(run, "file_path string, text string")
    text = F.when(extension(F.col("file_path")).isin("srt", "vtt"), strip_cues(F.col("text"))).when(extension(F.col("file_path")).isin(*TEXT_DOCS), F.col("text")).otherwise(collapse(F.col("text"), MOST_TEXT))
    return got.select("file_path", text.alias("description"))


# contracts


def schema_refs(node: object) -> list[str]:
    """Distinct names at the end of all $ref below a JSON value, in order."""
    out: list[str] = []
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                out.append(x["$ref"].rpartition("/")[2])
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)
    return list(dict.fromkeys(out))


# What the functions behind an operation are called by its verb; a read of one thing has other words than a list.
READS_ONE = ("get", "find", "fetch", "show")
VERBS = {"get": ("list", "get", "fetch"), "post": ("create", "add", "post"), "put": ("update", "edit", "patch"), "patch": ("update", "edit", "patch"), "delete": ("delete", "remove")}


def handler_names(verb: str, path: str, operation_id: str | None) -> list[str]:
    """Names that an operation's implementation may have, best first: its id alone, else a word for its verb with the path's last fixed part, as it is and without a plural s."""
    if operation_id:
        return [operation_id]
    fixed = [p for p in path.split("/") if p and not p.startswith("{")]
    if not fixed:
        return []
    words = READS_ONE if verb == "get" and "{" in path else VERBS.get(verb, (verb,))
    many = fixed[-1][:1].upper() + fixed[-1][1:]
    return list(dict.fromkeys(w + thing for w in words for thing in (many, many.removesuffix("s"))))


def read_contract(text: str) -> dict | None:
    """An OpenAPI or Swagger document in JSON; None for anything else (YAML is read where a reader is installed)."""
    try:
        doc = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            return None
        try:
            doc = yaml.safe_load(text)
        except yaml.YAMLError:
            return None
    return doc if isinstance(doc, dict) and ("openapi" in doc or "swagger" in doc) else None


def contracts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, references) of contract files(repo, file_path, text): schema and endpoint nodes, $ref targets and operations' candidate names."""
    n_schema, r_schema = "repo string, file_path string, kind string, name string, description string", "repo string, file_path string, kind string, owner string, target string"

    def run(what: str):
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                nodes, refs = [], []
                for repo, path, text in zip(pdf["repo"], pdf["file_path"], pdf["text"]):
                    doc = read_contract(text)
                    if doc is None:
                        continue
                    schemas = (doc.get("components") or {}).get("schemas") or doc.get("definitions") or {}
                    for name, s in schemas.items():
                        nodes.append((repo, path, "schema", name, json.dumps(s, sort_keys=True)))
                        refs += [(repo, path, "schema_ref", name, r) for r in schema_refs(s)]
                    for p, item in (doc.get("paths") or {}).items():
                        for verb, op in (item or {}).items():
                            if verb.lower() not in ("get", "post", "put", "patch", "delete", "head", "options") or not isinstance(op, dict):
                                continue
                            name = f"{verb.upper()} {p}"
                            nodes.append((repo, path, "endpoint", name, json.dumps(op, sort_keys=True)))
                            refs.append((repo, path, "operation", name, json.dumps(handler_names(verb.lower(), p, op.get("operationId")))))
                            refs += [(repo, path, "schema_ref", name, r) for r in schema_refs(op)]
                yield pd.DataFrame(nodes, columns=["repo", "file_path", "kind", "name", "description"]) if what == "n" else pd.DataFrame(refs, columns=["repo", "file_path", "kind", "owner", "target"])

        return go

    src = files.where("text is not null").where(extension(F.col("file_path")).isin("json", "yaml", "yml")).select("repo", "file_path", "text")
    return src.mapInPandas(run("n"), n_schema), src.mapInPandas(run("r"), r_schema)


# manifests


def manifest_facts(path: str, text: str) -> list[tuple[str, str, list[str]]]:
    """(what, name, targets): aliases with their targets, and the published package name, of one build manifest."""
    name, here = path.rpartition("/")[2], path.rpartition("/")[0]
    at = lambda p: re.sub(r"^\./|/$", "", (here + "/" if here else "") + re.sub(r"^\./", "", p))
    out: list[tuple[str, str, list[str]]] = []
    if name in ("tsconfig.json", "jsconfig.json", "package.json"):
        bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text)
        bare = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)
        try:
            doc = json.loads(bare)
        except ValueError:
            return []
        if name == "package.json":
            if isinstance(doc.get("name"), str):
                out.append(("package", doc["name"], []))
                out.append(("alias", doc["name"], [at(doc["main"] if isinstance(doc.get("main"), str) else "index")]))
                out.append(("alias", doc["name"] + "/*", [at("*"), at("src/*")]))
            for k, v in (doc.get("imports") or {}).items():
                if isinstance(v, str):
                    out.append(("alias", k, [at(v)]))
        else:
            opts = doc.get("compilerOptions") or {}
            base = opts.get("baseUrl", ".")
            for k, v in (opts.get("paths") or {}).items():
                out.append(("alias", k, [at(f"{base}/{t}" if base != "." else t) for t in v]))
            if "baseUrl" in opts:
                out.append(("alias", "*", [at(f"{base}/*" if base != "." else "*")]))
    elif name == "go.mod":
        m = re.search(r"^module\s+(\S+)", text, re.M)
        if m:
            out += [("package", m[1], []), ("alias", m[1] + "/*", [at("*")])]
    elif name in ("Cargo.toml", "pyproject.toml"):
        m = re.search(r"^\[(?:package|project)\][^\[]*?^name\s*=\s*\"([^\"]+)\"", text, re.M | re.S)
        if m:
            out.append(("package", m[1], []))
    return out


def manifests(files: DataFrame) -> DataFrame:
    """(repo, file_path, what, pattern, targets) of manifest files: aliases and published packages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(repo, path, *f) for repo, path, text in zip(pdf["repo"], pdf["file_path"], pdf["text"]) for f in manifest_facts(path, text)]
            yield pd.DataFrame(rows, columns=["repo", "file_path", "what", "pattern", "targets"])

    src = files.where("text is not null").where(file_name(F.col("file_path")).isin(*MANIFESTS)).select("repo", "file_path", "text")
    return src.mapInPandas(run, "repo string, file_path string, what string, pattern string, targets array<string>")


# live catalogs


def catalog(tables: DataFrame, columns: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) by name of a live catalog.

    tables(schema, table); columns(schema, table, column, type, ordinal, nullable, primary_key); keys(schema, table, column, ref_schema,
    ref_table, ref_column). Names in the default schema are bare. Edges: table to column, table to table and column to
    column of foreign keys, all references.
    """
    q = lambda s, t: F.when(F.col(s).isin("public", "main"), F.col(t)).otherwise(F.concat_ws(".", s, t))
    c = columns.withColumn("table_name", q("schema", "table"))
    shape = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column", "type", "nullable", "primary_key"))), lambda s: F.struct(s["column"].alias("column"), s["type"].alias("type"), s["nullable"].alias("nullable"), s["primary_key"].alias("primary_key"))))
    described = c.groupBy(F.col("table_name").alias("name")).agg(shape.alias("description"))
    t = tables.select(q("schema", "table").alias("name")).distinct().join(described, "name", "left").select(F.lit("database_table").alias("kind"), "name", "description")
    col_name = F.concat_ws(".", "table_name", "column")
    nodes = t.unionByName(c.select(F.lit("database_column").alias("kind"), col_name.alias("name"), F.to_json(F.struct("type", "nullable", "primary_key")).alias("description")))
    k = keys.withColumn("a", q("schema", "table")).withColumn("b", q("ref_schema", "ref_table"))
    edges = c.select(F.col("table_name").alias("source"), col_name.alias("target"), F.lit("column").alias("relation"))
    edges = edges.unionByName(k.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("foreign_key").alias("relation")).distinct())
    edges = edges.unionByName(k.select(F.concat_ws(".", "a", "column").alias("source"), F.concat_ws(".", "b", "ref_column").alias("target"), F.lit("column_key").alias("relation")))
    return nodes, edges


def jdbc_catalog(spark: SparkSession, url: str, **options: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, columns, keys) of a PostgreSQL database through JDBC, for ``catalog``; TLS unless the URL says sslmode=disable."""
    if "sslmode" not in url:
        url += ("&" if "?" in url else "?") + "sslmode=require"
    read = lambda sql: spark.read.format("jdbc").options(url=url, query=sql, **options).load()
    inner = "table_schema not in ('pg_catalog', 'information_schema')"
    tables = read(f"select table_schema as schema, table_name as table from information_schema.tables where {inner}")
    columns = read(
        f"""select c.table_schema as schema, c.table_name as table, c.column_name as column, c.data_type as type, c.ordinal_position as ordinal, c.is_nullable = 'YES' as nullable,
        exists (select 1 from information_schema.key_column_usage k join information_schema.table_constraints t using (constraint_schema, constraint_name) where t.constraint_type = 'PRIMARY KEY' and k.table_schema = c.table_schema and k.table_name = c.table_name and k.column_name = c.column_name) as primary_key
        from information_schema.columns c where {inner}"""
    )
    keys = read(
        """select k.table_schema as schema, k.table_name as table, k.column_name as column, u.table_schema as ref_schema, u.table_name as ref_table, u.column_name as ref_column
        from information_schema.referential_constraints r join information_schema.key_column_usage k using (constraint_schema, constraint_name)
        join information_schema.key_column_usage u on u.constraint_schema = r.unique_constraint_schema and u.constraint_name = r.unique_constraint_name and u.ordinal_position = k.position_in_unique_constraint"""
    )
    return tables, columns, keys


def config_text(files: DataFrame) -> DataFrame:
    """JSON files with comments and trailing commas removed."""
    return files.withColumn("text", strip_json_comments(F.col("text")))
