"""Source code to declarations and unresolved references, one file at a time, distributed by ``mapInPandas``.

Python is read through the standard library's syntax tree. JavaScript, TypeScript, Rust, Go and Java are read by patterns
for declarations, imports and calls; what these can't see (types of expressions, nested scopes) is simply not referenced.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECLARATIONS = "repo string, file_path string, kind string, name string, start_line int, end_line int, owner_type string"
REFERENCES = "repo string, file_path string, kind string, owner string, target string"
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
# Names of HTTP clients, of event publishers and of listeners.
CLIENTS = frozenset("requests httpx session client http axios fetch api".split())
EMITTERS, LISTENERS = frozenset("emit publish dispatch send_event".split()), frozenset("on subscribe listen add_listener once".split())


class Found:
    def __init__(self) -> None:
        self.declarations: list[tuple] = []
        self.references: list[tuple] = []

    def declare(self, kind: str, name: str, start: int, end: int, owner: str = "") -> None:
        self.declarations.append((kind, name, start, end, owner))

    def refer(self, kind: str, owner: str, target: object) -> None:
        self.references.append((kind, owner, target if isinstance(target, str) else json.dumps(target, sort_keys=True)))


def dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else ""
    return ""


class PythonReader(ast.NodeVisitor):
    def __init__(self, found: Found):
        self.found = found
        self.types: list[str] = []
        self.functions: list[str] = []

    @property
    def owner(self) -> str:
        return self.functions[-1] if self.functions else ""

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.found.declare("struct", node.name, node.lineno, node.end_lineno or node.lineno)
        for base in node.bases:
            name = dotted(base)
            if name:
                self.found.refer("inherit", node.name, {"base": name.rpartition(".")[2], "relation": "inherits"})
        self.types.append(node.name)
        self.generic_visit(node)
        self.types.pop()

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        owner_type = self.types[-1] if self.types and not self.functions else ""
        self.found.declare("method" if owner_type else "function", node.name, node.lineno, node.end_lineno or node.lineno, owner_type)
        if owner_type:
            self.found.refer("member", owner_type, node.name)
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                verb, path = d.func.attr.lower(), d.args[0].value
                if verb in VERBS and path.startswith("/"):
                    self.found.refer("route", node.name, f"{verb.upper()} {path}")
                elif verb == "route" and path.startswith("/"):
                    self.found.refer("route", node.name, f"GET {path}")
            if dotted(d.func if isinstance(d, ast.Call) else d).rpartition(".")[2] == "tool":
                self.found.refer("tool", node.name, f"TOOL {node.name}")
        self.functions.append(node.name)
        self.generic_visit(node)
        self.functions.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.found.refer("import", self.owner, {"module": a.name, "symbol": "", "local": a.asname or a.name.split(".")[0], "glob": False})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.found.refer("import", self.owner, {"module": module, "symbol": "" if a.name == "*" else a.name, "local": a.asname or a.name, "glob": a.name == "*"})

    def visit_Assign(self, node: ast.Assign) -> None:
        if isinstance(node.value, ast.Call) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            made = dotted(node.value.func).rpartition(".")[2]
            if made[:1].isupper():
                self.found.refer("local", self.owner, {"var": node.targets[0].id, "type": made})
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        name = dotted(node.func)
        receiver, _, callee = name.rpartition(".")
        if callee:
            text = node.args[0].value if node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str) else None
            head = receiver.split(".")[0]
            if text is not None and callee in VERBS and head in CLIENTS:
                self.found.refer("consumer", self.owner, f"{callee.upper()} {request_path(text)}")
            elif text is not None and callee in EMITTERS:
                self.found.refer("event_emit", self.owner, text)
            elif text is not None and callee in LISTENERS:
                self.found.refer("event_listen", self.owner, text)
            elif text is not None and callee in ("call_tool", "callTool"):
                self.found.refer("tool_call", self.owner, text)
            self.found.refer("call", self.owner, {"callee": callee, "receiver": receiver, "caller_type": self.types[-1] if self.types else ""})
        self.generic_visit(node)


def request_path(url: str) -> str:
    """The path of a URL, without host, query and trailing slash."""
    path = re.sub(r"^[a-z]+://[^/]*", "", url).split("?")[0].split("#")[0]
    return "/" + path.strip("/") if path.strip("/") else "/"


# Patterns of declarations and imports by language; group 1 is the name.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "javascript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"), ("struct", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)")],
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union)\s+(\w+)"), ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)")],
    "go": [("method", r"^func\s*\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b")],
    "java": [("struct", r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|enum|record)\s+(\w+)"), ("interface", r"^\s*(?:(?:public|private|protected|static)\s+)*@?interface\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*(?:<[^>]+>\s+)?[\w.<>,\[\] ?]+\s+(\w+)\s*\([^;]*\)\s*(?:throws [\w., ]+)?\{")],
}
PATTERNS["typescript"] = PATTERNS["javascript"]
IMPORTS: dict[str, str] = {
    "javascript": r"(?:^\s*import\s+(?P<c>[^'\"]*?)\s*from\s*|^\s*(?:const|let|var)\s+(?P<l>[\w$]+)\s*=\s*require\()\s*['\"](?P<m>[^'\"]+)['\"]", "rust": r"^\s*(?:pub\s+)?use\s+(?P<m>[\w:]+)", "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<m>[\w./-]+)\"\s*$", "java": r"^\s*import\s+(?:static\s+)?(?P<m>[\w.]+)",
}
IMPORTS["typescript"] = IMPORTS["javascript"]
CALL = re.compile(r"(?:([A-Za-z_$][\w$.]*)(?:\.|::))?([A-Za-z_$][\w$]*)\s*\(")
KEYWORDS = frozenset("if for while switch catch return function fn func match else do new super typeof sizeof assert await async void int def class in of".split())
HERITAGE = re.compile(r"\bclass\s+(\w+)(?:<[^>{]*>)?\s*(?:extends\s+([\w.]+))?[^{]*?(?:implements\s+([\w.,\s<>]+?))?\s*\{|\bimpl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)")


def read_patterns(language: str, text: str, found: Found) -> None:
    lines = text.replace("\r\n", "\n").split("\n")
    rules = [(k, re.compile(p)) for k, p in PATTERNS[language]]
    imports = re.compile(IMPORTS[language])
    owners: list[tuple[int, str]] = []
    in_comment = False
    for n, line in enumerate(lines, 1):
        bare = re.sub(r"//.*$", "", line)
        if in_comment:
            if "*/" not in bare:
                continue
            bare, in_comment = bare.split("*/", 1)[1], False
        if "/*" in bare:
            in_comment = "*/" not in bare.split("/*", 1)[1]
            bare = bare.split("/*", 1)[0]
        m = imports.search(bare)
        if m:
            module = m["m"]
            names = re.findall(r"([\w$]+)(?:\s+as\s+([\w$]+))?", (m.groupdict().get("c") or "")) if language in ("javascript", "typescript") else []
            sep = "::" if language == "rust" else "." if language == "java" else "/"
            if names:
                for a, b in names:
                    if a not in ("type", "as", "from"):
                        found.refer("import", "", {"module": module, "symbol": a, "local": b or a, "glob": False})
            elif language in ("rust", "java"):
                head, _, tail = module.rpartition(sep)
                found.refer("import", "", {"module": head or module, "symbol": tail if head else "", "local": tail or module, "glob": False})
            else:
                found.refer("import", "", {"module": module, "symbol": "", "local": m.groupdict().get("l") or module.rstrip("/").rpartition("/")[2], "glob": False})
            continue
        declared = ""
        for kind, rule in rules:
            d = rule.match(bare)
            if d and d[1] not in KEYWORDS:
                found.declare(kind, d[1], n, n)
                declared = d[1]
                if kind in ("function", "method"):
                    owners.append((n, d[1]))
                break
        for c in CALL.finditer(re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", '""', bare)):
            if c[2] not in KEYWORDS and c[2] != declared:
                found.refer("call", owners[-1][1] if owners else "", {"callee": c[2], "receiver": (c[1] or "").replace("::", "."), "caller_type": ""})
    for h in HERITAGE.finditer(text):
        if h[5]:
            found.refer("inherit", h[5], {"base": h[4].rpartition(":")[2], "relation": "implements"})
        else:
            if h[2]:
                found.refer("inherit", h[1], {"base": h[2].rpartition(".")[2], "relation": "inherits"})
            for b in re.findall(r"\w+", h[3] or ""):
                found.refer("inherit", h[1], {"base": b, "relation": "implements"})


# Extensions of the languages read here.
EXTENSIONS = {"py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java", "vue": "component", "svelte": "component", "astro": "component"}


def read_component(path: str, text: str, found: Found) -> None:
    """A single-file component: a component node, calls of the components it renders, and its script block at its lines."""
    name = path.rpartition("/")[2].rpartition(".")[0]
    found.declare("component", name, 1, text.count("\n") + 1)
    for m in re.finditer(r"<script[^>]*>(.*?)</script>|^---\n(.*?)^---$", text, re.S | re.M):
        body, at = (m[1], m.start(1)) if m[1] is not None else (m[2], m.start(2))
        inner = Found()
        read_patterns("typescript", body, inner)
        shift = text.count("\n", 0, at)
        found.declarations += [(k, n, a + shift, b + shift, o) for k, n, a, b, o in inner.declarations]
        found.references += inner.references
    markup = re.sub(r"<(script|style)[^>]*>.*?</\1>|^---\n.*?^---$", "", text, flags=re.S | re.M)
    for tag in sorted(set(re.findall(r"<([A-Z]\w*)", markup))):
        found.refer("call", name, {"callee": tag, "receiver": "", "caller_type": ""})


def read_file(path: str, text: str) -> Found:
    """What one file declares and refers to; nothing for unknown extensions and for Python that doesn't parse."""
    found = Found()
    language = EXTENSIONS.get(path.rpartition(".")[2].lower())
    if language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                PythonReader(found).visit(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError):
            return Found()
    elif language == "component":
        read_component(path, text, found)
    elif language:
        read_patterns(language, text, found)
    return found


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(declarations, references) of files(repo, file_path, text); null texts are left out, repeated rows are the caller's to drop."""

    def run(what: str):
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for repo, path, text in zip(pdf["repo"], pdf["file_path"], pdf["text"]):
                    found = read_file(path, text)
                    if what == "d":
                        if EXTENSIONS.get(path.rpartition(".")[2].lower()):
                            rows.append((repo, path, "file", path, 1, 1, ""))
                        rows += [(repo, path, *d) for d in found.declarations]
                    else:
                        rows += [(repo, path, *r) for r in found.references]
                yield pd.DataFrame(rows, columns=["repo", "file_path", "kind", "name", "start_line", "end_line", "owner_type"] if what == "d" else ["repo", "file_path", "kind", "owner", "target"])

        return go

    src = files.where("text is not null and file_path is not null").select("repo", "file_path", "text")
    return src.mapInPandas(run("d"), DECLARATIONS), src.mapInPandas(run("r"), REFERENCES).dropDuplicates(["repo", "file_path", "kind", "owner", "target"])


def declared_nodes(declarations: DataFrame) -> DataFrame:
    """Declarations with a stable id from what they are; a repeated (file, kind, name, line) is one node."""
    d = declarations.dropDuplicates(["repo", "file_path", "kind", "name", "start_line"])
    return d.withColumn("id", F.xxhash64("repo", "file_path", "kind", "name", "start_line"))
