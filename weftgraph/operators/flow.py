"""Program analysis: control flow, reaching definitions, control dependence, slices and taint, one function a group.

Functions of Python files are read through the standard library's syntax tree into relational tables keyed by
(repo, file_path, function): blocks, edges, definitions, uses, calls, returns. The analyses run per function where order or
a fixpoint matters; what is set-valued (dependence graph, joins between functions) is relational.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import written

KEY = ["repo", "file_path", "function"]
# Where untrusted values come from, where they do harm, and what makes them harmless.
SOURCES = tuple("argv args env environ query body params headers cookies stdin input form GET POST request".split())
SINKS = tuple(
    "eval exec execSync execFile spawn spawnSync system popen query execute executemany raw innerHTML insertAdjacentHTML writeFile writeFileSync readFile readFileSync createReadStream "
    "sendFile send_file render_template_string deserialize loads unserialize Function".split()
)
SANITIZERS = tuple(
    "escape escapeHtml escapeHTML escape_html escapeString escape_string escapeIdentifier escape_identifier sanitize sanitizeHtml sanitize_html encodeURI encodeURIComponent htmlspecialchars "
    "quote quote_ident quoteIdentifier shlex_quote parseInt parseFloat Number int float".split()
)
TAINT_ROUNDS, SUMMARY_ROUNDS = 8, 3


class Graph:
    """Blocks of one function: cut at branches, loops and jumps; the last block is the exit."""

    def __init__(self) -> None:
        self.blocks: list[list] = []  # start line, end line, exit kind
        self.edges: list[tuple[int, int, str]] = []
        self.defs: list[tuple[str, int, int]] = []  # name, block, line
        self.uses: list[tuple[str, int, int]] = []
        self.calls: list[tuple[str, int, int, list[list[str]]]] = []
        self.returns: list[tuple[int, list[str]]] = []
        self.params: list[str] = []


def names_in(node: ast.AST | None) -> list[str]:
    return [] if node is None else list(dict.fromkeys(n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)))


class Builder:
    def __init__(self, fn: ast.FunctionDef | ast.AsyncFunctionDef):
        self.g = Graph()
        self.loops: list[tuple[int, list[int]]] = []
        self.open_exits: list[tuple[int, str]] = []
        a = fn.args
        self.g.params = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
        first = self.block(fn.lineno)
        for p in self.g.params:
            self.g.defs.append((p, first, fn.lineno))
        last = self.body(fn.body, first)
        exit_ = self.block(fn.end_lineno or fn.lineno, "exit")
        if last is not None:
            self.edge(last, exit_, "sequential")
        for b, kind in self.open_exits:
            self.edge(b, exit_, kind)

    def block(self, line: int, kind: str = "fallthrough") -> int:
        self.g.blocks.append([line, line, kind])
        return len(self.g.blocks) - 1

    def edge(self, a: int, b: int, kind: str) -> None:
        self.g.edges.append((a, b, kind))

    def reads(self, node: ast.AST | None, block: int) -> None:
        if node is None:
            return
        for n in ast.walk(node):
            if isinstance(n, ast.Name):
                (self.g.uses if isinstance(n.ctx, ast.Load) else self.g.defs).append((n.id, block, n.lineno))
            elif isinstance(n, ast.Call):
                f = n.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if name:
                    self.g.calls.append((name, block, n.lineno, [names_in(x) for x in [*n.args, *(k.value for k in n.keywords)]]))

    def touch(self, block: int, line: int) -> None:
        self.g.blocks[block][1] = max(self.g.blocks[block][1], line)

    def body(self, stmts: list[ast.stmt], now: int | None) -> int | None:
        for s in stmts:
            if now is None:
                now = self.block(s.lineno)  # unreachable
            now = self.statement(s, now)
        return now

    def statement(self, s: ast.stmt, now: int) -> int | None:
        g = self.g
        self.touch(now, s.lineno)
        if isinstance(s, ast.If):
            self.reads(s.test, now)
            g.blocks[now][2] = "branch"
            yes = self.block(s.body[0].lineno)
            self.edge(now, yes, "true")
            end_yes = self.body(s.body, yes)
            if s.orelse:
                no = self.block(s.orelse[0].lineno)
                self.edge(now, no, "false")
                end_no = self.body(s.orelse, no)
                if end_yes is None and end_no is None:
                    return None
                after = self.block(s.end_lineno or s.lineno)
                for e in (end_yes, end_no):
                    if e is not None:
                        self.edge(e, after, "sequential")
                return after
            after = self.block(s.end_lineno or s.lineno)
            self.edge(now, after, "false")
            if end_yes is not None:
                self.edge(end_yes, after, "sequential")
            return after
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            head = self.block(s.lineno, "loop")
            self.edge(now, head, "sequential")
            self.reads(s.test if isinstance(s, ast.While) else s.iter, head)
            if not isinstance(s, ast.While):
                self.reads(s.target, head)
            inner = self.block(s.body[0].lineno)
            self.edge(head, inner, "true")
            breaks: list[int] = []
            self.loops.append((head, breaks))
            end = self.body(s.body, inner)
            self.loops.pop()
            if end is not None:
                self.edge(end, head, "back")
            after = self.block(s.end_lineno or s.lineno)
            if s.orelse:
                no = self.block(s.orelse[0].lineno)
                self.edge(head, no, "false")
                end_no = self.body(s.orelse, no)
                if end_no is not None:
                    self.edge(end_no, after, "sequential")
            else:
                self.edge(head, after, "false")
            for b in breaks:
                self.edge(b, after, "sequential")
            return after
        if isinstance(s, (ast.Return, ast.Raise)):
            value = s.value if isinstance(s, ast.Return) else s.exc
            self.reads(value, now)
            g.blocks[now][2] = "return"
            if isinstance(s, ast.Return):
                g.returns.append((s.lineno, names_in(value)))
            self.open_exits.append((now, "sequential"))
            return None
        if isinstance(s, (ast.Break, ast.Continue)):
            g.blocks[now][2] = "break" if isinstance(s, ast.Break) else "continue"
            if self.loops:
                head, breaks = self.loops[-1]
                if isinstance(s, ast.Break):
                    breaks.append(now)
                else:
                    self.edge(now, head, "back")
            return None
        if isinstance(s, ast.Try) or type(s).__name__ == "TryStar":
            inner = self.block(s.lineno)
            self.edge(now, inner, "sequential")
            ends = [self.body([*s.body, *s.orelse], inner)]
            for h in s.handlers:
                b = self.block(h.lineno)
                self.edge(inner, b, "false")
                if h.name:
                    g.defs.append((h.name, b, h.lineno))
                ends.append(self.body(h.body, b))
            ends = [e for e in ends if e is not None]
            if not ends and not s.finalbody:
                return None
            after = self.block(s.finalbody[0].lineno if s.finalbody else s.end_lineno or s.lineno)
            for e in ends or [inner]:
                self.edge(e, after, "sequential")
            return self.body(s.finalbody, after)
        if isinstance(s, (ast.With, ast.AsyncWith)):
            for i in s.items:
                self.reads(i.context_expr, now)
                self.reads(i.optional_vars, now)
            return self.body(s.body, now)
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            g.defs.append((s.name, now, s.lineno))
            return now
        if isinstance(s, ast.AugAssign):
            self.reads(s.value, now)
            if isinstance(s.target, ast.Name):
                g.uses.append((s.target.id, now, s.lineno))
                g.defs.append((s.target.id, now, s.lineno))
            else:
                self.reads(s.target, now)
            return now
        self.reads(s, now)
        return now


def functions_of(text: str) -> list[tuple[str, Graph]]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out, seen = [], {}
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            seen[n.name] = seen.get(n.name, 0) + 1
            out.append((n.name if seen[n.name] == 1 else f"{n.name}#{seen[n.name]}", Builder(n).g))
    return out


PARTS = {
    "blocks": ("id int, start_line int, end_line int, exit string", lambda g: [(i, *b) for i, b in enumerate(g.blocks)]),
    "edges": ("src int, dst int, kind string", lambda g: g.edges),
    "defs": ("name string, block int, line int", lambda g: list(dict.fromkeys(g.defs))),
    "uses": ("name string, block int, line int", lambda g: list(dict.fromkeys(g.uses))),
    "calls": ("callee string, block int, line int, arguments array<array<string>>", lambda g: g.calls),
    "returns": ("line int, names array<string>", lambda g: g.returns),
    "params": ("position int, name string", lambda g: list(enumerate(g.params))),
}


def control_flow(files: DataFrame, part: str) -> DataFrame:
    """One relation of the functions in files(repo, file_path, text): blocks, edges, defs, uses, calls, returns or params."""
    schema, rows_of = PARTS[part]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*KEY, *(c.split(" ")[0] for c in schema.split(", "))]
        for pdf in batches:
            rows = [(repo, path, fn, *r) for repo, path, text in zip(pdf["repo"], pdf["file_path"], pdf["text"]) for fn, g in functions_of(text) for r in rows_of(g)]
            yield pd.DataFrame(rows, columns=names)

    py = files.where("text is not null").where(F.lower("file_path").rlike(r"\.pyw?$")).select("repo", "file_path", "text")
    return py.mapInPandas(run, "repo string, file_path string, function string, " + schema)


# exact analyses of one function


def reaching(blocks: list[int], edges: list[tuple[int, int]], defs: list[tuple[str, int, int]]) -> dict[int, set[tuple[str, int, int]]]:
    """Definitions that may reach the start of each block; a block kills by name and generates all its own."""
    gen: dict[int, set] = {b: set() for b in blocks}
    for d in defs:
        gen[d[1]].add(d)
    killed = {b: {n for n, _, _ in gen[b]} for b in blocks}
    into: dict[int, set] = {b: set() for b in blocks}
    before: dict[int, list[int]] = {b: [] for b in blocks}
    for a, b in edges:
        before[b].append(a)
    changed = True
    while changed:
        changed = False
        for b in blocks:
            new = set()
            for a in before[b]:
                new |= gen[a] | {d for d in into[a] if d[0] not in killed[a]}
            if new != into[b]:
                into[b], changed = new, True
    return into


def def_use(into: dict[int, set], defs: list[tuple[str, int, int]], uses: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(name, definition line, use line): the last definition of the name in the block up to the use shadows what reaches the block."""
    out = set()
    for name, block, line in uses:
        local = [d[2] for d in defs if d[0] == name and d[1] == block and d[2] <= line]
        if local:
            out.add((name, max(local), line))
        else:
            out |= {(name, d[2], line) for d in into[block] if d[0] == name}
    return sorted(out)


def post_dominators(blocks: list[int], edges: list[tuple[int, int]]) -> dict[int, set[int]]:
    after: dict[int, list[int]] = {b: [] for b in blocks}
    for a, b in edges:
        after[a].append(b)
    exits = [b for b in blocks if not after[b]]
    pd_: dict[int, set[int]] = {b: ({b} if b in exits else set(blocks)) for b in blocks}
    changed = True
    while changed:
        changed = False
        for b in reversed(blocks):
            if b in exits:
                continue
            new = set.intersection(*(pd_[s] for s in after[b])) | {b}
            if new != pd_[b]:
                pd_[b], changed = new, True
    return pd_


def control_dependence(blocks: list[int], edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(block, on): blocks that a branching block decides: up the post-dominator tree from each of its successors to its own parent."""
    pd_ = post_dominators(blocks, edges)
    parent: dict[int, int | None] = {}
    for b in blocks:
        strict = pd_[b] - {b}
        parent[b] = max(strict, key=lambda x: (len(pd_[x]), x)) if strict else None
    after: dict[int, list[int]] = {b: [] for b in blocks}
    for a, b in edges:
        after[a].append(b)
    out = set()
    for a in blocks:
        if len(set(after[a])) < 2:
            continue
        for s in after[a]:
            at: int | None = s
            seen = set()
            while at is not None and at != parent[a] and at not in seen:
                seen.add(at)
                if at != a:
                    out.add((at, a))
                at = parent[at]
    return sorted(out)


def dependences(files: DataFrame) -> DataFrame:
    """(repo, file_path, function, line, on, kind): the line-level dependence graph, control and data; a line's on itself apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, path, text in zip(pdf["repo"], pdf["file_path"], pdf["text"]):
                for fn, g in functions_of(text):
                    ids, e = list(range(len(g.blocks))), [(a, b) for a, b, _ in g.edges]
                    into = reaching(ids, e, g.defs)
                    for _, d, u in def_use(into, g.defs, g.uses):
                        if d != u:
                            rows.append((repo, path, fn, u, d, "data"))
                    lines: dict[int, set[int]] = {b: set() for b in ids}
                    for _, b, n in [*g.defs, *g.uses]:
                        lines[b].add(n)
                    for _, b, n, _ in g.calls:
                        lines[b].add(n)
                    for b, on in control_dependence(ids, e):
                        rows += [(repo, path, fn, n, g.blocks[on][1], "control") for n in lines[b] if n != g.blocks[on][1]]
            yield pd.DataFrame(rows, columns=[*KEY, "line", "on", "kind"])

    py = files.where("text is not null").where(F.lower("file_path").rlike(r"\.pyw?$")).select("repo", "file_path", "text")
    return py.mapInPandas(run, "repo string, file_path string, function string, line int, on int, kind string").distinct()


def backward_slice(pdg: DataFrame, lines: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(repo, file_path, function, start, line) of all lines that lines(repo, file_path, function, line) depend on, transitively; a frontier loop."""
    e = written(pdg.select(*KEY, F.col("line").alias("at"), F.col("on").alias("line")).distinct(), "pdg")
    frontier = written(lines.select(*KEY, F.col("line").alias("start"), "line").distinct(), "slice")
    seen = frontier
    for _ in range(most_rounds):
        new = frontier.withColumnRenamed("line", "at").join(e, [*KEY, "at"]).select(*KEY, "start", "line").distinct().join(seen, [*KEY, "start", "line"], "left_anti")
        frontier = written(new, "slice")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


# taint


def taint_function(g: Graph, tainted: dict[str, tuple] | None = None, source_calls: frozenset = frozenset(), sink_args: dict[str, set[int]] | None = None) -> tuple[list[tuple], bool, list[int]]:
    """(findings, whether a tainted value is returned, lines where a sanitizer stopped one) of one function.

    findings: (source line, source, sink line, sink, variable, guarded). Taint flows along definitions in line order for at
    most TAINT_ROUNDS rounds; a sanitizer on a line makes what it defines clean. ``tainted`` starts with parameters.
    """
    marks: dict[str, tuple[int, str]] = dict(tainted or {})
    calls_at: dict[int, list] = {}
    for c in g.calls:
        calls_at.setdefault(c[2], []).append(c)
    uses_at: dict[int, list[str]] = {}
    for n, _, line in g.uses:
        uses_at.setdefault(line, []).append(n)
    defs_at: dict[int, list[str]] = {}
    for n, _, line in g.defs:
        defs_at.setdefault(line, []).append(n)
    guarded = {b for b, _ in control_dependence(list(range(len(g.blocks))), [(a, b) for a, b, _ in g.edges])}
    stopped: list[int] = []
    for _ in range(TAINT_ROUNDS):
        before = dict(marks)
        for line in sorted(set(defs_at) | set(uses_at) | set(calls_at)):
            words = [c[0] for c in calls_at.get(line, ())] + uses_at.get(line, [])
            clean = any(w in SANITIZERS for w in words)
            hot = next((w for w in words if w in SOURCES or w in source_calls), None)
            came = (line, hot) if hot else next((marks[u] for u in uses_at.get(line, ()) if u in marks), None)
            if came and clean:
                if line not in stopped and any(u in marks for u in uses_at.get(line, ())):
                    stopped.append(line)
                continue
            if came:
                for d in defs_at.get(line, ()):
                    marks.setdefault(d, came)
        if marks == before:
            break
    found = []
    for name, block, line, args in g.calls:
        words = [c[0] for c in calls_at[line]]
        if any(w in SANITIZERS for w in words):
            continue
        sink = name in SINKS
        positions = (sink_args or {}).get(name)
        if not sink and positions is None:
            continue
        for k, arg in enumerate(args):
            if positions is not None and not sink and k not in positions:
                continue
            for a in arg:
                if a in marks:
                    found.append((marks[a][0], marks[a][1], line, name, a, block in guarded))
                elif a in SOURCES:
                    found.append((line, a, line, name, a, block in guarded))
    back = any(n in marks for _, names in g.returns for n in names)
    return sorted(set(found)), back, stopped


def summaries(g: Graph, source_calls: frozenset = frozenset(), sink_args: dict[str, set[int]] | None = None) -> tuple[list[int], bool, bool, bool]:
    """(positions of parameters that reach a sink, whether a parameter is returned, whether a source is, whether it cleans)."""
    reach, returned = [], False
    for k, p in enumerate(g.params):
        found, back, _ = taint_function(g, {p: (0, p)}, frozenset(), sink_args)
        if any(f[1] == p for f in found):
            reach.append(k)
        returned |= back
    _, source_back, _ = taint_function(g, {}, source_calls)
    source_back |= any(n in SOURCES or n in source_calls for _, names in g.returns for n in names)
    return reach, returned, source_back, any(c[0] in SANITIZERS for c in g.calls)


def taint(files: DataFrame) -> DataFrame:
    """(repo, file_path, function, source_line, source, sink_line, sink, variable, guarded) within single functions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(repo, path, fn, *f) for repo, path, text in zip(pdf["repo"], pdf["file_path"], pdf["text"]) for fn, g in functions_of(text) for f in taint_function(g)[0]]
            yield pd.DataFrame(rows, columns=[*KEY, "source_line", "source", "sink_line", "sink", "variable", "guarded"])

    py = files.where("text is not null").where(F.lower("file_path").rlike(r"\.pyw?$")).select("repo", "file_path", "text")
    return py.mapInPandas(run, "repo string, file_path string, function string, source_line int, source string, sink_line int, sink string, variable string, guarded boolean")


def program_taint(files: DataFrame, rounds: int = SUMMARY_ROUNDS) -> DataFrame:
    """Findings across calls within a repository: (repo, file_path, function, source_line, source, sink_line, sink, variable, guarded, candidates, guessed).

    Each round summarises every function with what the round before knew of its callees: parameters that reach a sink,
    and sources that are returned. A callee is looked up in the same file, else by name in the repository: then it is a
    guess among ``candidates`` functions. Summaries travel to the callers as joins on the callee's name.
    """
    py = written(files.where("text is not null").where(F.lower("file_path").rlike(r"\.pyw?$")).select("repo", "file_path", "text"), "py")
    called = written(control_flow(py, "calls").select("repo", "file_path", "callee").distinct(), "called")
    schema = "repo string, file_path string, function string, reach array<int>, back boolean, source boolean, clean boolean"
    known: DataFrame | None = None

    def with_known(known: DataFrame | None) -> DataFrame:
        if known is None:
            return py.withColumn("facts", F.lit(None).cast("array<struct<callee:string,reach:array<int>,source:boolean>>"))
        k = known.where("size(reach) > 0 or source")
        own = called.join(k.select("repo", "file_path", F.col("function").alias("callee"), "reach", "source"), ["repo", "file_path", "callee"])
        rest = called.join(own.select("repo", "file_path", "callee").distinct(), ["repo", "file_path", "callee"], "left_anti")
        merged = k.groupBy("repo", F.col("function").alias("callee")).agg(F.array_distinct(F.flatten(F.collect_set("reach"))).alias("reach"), F.max("source").alias("source"))
        far = rest.join(merged, ["repo", "callee"])
        facts = own.unionByName(far.select(*own.columns)).groupBy("repo", "file_path").agg(F.collect_list(F.struct("callee", "reach", "source")).alias("facts"))
        return py.join(facts, ["repo", "file_path"], "left")

    def facts_of(facts) -> tuple[frozenset, dict[str, set[int]]]:
        rows = list(facts) if facts is not None else []
        return frozenset(r["callee"] for r in rows if r["source"]), {r["callee"]: set(r["reach"]) for r in rows if len(r["reach"])}

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, path, text, facts in zip(pdf["repo"], pdf["file_path"], pdf["text"], pdf["facts"]):
                src, args = facts_of(facts)
                rows += [(repo, path, fn, *summaries(g, src, args)) for fn, g in functions_of(text)]
            yield pd.DataFrame(rows, columns=[*KEY, "reach", "back", "source", "clean"])

    for _ in range(rounds):
        known = written(with_known(known).select("repo", "file_path", "text", "facts").mapInPandas(summarise, schema), "summaries")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, path, text, facts in zip(pdf["repo"], pdf["file_path"], pdf["text"], pdf["facts"]):
                src, args = facts_of(facts)
                rows += [(repo, path, fn, *f) for fn, g in functions_of(text) for f in taint_function(g, {}, src, args)[0]]
            yield pd.DataFrame(rows, columns=[*KEY, "source_line", "source", "sink_line", "sink", "variable", "guarded"])

    found = with_known(known).select("repo", "file_path", "text", "facts").mapInPandas(find, "repo string, file_path string, function string, source_line int, source string, sink_line int, sink string, variable string, guarded boolean")
    same = known.select("repo", "file_path", F.col("function").alias("sink")).distinct().withColumn("own", F.lit(True))
    count = known.groupBy("repo", F.col("function").alias("sink")).agg(F.count(F.lit(1)).alias("candidates"))
    out = found.join(same, ["repo", "file_path", "sink"], "left").join(count, ["repo", "sink"], "left")
    return out.select(*KEY, "source_line", "source", "sink_line", "sink", "variable", "guarded", F.coalesce("candidates", F.lit(0)).alias("candidates"), (F.col("own").isNull() & F.col("candidates").isNotNull()).alias("guessed"))


def def_use_relational(defs: DataFrame, uses: DataFrame, into: DataFrame) -> DataFrame:
    """(repo, file_path, function, name, def_line, use_line) from relations: a window for the local definition, else a join with into(.., block, name, line)."""
    u = uses.select(*KEY, "name", "block", F.col("line").alias("use_line"))
    local = u.join(defs.select(*KEY, "name", "block", F.col("line").alias("def_line")), [*KEY, "name", "block"], "left")
    w = Window.partitionBy(*KEY, "name", "block", "use_line")
    best = local.withColumn("m", F.max(F.when(F.col("def_line") <= F.col("use_line"), F.col("def_line"))).over(w)).select(*KEY, "name", "block", "use_line", "m").distinct()
    near = best.where("m is not null").select(*KEY, "name", F.col("m").alias("def_line"), "use_line")
    far = best.where("m is null").join(into.select(*KEY, "block", "name", F.col("line").alias("def_line")), [*KEY, "block", "name"]).select(*KEY, "name", "def_line", "use_line")
    return near.unionByName(far).distinct()
