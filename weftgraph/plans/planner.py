"""Syntax tree to DataFrame: patterns become joins, predicates two-valued columns, and Catalyst does the rest.

A node variable v is six flat columns v__id .. v__end_line, so what a query doesn't use is pruned at the scans and never
shuffled. A relationship variable r is one column r__path, an array of its edges. Comparisons are typed here: values of
different types never compare equal and no comparison is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import PropertyGraph
from weftgraph.plans.lexer import QueryError
from weftgraph.plans.parser import NODE_PROPERTIES, PATH_PROPERTIES, Hop, NodePattern, Pattern, Query, Select, Test, Value, parse

STORED = {"id": "id", "kind": "kind", "name": "name", "file": "file_path", "line": "start_line", "end_line": "end_line"}
KEY, COUNT = "__key", "__count"


@dataclass
class Answer:
    """rows: the paged result; total: everything before paging, for the truncated flag; both lazy."""

    rows: DataFrame
    columns: list[str]
    parts: list[tuple[DataFrame, int, bool]]

    def truncated(self) -> bool:
        """Whether a limit was clamped or rows lie beyond an arm's page; counts at most one row past each page."""
        return any(clamped or df.limit(end + 1).count() > end for df, end, clamped in self.parts)


def node_frame(g: PropertyGraph, n: NodePattern) -> DataFrame:
    df = g.nodes
    if n.kind:
        df = df.where(F.col("kind") == n.kind)
    for p, v in n.properties.items():
        df = df.where(F.col(STORED[p]) == F.lit(v) if (NODE_PROPERTIES[p] == "int") == isinstance(v, int) else F.lit(False))
    return df.select(*(F.col(c).alias(f"{n.var}__{p}") for p, c in STORED.items()))


def node_filter(n: NodePattern) -> Column:
    tests = [F.col(f"{n.var}__id").isNotNull()]
    if n.kind:
        tests.append(F.col(f"{n.var}__kind") == n.kind)
    for p, v in n.properties.items():
        same = (NODE_PROPERTIES[p] == "int") == isinstance(v, int)
        tests.append(F.col(f"{n.var}__{p}") == F.lit(v) if same else F.lit(False))
    return reduce(lambda a, b: a & b, tests)


def steps(g: PropertyGraph, hop: Hop, named: bool) -> DataFrame:
    """(__from, __to, __edge) of one hop in the asked direction; an undirected self-loop counts twice.

    ``named`` edges carry the names of their ends; only a query that returns the path pays for these joins.
    """
    e = g.edges
    if hop.types:
        e = e.where(F.col("kind").isin(*hop.types))
    ends = []
    if named:
        for end, name in (("src", "source"), ("dst", "target")):
            e = e.join(g.nodes.select(F.col("id").alias(end), F.col("name").alias(name)), end, "left")
            ends.append(name)
    edge = F.struct("src", "dst", "kind", "confidence", *ends).alias("__edge")
    out = e.select(F.col("src").alias("__from"), F.col("dst").alias("__to"), edge)
    into = e.select(F.col("dst").alias("__from"), F.col("src").alias("__to"), edge)
    return out if hop.direction == "out" else into if hop.direction == "in" else out.unionByName(into)


def walk(rows: DataFrame, start: str, hop: Hop, g: PropertyGraph, bound: bool, named: bool = False) -> DataFrame:
    """rows with __to and the path column; every path of low..high hops is a row, no edge repeats inside one path."""
    path = "__path" if bound else f"{hop.var}__path"
    s = steps(g, hop, named)
    ids = g.nodes.select(F.col("id").alias("__to"))
    level = rows.join(s, F.col(f"{start}__id") == F.col("__from")).drop("__from").withColumn(path, F.array("__edge")).drop("__edge")
    if hop.high == 1:
        return level
    same = lambda x: (x["src"] == F.col("__edge.src")) & (x["dst"] == F.col("__edge.dst")) & (x["kind"] == F.col("__edge.kind"))
    out = [level] if hop.low <= 1 else []
    for k in range(2, hop.high + 1):
        # a path goes on only over nodes that exist
        here = level.join(ids, "__to", "left_semi").withColumnRenamed("__to", "__at")
        level = (
            here.join(s, F.col("__at") == F.col("__from")).where(~F.exists(path, same))
            .withColumn(path, F.concat(path, F.array("__edge"))).drop("__at", "__from", "__edge")
        )
        if k >= hop.low:
            out.append(level)
    return reduce(DataFrame.unionByName, out)


def _variables(t: Test | Value | None) -> set[str]:
    """The variables that a condition names."""
    if isinstance(t, Value):
        return {t.var} if t.kind in ("variable", "property") or t.var else set()
    return {v for a in t.args if isinstance(a, (Test, Value)) for v in _variables(a)} if isinstance(t, Test) else set()


class Plan:
    def __init__(self, g: PropertyGraph, select: Select):
        self.g, self.select = g, select
        self.vars: dict[str, str] = {}  # name -> node | path, in the order of declaration
        self.single: dict[str, bool] = {}  # path variables of exactly one hop
        self.returned = {i.value.var for i in select.items if i.value is not None and i.value.kind == "variable"}

    def bind(self, var: str, kind: str) -> bool:
        """Whether the variable was bound before."""
        known = self.vars.setdefault(var, kind)
        if known != kind:
            raise QueryError(f"{var!r} is a {known} already and can't be a {kind}")
        return False

    def pattern(self, rows: DataFrame | None, p: Pattern) -> DataFrame:
        first = p.nodes[0]
        if first.var in self.vars:
            self.bind(first.var, "node")
            rows = rows.where(node_filter(first))
        else:
            new = node_frame(self.g, first)
            rows = new if rows is None else rows.crossJoin(new)  # only patterns that share no variable
            self.bind(first.var, "node")
        for hop, here, there in zip(p.hops, p.nodes, p.nodes[1:]):
            bound = hop.var in self.vars
            self.bind(hop.var, "path")
            self.single[hop.var] = self.single.get(hop.var, True) and hop.high == 1
            rows = walk(rows, here.var, hop, self.g, bound, hop.var in self.returned)
            if bound:
                rows = rows.where(F.col("__path") == F.col(f"{hop.var}__path")).drop("__path")
            if there.var in self.vars:
                self.bind(there.var, "node")
                rows = rows.where((F.col("__to") == F.col(f"{there.var}__id")) & node_filter(there)).drop("__to")
            else:
                rows = rows.join(node_frame(self.g, there), F.col("__to") == F.col(f"{there.var}__id")).drop("__to")
                self.bind(there.var, "node")
        return rows

    def optional(self, rows: DataFrame, p: Pattern) -> DataFrame:
        """Left outer: the pattern is expanded from the distinct bound values of its first bound node, to both sides, then joined back on them."""
        used = [n.var for n in p.nodes] + [h.var for h in p.hops]
        keys = [f"{v}__id" if self.vars[v] == "node" else f"{v}__path" for v in self.vars if v in used]
        carried = [f"{v}__{q}" for v in self.vars if v in used and self.vars[v] == "node" for q in STORED] + [k for k in keys if k.endswith("__path")]
        if not any(n.var in self.vars for n in p.nodes):
            other = Plan(self.g, self.select)
            right = other.pattern(None, p)
            self.vars |= other.vars
            self.single |= other.single
            return rows.join(right, F.lit(True), "left")
        declared = [*self.vars, *(v for pair in zip([n.var for n in p.nodes], [*(h.var for h in p.hops), ""]) for v in pair if v)]
        at = next(k for k, n in enumerate(p.nodes) if n.var in self.vars)
        right = rows.select(*carried).distinct()
        if at:
            right = self.pattern(right, reverse(Pattern(p.nodes[: at + 1], p.hops[:at], True)))
        if at < len(p.nodes) - 1:
            right = self.pattern(right, Pattern(p.nodes[at:], p.hops[at:], True))
        elif not at:
            right = self.pattern(right, p)
        self.vars = {v: self.vars[v] for v in dict.fromkeys(declared)}  # ties are broken in the order of declaration
        new = [c for c in right.columns if c not in carried]
        right = right.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *new)
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        return rows.join(right, on, "left").drop(*(f"__k{i}" for i in range(len(keys))))

    def rows(self, fold: bool = False) -> DataFrame:
        """The matches; with ``fold`` a query that only counts them may get one row, and a count, for several."""
        rows: DataFrame | None = None
        counted = fold and all(i.aggregate == "count" and i.value is None for i in self.select.items if i.aggregate) and any(i.aggregate for i in self.select.items)
        for k, p in enumerate(self.select.patterns):
            rows = self.optional(rows, p) if p.optional else self.pattern(rows, p)
            if counted and k + 1 < len(self.select.patterns):
                rows = self.folded(rows, self.select.patterns[k + 1 :])
        if self.select.where is not None:
            rows = rows.where(self.truth(self.select.where, True))
        return rows

    def folded(self, rows: DataFrame, later: list[Pattern]) -> DataFrame:
        """Where only rows are counted: one row, with how many there are of it, for all that agree in what is still asked for; so patterns multiply counts at a hot node, not rows."""
        used = {n.var for p in later for n in p.nodes} | {h.var for p in later for h in p.hops} | {i.value.var for i in self.select.items if i.value is not None} | _variables(self.select.where)
        keep = [c for c in rows.columns if c != COUNT and c.rsplit("__", 1)[0] in used]
        n = F.sum(COUNT) if COUNT in rows.columns else F.count(F.lit(1))
        return rows.groupBy(*keep).agg(n.alias(COUNT)).where(F.col(COUNT) > 0)

    # expressions: (type, column), type one of int, text, node, path, null

    def value(self, v: Value) -> tuple[str, Column]:
        if v.kind in ("text", "int"):
            return v.kind, F.lit(v.value) if v.kind == "text" else F.lit(v.value).cast("bigint")
        kind = self.vars.get(v.var)
        if kind is None:
            raise QueryError(f"{v.var!r} is not bound by any pattern; bound are {', '.join(x for x in self.vars if x[0] != '_')}")
        if v.kind == "variable":
            return kind, F.col(f"{v.var}__id") if kind == "node" else F.col(f"{v.var}__path")
        if kind == "node":
            of = NODE_PROPERTIES.get(v.value)
            return (of, F.col(f"{v.var}__{v.value}").cast("bigint" if of == "int" else "string")) if of else ("null", F.lit(None).cast("string"))
        if v.value not in PATH_PROPERTIES:
            return "null", F.lit(None).cast("string")
        path = F.col(f"{v.var}__path")
        got = F.upper(path[0]["kind"]) if v.value == "type" else path[0]["confidence"]
        return "text", F.when(F.size(path) == 1, got)

    def truth(self, t: Test, filters: bool = False) -> Column:
        """Two-valued. Where the test only filters rows, outside any NOT, null may stand for false: such tests reach the scan."""
        if t.op == "and":
            return self.truth(t.args[0], filters) & self.truth(t.args[1], filters)
        if t.op == "or":
            return self.truth(t.args[0], filters) | self.truth(t.args[1], filters)
        if t.op == "not":
            return ~self.truth(t.args[0])
        if t.op == "null":
            kind, col = self.value(t.args[0])
            return F.lit(True) if kind == "null" else col.isNull()
        if t.op == "in":
            kind, col = self.value(t.args[0])
            same = [x.value for x in t.args[1] if x.kind == kind]
            if not same:
                return F.lit(False)
            return col.isin(*same) if filters else F.coalesce(col.isin(*same), F.lit(False))
        (lk, left), (rk, right) = self.value(t.args[0]), self.value(t.args[1])
        if t.symbol == "<>":
            if lk == rk and lk != "null":
                return ~left.eqNullSafe(right)
            return ~(left.isNull() & right.isNull())
        if lk != rk or lk not in ("int", "text") or t.symbol in ("contains", "starts", "ends") and lk != "text":
            return F.lit(False)
        got = {
            "=": lambda: left == right, "<": lambda: left < right, "<=": lambda: left <= right, ">": lambda: left > right, ">=": lambda: left >= right,
            "contains": lambda: left.contains(right), "starts": lambda: left.startswith(right), "ends": lambda: left.endswith(right),
        }[t.symbol]()
        return got if filters else F.coalesce(got, F.lit(False))

    # projection

    def shown(self, v: Value) -> Column:
        kind, col = self.value(v)
        if kind == "node":
            return F.when(col.isNotNull(), F.struct(*(F.col(f"{v.var}__{p}").alias(p) for p in STORED)))
        if kind == "path":
            return F.transform(col, lambda e: F.struct(F.upper(e["kind"]).alias("type"), e["confidence"].alias("confidence"), e["source"].alias("source"), e["target"].alias("target")))
        return col

    def hidden(self) -> list[Column]:
        """Tie-breaks of the order: bound ids, then paths, in the order of declaration."""
        return [F.col(f"{v}__id") if k == "node" else F.col(f"{v}__path") for v, k in self.vars.items()]

    def aggregate(self, name: str, v: Value | None) -> Column:
        if v is None:
            return F.count(F.lit(1))
        kind, col = self.value(v)
        shown = self.shown(v)
        if name == "count":
            return F.count(col)
        if name == "collect":
            keyed = F.collect_list(F.when(col.isNotNull(), F.struct(*(h.alias(f"o{i}") for i, h in enumerate(self.hidden())), shown.alias("x"))))
            return F.transform(F.array_sort(keyed), lambda s: s["x"])
        if name in ("min", "max"):
            return (F.min if name == "min" else F.max)(col if kind in ("int", "text") else F.lit(None).cast("string"))
        if kind != "int":
            return F.max(F.lit(None).cast("double"))
        return F.sum(col) if name == "sum" else F.avg(col.cast("double"))

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(everything, the page)."""
        s, rows = self.select, self.rows(fold=True)
        names = [i.alias for i in s.items]
        if len(set(names)) != len(names):
            raise QueryError("two returned columns have the same name; use AS")
        if any(i.aggregate for i in s.items):
            keys = [self.shown(i.value).alias(i.alias) for i in s.items if not i.aggregate]
            many = COUNT in rows.columns
            aggs = [(F.coalesce(F.sum(COUNT), F.lit(0)) if many else self.aggregate(i.aggregate, i.value)).alias(i.alias) for i in s.items if i.aggregate]
            if keys:
                out = rows.groupBy(*keys).agg(*aggs)
            else:  # no rows, no group
                out = rows.agg(*aggs, F.count(F.lit(1)).alias(KEY)).where(F.col(KEY) > 0)
            out = out.select(*(F.col(f"`{n}`") for n in names))
            ties = [F.col(f"`{i.alias}`").asc_nulls_last() for i in s.items if not i.aggregate]
        else:
            hide = self.hidden()
            shown = [self.shown(i.value).alias(i.alias) for i in s.items]
            if s.distinct:
                out = rows.select(*shown).distinct()
                ties = [F.col(f"`{n}`").asc_nulls_last() for n in names]
            else:
                out = rows.select(*shown, *(h.alias(f"__h{k}") for k, h in enumerate(hide)))
                ties = [F.col(f"__h{k}").asc_nulls_last() for k in range(len(hide))]
        if s.distinct and any(i.aggregate for i in s.items):
            out = out.distinct()
        order = [F.col(f"`{n}`").desc_nulls_first() if down else F.col(f"`{n}`").asc_nulls_last() for n, down in s.order]
        page = out.orderBy(*order, *ties) if order or ties else out
        page = page.offset(s.skip).limit(s.limit) if s.skip else page.limit(s.limit)
        return out, page.select(*(F.col(f"`{n}`") for n in names))


def reverse(p: Pattern) -> Pattern:
    turn = {"out": "in", "in": "out", "both": "both"}
    return Pattern(p.nodes[::-1], [Hop(h.var, h.types, turn[h.direction], h.low, h.high, h.named) for h in p.hops[::-1]], p.optional)


def plan(g: PropertyGraph, query: Query) -> Answer:
    out: DataFrame | None = None
    parts = []
    for k, arm in enumerate(query.arms):
        everything, page = Plan(g, arm).run()
        parts.append((everything, arm.skip + arm.limit, arm.clamped))
        if out is None:
            out = page
        else:
            out = out.unionByName(page)
            if not query.keep[k - 1]:
                out = out.distinct()
    return Answer(out, [i.alias for i in query.arms[0].items], parts)


def cypher(g: PropertyGraph, text: str, budget: int | None = None) -> DataFrame:
    """The rows of a query. ``budget`` refuses patterns that match more rows than that; by default there is no budget."""
    query = parse(text)
    if budget is not None:
        for arm in query.arms:
            p = Plan(g, arm)
            if p.rows().limit(budget + 1).count() > budget:
                raise QueryError(f"the patterns match more than {budget} rows; name a label, a property or a relationship type")
    return plan(g, query).rows
