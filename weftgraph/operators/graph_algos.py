"""Graph algorithms over whole graphs: degrees, breadth-first reach, paths, components, communities, processes.

Loops run on the driver, a round at a time; each round's frontier is written to the shared folder, so lineage is cut
and lost executors cost a round at most. Sets only grow through anti-joins, so work follows the frontier.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import file_name, is_test_file
from weftgraph.graph import PropertyGraph
from weftgraph.session import written

MOST_DEPTH = 20
CALLABLE = ("function", "method")
#: Rows of a component that one task holds as arrays, 12 bytes each; what is larger runs in rounds or blocks.
TASK_ROWS = 48_000_000


def degrees(g: PropertyGraph) -> DataFrame:
    """(id, in_degree, out_degree, degree): an edge counts once at each end, a self-loop twice; partials combine map-side."""
    ends = g.edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(g.edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def with_degrees(g: PropertyGraph) -> DataFrame:
    d = g.nodes.join(degrees(g), "id", "left")
    return d.fillna(0, ["in_degree", "out_degree", "degree"])


def god_nodes(g: PropertyGraph, limit: int = 10, by_name: bool = True) -> DataFrame:
    """The nodes of most edges, ties by name and id (by id alone for the report); at most 100."""
    order = [F.col("degree").desc(), F.col("name"), F.col("id")] if by_name else [F.col("degree").desc(), F.col("id")]
    return with_degrees(g).select("id", "name", "kind", "file_path", "degree").orderBy(*order).limit(min(limit, 100))


def report_god_nodes(g: PropertyGraph, least_files: int = 5) -> DataFrame:
    """The report's top ten by (degree, id); none for a graph of fewer than ``least_files`` files."""
    files = g.nodes.where("kind = 'file'").limit(least_files).count()
    got = god_nodes(g, 10, by_name=False)
    return got if files >= least_files else got.limit(0)


def digest_hubs(g: PropertyGraph, limit: int = 5) -> DataFrame:
    """Symbols of most incoming edges, files and documents apart; ties by file:name, then id."""
    d = with_degrees(g).where("kind not in ('file', 'doc') and in_degree > 0").withColumn("label", F.concat_ws(":", "file_path", "name"))
    return d.select("id", "label", "in_degree").orderBy(F.col("in_degree").desc(), "label", "id").limit(limit)


def hot_symbols(g: PropertyGraph, least: int = 5, each: int = 3) -> DataFrame:
    """Per file the ``each`` symbols of most incoming edges, from ``least`` edges on."""
    d = with_degrees(g).where((F.col("in_degree") >= least) & ~F.col("kind").isin("file", "doc"))
    w = Window.partitionBy("repo", "file_path").orderBy(F.col("in_degree").desc(), "name", "id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each).select("repo", "file_path", "name", "id", "in_degree", "rank")


def search_hints(g: PropertyGraph) -> DataFrame:
    """(name, definitions, files): what an exact search for a name would be told: how many definitions, in which first three files."""
    n = g.nodes.where("kind not in ('file', 'doc')").where(F.col("name").rlike(r"^[A-Za-z_]\w*$"))
    w = Window.partitionBy("name").orderBy("file_path")
    first = n.select("name", "file_path").distinct().withColumn("r", F.row_number().over(w)).where("r <= 3")
    files = first.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("file_path")), ", ").alias("files"))
    return n.groupBy("name").agg(F.count(F.lit(1)).alias("definitions")).join(files, "name")


def kind_classes(g: PropertyGraph) -> DataFrame:
    """One row: files, docs, endpoints, artifacts and symbols of the graph, and its edges."""
    k = F.col("kind")
    counts = g.nodes.agg(
        F.count_if(k == "file").alias("files"), F.count_if(k == "doc").alias("docs"), F.count_if(k.isin("endpoint", "schema")).alias("contracts"),
        F.count_if(k.isin("database_table", "database_column", "infra_resource")).alias("artifacts"),
        F.count_if(~k.isin("file", "doc", "endpoint", "schema", "database_table", "database_column", "infra_resource")).alias("symbols"),
    )
    return counts.withColumn("edges", g.edges.agg(F.count(F.lit(1)).alias("n")).scalar())


def confidence_histogram(g: PropertyGraph) -> DataFrame:
    return g.edges.groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("edges"))


def one_hop(g: PropertyGraph, direction: str, ids: DataFrame) -> DataFrame:
    """(id, kind, confidence, other, other_kind, other_name, other_file): callers (in), callees (out) or both of the ids."""
    sides = []
    if direction in ("in", "both"):
        sides.append(g.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "kind", "confidence", F.lit("in").alias("direction")))
    if direction in ("out", "both"):
        sides.append(g.edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "kind", "confidence", F.lit("out").alias("direction")))
    e = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    other = g.nodes.select(F.col("id").alias("other"), F.col("kind").alias("other_kind"), F.col("name").alias("other_name"), F.col("file_path").alias("other_file"))
    return e.join(ids.select("id").distinct(), "id", "left_semi").join(other, "other").select("id", "direction", "kind", "confidence", "other", "other_kind", "other_name", "other_file")


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = MOST_DEPTH) -> DataFrame:
    """(root, id, depth, kind, confidence, via) of everything reached from seeds(root, id) over edges(from_id, to_id, kind, confidence).

    First discovery counts: of a round's edges into a node the one of the least (from_id, kind). Seeds have depth 0. The
    frontier of every round is written; the union of all rounds is the visited set that the next round anti-joins. Joins are
    merged: compressed tables of few MB hold more rows than a driver can broadcast.
    """
    e = written(edges.select("from_id", "to_id", "kind", "confidence"), "steps").hint("merge")  # cleaned once, not in every round
    none = F.lit(None)
    frontier = written(
        seeds.select("root", "id").distinct().select("root", "id", F.lit(0).alias("depth"), none.cast("string").alias("kind"), none.cast("string").alias("confidence"), none.cast("bigint").alias("via")), "reach"
    )
    seen, depth = frontier, 0
    while most is None or depth < most:
        depth += 1
        step = frontier.select("root", F.col("id").alias("from_id")).join(e, "from_id")
        first = step.groupBy("root", F.col("to_id").alias("id")).agg(F.min(F.struct("from_id", "kind", "confidence")).alias("f"))
        new = first.join(seen.select("root", "id").hint("merge"), ["root", "id"], "left_anti")
        frontier = written(new.select("root", "id", F.lit(depth).alias("depth"), F.col("f.kind").alias("kind"), F.col("f.confidence").alias("confidence"), F.col("f.from_id").alias("via")), "reach")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def against(g: PropertyGraph) -> DataFrame:
    """Edges from the used to the user."""
    return g.edges.select(F.col("dst").alias("from_id"), F.col("src").alias("to_id"), "kind", "confidence")


def impact(g: PropertyGraph, seeds: DataFrame, most: int = MOST_DEPTH) -> DataFrame:
    """(root, id, depth, edge_kind, confidence, name, kind, file_path): who is touched by a change of seeds(root, id); the seeds apart."""
    r = reach(against(g), seeds, most).where("depth > 0").select("root", "id", "depth", F.col("kind").alias("edge_kind"), "confidence")
    return r.join(g.nodes.select("id", "name", "kind", "file_path"), "id").select("root", "id", "depth", "edge_kind", "confidence", "name", "kind", "file_path")


def impact_summary(g: PropertyGraph, seeds: DataFrame) -> DataFrame:
    return impact(g, seeds).groupBy("root").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("file_path").alias("files"), F.max("depth").alias("depth"))


def dependents(g: PropertyGraph, seeds: DataFrame) -> DataFrame:
    """(root, id) of all transitive dependents, to the fixpoint, without the seeds."""
    return reach(against(g), seeds, None).where("depth > 0").select("root", "id")


def component_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, counts, b, w) of each component from rows (component, a, b, w) sorted by component and a: a without repeats, its rows counted."""
    at, parts = None, []

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, where = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        counts = np.zeros(len(a), np.int64)
        np.add.at(counts, where, np.concatenate([x[1] for x in parts]))
        w = np.concatenate([x[3] for x in parts])
        b = np.concatenate([x[2] for x in parts])
        parts.clear()
        return a, counts, b, w

    for batch in batches:
        c, a, b, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        cuts = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if parts and c[lo] != at:
                yield whole()
            at = c[lo]
            parts.append((*np.unique(a[lo:hi], return_counts=True), b[lo:hi].copy(), w[lo:hi].astype(np.int32)))
    if parts:
        yield whole()


def per_component(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows(component, a, b, w) through ``run``, a component's whole and sorted by a in one task."""
    sorted_ = rows.select("component", "a", "b", F.col("w").cast("int").alias("w")).repartition("component").sortWithinPartitions("component", "a")
    return sorted_.mapInArrow(run, schema)


def _spread(starts: np.ndarray, ends: np.ndarray, seen: np.ndarray, first: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Marks in seen what is reached from first over the rows starts[i]..ends[i] of targets; the nodes newly marked."""
    seen[first] = True
    out, todo = [first], first
    while len(todo):
        n = ends[todo] - starts[todo]
        at = np.repeat(starts[todo] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        to = targets[at]
        todo = np.unique(to[~seen[to]])
        seen[todo] = True
        out.append(todo)
    return np.concatenate(out)


def touched_arrays(a: np.ndarray, counts: np.ndarray, b: np.ndarray, w: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """('whole', core, id), ('covers', root, core) and ('rest', root, id) of one component: rows (from, to, 0) of edges and (id, root, -1) of seeds."""
    edge = w >= 0
    frm, seed_id, seed_root = np.repeat(a, counts), None, b[~edge]
    frm, seed_id = frm[edge], frm[~edge]
    to = b[edge]
    ids = np.unique(np.concatenate([np.unique(frm), np.unique(to), np.unique(seed_id)]))
    n = len(ids)
    frm, to = np.searchsorted(ids, frm).astype(np.int32), np.searchsorted(ids, to).astype(np.int32)
    ins, outs = np.bincount(frm, minlength=n), np.bincount(to, minlength=n)
    ends = np.cumsum(ins)
    starts = ends - ins
    core = int(np.argmax(ins * outs))
    inside, below = np.zeros(n, bool), np.zeros(n, bool)
    _spread(starts, ends, inside, np.array([core]), to)
    order = np.argsort(to, kind="stable")
    ends2 = np.cumsum(outs)
    _spread(ends2 - outs, ends2, below, np.array([core]), frm[order])
    del order
    yield "whole", np.full(int(inside.sum()), ids[core]), ids[inside]
    seed_at = np.searchsorted(ids, seed_id)
    by = np.argsort(seed_root, kind="stable")
    roots, first = np.unique(seed_root[by], return_index=True)
    covers = []
    seen = {True: inside.copy(), False: np.zeros(n, bool)}  # a covered root meets the whole as seen
    for root, own in zip(roots, np.split(seed_at[by], first[1:])):
        covered = bool(below[own].any())
        if covered:
            covers.append(root)
        got = _spread(starts, ends, seen[covered], np.unique(own[~inside[own]] if covered else own), to)
        seen[covered][got] = False
        yield "rest", np.full(len(got), root), ids[got]
    yield "covers", np.array(covers, np.int64), np.full(len(covers), ids[core])


def touched(g: PropertyGraph, seeds: DataFrame, most_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rest, covers, whole): all transitive dependents of seeds(root, id), to the fixpoint, without a row for every pair.

    The core of a component is the node of most incoming times outgoing edges. whole(core, id) are the core and its
    dependents; a root that reaches the core reaches them all and has one row in covers(root, core). rest(root, id) is
    what else it reaches, its seeds among it. No pair is in both, so roots times a strongly connected part are counted,
    not made. Components of up to ``most_rows`` edges and seeds are one task each, larger ones go in rounds.
    """
    e = written(g.edges.where("src <> dst").select(F.col("dst").alias("from_id"), F.col("src").alias("to_id")).distinct(), "steps")
    s = written(seeds.select("root", "id").distinct(), "seeds")
    ids = e.select(F.col("from_id").alias("id")).unionByName(e.select(F.col("to_id").alias("id"))).unionByName(s.select("id")).distinct()
    comp = written(components(PropertyGraph(ids, e.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")))), "comp")
    of = comp.withColumnRenamed("id", "a").hint("merge")
    rows = e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit(0).alias("w")).unionByName(s.select(F.col("id").alias("a"), F.col("root").alias("b"), F.lit(-1).alias("w")))
    rows = written(rows.join(of, "a").select("component", "a", "b", "w"), "rows")
    size = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("least"))
    asked = written(size.where("least < 0").select("component", "n"), "asked")  # nobody asks for the others
    small = rows.join(asked.where(F.col("n") <= most_rows).select("component"), "component", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in component_arrays(batches):
            for what, x, y in touched_arrays(*arrays):
                for lo in range(0, len(x), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([what] * len(x[part])), pa.array(x[part], pa.int64()), pa.array(y[part], pa.int64())], ["what", "x", "y"])

    got = written(per_component(small, run, "what string, x bigint, y bigint"), "touched", "what")
    part = lambda what, x, y: got.where(F.col("what") == what).select(F.col("x").alias(x), F.col("y").alias(y))
    out = part("rest", "root", "id"), part("covers", "root", "core"), part("whole", "core", "id")
    big = asked.where(F.col("n") > most_rows)
    if big.take(1):
        own = rows.join(big.select("component"), "component", "left_semi")
        rounds = touched_rounds(own.where("w = 0").select("component", F.col("a").alias("from_id"), F.col("b").alias("to_id")), own.where("w < 0").select("component", F.col("b").alias("root"), F.col("a").alias("id")))
        out = tuple(x.unionByName(y) for x, y in zip(out, rounds))
    return out


def touched_rounds(e: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``touched`` of steps e(component, from_id, to_id) and seeds s(component, root, id) that no task can hold, a round at a time."""
    ends = e.select("component", F.col("from_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select("component", F.col("to_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    ends = written(ends.unionByName(s.select("component", "id", F.lit(0).alias("i"), F.lit(0).alias("o"))).groupBy("component", "id").agg((F.sum("i") * F.sum("o")).alias("n")), "ends")
    core = ends.groupBy("component").agg(F.max_by("id", F.struct("n", (-F.col("id")).alias("least"))).alias("core"))
    comp = written(ends.join(core, "component").select("id", "core"), "comp")
    e, s = e.drop("component"), s.drop("component")
    # the cores' dependents (up) and what the cores depend on, in the same rounds
    both = e.select(F.lit(True).alias("up"), "from_id", "to_id").unionByName(e.select(F.lit(False).alias("up"), F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    cores = comp.select("core").distinct()
    seen = frontier = written(cores.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("up"), "core", F.col("core").alias("id")), "cores")
    while frontier.take(1):
        step = frontier.withColumnRenamed("id", "from_id").join(both.hint("merge"), ["up", "from_id"]).select("up", "core", F.col("to_id").alias("id")).distinct()
        frontier = written(step.join(seen.select("up", "id").hint("merge"), ["up", "id"], "left_anti").select("up", "core", "id"), "cores")
        seen = seen.unionByName(frontier)
    whole = written(seen.where("up").select("core", "id"), "whole")
    covers = written(s.join(seen.where("not up").select("core", "id").hint("merge"), "id").select("root", "core").distinct(), "covers")
    inside = whole.select("id", F.lit(True).alias("inside"))
    # within its component a root covers, only what lies outside the whole is new
    at = s.join(comp.hint("merge"), "id", "left").join(covers.withColumn("covered", F.lit(True)).hint("merge"), ["root", "core"], "left").join(inside.hint("merge"), "id", "left")
    at = at.select("root", "id", F.coalesce("covered", F.lit(False)).alias("covered"), F.coalesce("inside", F.lit(False)).alias("inside"))
    e = written(e.join(inside.withColumnRenamed("id", "to_id").hint("merge"), "to_id", "left").select("from_id", "to_id", F.coalesce("inside", F.lit(False)).alias("inside")), "steps")
    rest = frontier = written(at.where("not (covered and inside)").select("root", "id", "covered"), "rest")
    while frontier.take(1):
        step = frontier.withColumnRenamed("id", "from_id").join(e.hint("merge"), "from_id").where("not (covered and inside)").select("root", F.col("to_id").alias("id"), "covered").distinct()
        frontier = written(step.join(rest.select("root", "id").hint("merge"), ["root", "id"], "left_anti"), "rest")
        rest = rest.unionByName(frontier)
    return rest.select("root", "id"), covers, whole


def touched_counts(seeds: DataFrame, rest: DataFrame, covers: DataFrame, whole: DataFrame) -> DataFrame:
    """(root, n): the dependents of ``touched`` without the seeds, for the roots that have any."""
    size = whole.groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    n = covers.join(size, "core").select("root", "n").unionByName(rest.select("root", F.lit(1).cast("bigint").alias("n")))
    n = n.unionByName(seeds.select("root", "id").distinct().select("root", F.lit(-1).cast("bigint").alias("n")))
    return n.groupBy("root").agg(F.sum("n").alias("n")).where("n > 0")


def affected_tests(g: PropertyGraph, changed: DataFrame) -> DataFrame:
    """(root, file_path): test files that depend on changed(root, repo, file_path), directly or not, at most 20 deep; the changed files apart."""
    seeds = g.nodes.join(changed.select("root", "repo", "file_path"), ["repo", "file_path"]).select("root", "id")
    r = reach(against(g), seeds).select("root", "id")
    # a caller's file counts even where the caller was reached before
    callers = r.join(against(g), F.col("id") == F.col("from_id")).select("root", F.col("to_id").alias("id")).distinct()
    files = callers.join(g.nodes, "id").where(is_test_file(F.col("file_path"))).select("root", "repo", "file_path").distinct()
    return files.join(changed.select("root", "repo", "file_path"), ["root", "repo", "file_path"], "left_anti").select("root", "repo", "file_path")


def changed_files(diffs: DataFrame) -> DataFrame:
    """(root, file_path) from diffs(root, text): the paths of the +++ lines, without b/ and without /dev/null."""
    line = F.explode(F.split("text", r"\r?\n")).alias("line")
    path = F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]+?)\s*$", 1)
    return diffs.select("root", line).select("root", path.alias("file_path")).where("file_path <> '' and file_path <> '/dev/null'").distinct()


def shortest_path(g: PropertyGraph, source: int, target: int, most: int = 64) -> DataFrame:
    """(step, id, name, kind, file_path) of a shortest undirected path; among several the one whose ids, from the target back, are least.

    No rows if there is none. Rounds stop when the target is seen.
    """
    spark = g.spark
    e = g.edges.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id")).unionByName(g.edges.select("dst", "src").toDF("from_id", "to_id"))
    e = written(e.join(g.nodes.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id"), "steps")
    frontier = spark.createDataFrame([(source, None, 0)], "id bigint, via bigint, depth int")
    frontier = written(frontier.join(g.nodes.select("id"), "id", "left_semi"), "path")
    seen, rounds = frontier, [frontier]
    found = source == target
    while not found and len(rounds) <= most:
        new = frontier.select(F.col("id").alias("from_id")).join(e, "from_id").groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("via"))
        frontier = written(new.join(seen.select("id"), "id", "left_anti").select("id", "via", F.lit(len(rounds)).alias("depth")), "path")
        if not frontier.take(1):
            break
        rounds.append(frontier)
        seen = seen.unionByName(frontier)
        found = bool(frontier.where(F.col("id") == target).take(1))
    steps, at = [], target if found else None
    for df in reversed(rounds):  # one row a round
        if at is None:
            break
        row = df.where(F.col("id") == at).first()
        if row is None:
            continue
        steps.append((row["depth"], row["id"]))
        at = row["via"]
    path = spark.createDataFrame(steps, "step int, id bigint")
    return path.join(g.nodes.select("id", "name", "kind", "file_path"), "id").select("step", "id", "name", "kind", "file_path").orderBy("step")


def components(g: PropertyGraph, most_rounds: int = 60) -> DataFrame:
    """(id, component): connected components by alternating large-star and small-star steps on the least neighbour.

    Both steps are group-bys with minima; a hub's neighbours never meet in one list. The number of rounds grows with the
    logarithm of the diameter. Nodes without edges are their own component.
    """
    e = written(g.edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    last: tuple | None = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first())
        if now == last:
            break
        last = now
    label = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return g.nodes.select("id").join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def label_propagation(g: PropertyGraph, rounds: int = 12) -> DataFrame:
    """(id, community): synchronous label propagation; all nodes take the most frequent label around them, the least among equals.

    Parallel edges vote separately, in both directions. Votes are partial counts per (node, label), so a hub is no task
    of its own. Two-cycles are damped by keeping a node's label where it is among the winners.
    """
    e = written(
        g.edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(g.edges.where("src <> dst").select("dst", "src").toDF("a", "b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")), "lpa"
    )
    labels = written(g.nodes.select("id", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        votes = e.join(labels.select(F.col("id").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("id"), "label").agg(F.sum("w").alias("n"))
        top = votes.groupBy("id").agg(F.max(F.struct(F.col("n"), (-F.col("label")).alias("minus"))).alias("t"), F.max("n").alias("most"))
        own = votes.join(labels.withColumnRenamed("label", "mine").hint("merge"), "id").where("label = mine").select("id", F.col("n").alias("own"))
        new = labels.join(top.hint("merge"), "id", "left").join(own.hint("merge"), "id", "left").select("id", "label", F.when(F.col("t").isNull() | (F.col("own") == F.col("most")), F.col("label")).otherwise(-F.col("t.minus")).alias("new"))
        new = written(new, "labels")
        moved = new.where("label <> new").take(1)
        labels = new.select("id", F.col("new").alias("label"))
        if not moved:
            break
    return labels.select("id", F.col("label").alias("community"))


def sequential_labels(ids: list[int], edges: list[tuple[int, int]], rounds: int = 12) -> dict[int, int]:
    """In-place label propagation in the order of ids: each node takes the most frequent label around it, the least among equals."""
    around: dict[int, list[int]] = {i: [] for i in ids}
    for a, b in edges:
        if a != b and a in around and b in around:
            around[a].append(b)
            around[b].append(a)
    label = {i: i for i in ids}
    for _ in range(rounds):
        moved = False
        for i in sorted(ids):
            votes: dict[int, int] = {}
            for j in around[i]:
                votes[label[j]] = votes.get(label[j], 0) + 1
            if votes:
                best = min(votes, key=lambda x: (-votes[x], x))
                if best != label[i]:
                    label[i], moved = best, True
        if not moved:
            break
    return label


def block_labels(ids: list[int], labels: dict[int, int], inside: list[tuple[int, int, int]], outside: list[tuple[int, int, int]]) -> dict[int, int]:
    """One round of ``sequential_labels`` over a block of ids: inside(a, b, edges) change as it goes, outside(a, label, votes) stand still."""
    around: dict[int, list[tuple[int, int]]] = {i: [] for i in ids}
    still: dict[int, list[tuple[int, int]]] = {i: [] for i in ids}
    for a, b, n in inside:
        around[a].append((b, n))
    for a, label, n in outside:
        still[a].append((label, n))
    new = dict(labels)
    for i in sorted(ids):
        votes: dict[int, int] = {}
        for label, n in still[i]:
            votes[label] = votes.get(label, 0) + n
        for b, n in around[i]:
            votes[new[b]] = votes.get(new[b], 0) + n
        if votes:
            new[i] = min(votes, key=lambda x: (-votes[x], x))
    return new


def array_labels(ends: np.ndarray, other: np.ndarray, weight: np.ndarray, rounds: int = 12) -> np.ndarray:
    """The labels of ``sequential_labels``, as positions: node i has the neighbours other[ends[i - 1]:ends[i]], of so many edges each.

    Nodes are settled a stretch at a time. Neighbours before it are settled, those behind it are as they were, so only
    neighbours inside the stretch depend on its order: first all its nodes vote as if none moved, then, in order, those
    vote again that a moved node stands before.
    """
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    label = np.arange(n, dtype=np.int64)
    most = max(64, n // 256)
    lows = [0]
    while lows[-1] < n:  # about 2^20 rows, but one node at least
        lows.append(max(lows[-1] + 1, min(lows[-1] + most, int(np.searchsorted(ends, starts[lows[-1]] + (1 << 20))), n)))

    def votes(nodes: np.ndarray, labels: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per node (sorted, repeated a row) the label of most votes, the least among equals."""
        key = nodes * n + labels
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total, key = np.add.reduceat(w[order].astype(np.int64), first), key[first]
        node = key // n
        begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        best = np.maximum.reduceat(total, begin)
        top = np.flatnonzero(total == np.repeat(best, np.diff(np.append(begin, len(node)))))
        _, at = np.unique(node[top], return_index=True)
        return node[begin], key[top[at]] % n

    for _ in range(rounds):
        moved = False
        for lo, hi in zip(lows, lows[1:]):
            rows = slice(int(starts[lo]), int(ends[hi - 1]))
            if rows.start == rows.stop:
                continue
            b = other[rows]
            nodes = np.repeat(np.arange(hi - lo), ends[lo:hi] - starts[lo:hi])
            who, new = votes(nodes, label[b], weight[rows])
            now = label[lo:hi].copy()
            now[who] = new
            after = np.flatnonzero((b >= lo) & (b < lo + nodes))  # rows whose other end is settled before, in this stretch
            if len(after):
                follow: dict[int, list[int]] = {}
                for x, y in zip((b[after] - lo).tolist(), nodes[after].tolist()):
                    follow.setdefault(x, []).append(y)
                again = list({y for x in follow if now[x] != label[lo + x] for y in follow[x]})
                heapq.heapify(again)
                queued = set(again)
                while again:
                    i = heapq.heappop(again)
                    own = slice(int(starts[lo + i]), int(ends[lo + i]))
                    c = other[own]
                    l = label[c]
                    before = (c >= lo) & (c < lo + i)
                    l[before] = now[c[before] - lo]
                    best = int(votes(np.zeros(len(c), np.int64), l, weight[own])[1][0])
                    if best != now[i]:
                        now[i] = best
                        for y in follow.get(i, ()):
                            if y not in queued:
                                queued.add(y)
                                heapq.heappush(again, y)
            moved = moved or bool((now != label[lo:hi]).any())
            label[lo:hi] = now
        if not moved:
            break
    return label


def task_labels(large: DataFrame, edges: DataFrame, rounds: int = 12) -> DataFrame:
    """(id, community) of large(id, component) by ``array_labels``, a component a task; nodes without an edge to another are left out."""
    one = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    rows = both.join(large.select(F.col("id").alias("a"), "component").hint("merge"), "a").join(large.select(F.col("id").alias("b")).hint("merge"), "b", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, counts, b, w in component_arrays(batches):
            b = np.searchsorted(ids, b).astype(np.int32)
            got = ids[array_labels(np.cumsum(counts), b, w, rounds)]
            for lo in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)], pa.int64()) for x in (ids, got)], ["id", "community"])

    return per_component(rows, run, "id bigint, community bigint")


def ordered_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 12, block_rows: int = 1_000_000) -> DataFrame:
    """(id, community): the labels of ``sequential_labels`` for graphs that no task can hold.

    nodes(id) are cut into ranges of ids with about ``block_rows`` neighbours each. In a round the blocks are settled one
    after another, each by one task in the order of ids; the votes of nodes outside the block, settled in this round if
    their ids are less and in the last one if they are greater, are summed up before. So the labels don't depend on the
    cut, and a task gets a block's inner edges and one row per (node, outer label).
    """
    ends = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for end in ("a", "b"):
        both = both.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    e = written(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")), "order")
    blocks = max(1, -(-e.count() // block_rows))
    # one row a block comes to the driver: its least id
    lows = sorted(r[0] for r in e.repartitionByRange(blocks, "a").groupBy(F.spark_partition_id()).agg(F.min("a")).collect())
    if not lows:
        return nodes.select("id", F.col("id").alias("community"))
    highs: list[int | None] = [*lows[1:], None]
    within = lambda c, k: (F.col(c) >= lows[k]) if highs[k] is None else (F.col(c) >= lows[k]) & (F.col(c) < highs[k])
    first = written(nodes.select("id", F.col("id").alias("label"), F.lit(False).alias("moved")), "labels")
    files: dict[int, list[str]] = {}

    def now() -> DataFrame:
        if not files:
            return first
        settled = nodes.sparkSession.read.schema(first.schema).parquet(*(f for own in files.values() for f in own))
        return settled if len(files) == len(lows) else settled.unionByName(first.where(F.col("id") >= lows[len(files)]))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {k: list(part[["a", "x", "n"]].itertuples(index=False, name=None)) for k, part in pdf.groupby("what")}
        old = {a: x for a, x, _ in rows["label"]}
        new = block_labels(list(old), old, rows.get("inside", []), rows.get("outside", []))
        return pd.DataFrame({"id": list(new), "label": list(new.values()), "moved": [new[i] != old[i] for i in new]})

    for _ in range(rounds):
        moved = False
        for k in range(len(lows)):
            labels, own = now(), e.where(within("a", k))
            outside = own.where(~within("b", k)).join(labels.where(~within("id", k)).select(F.col("id").alias("b"), "label"), "b").groupBy("a", F.col("label").alias("x")).agg(F.sum("w").alias("n"))
            rows = labels.where(within("id", k)).select(F.lit("label").alias("what"), F.col("id").alias("a"), F.col("label").alias("x"), F.lit(0).cast("bigint").alias("n"))
            rows = rows.unionByName(own.where(within("b", k)).select(F.lit("inside").alias("what"), "a", F.col("b").alias("x"), F.col("w").alias("n"))).unionByName(outside.select(F.lit("outside").alias("what"), "a", "x", "n"))
            new = written(rows.groupBy().applyInPandas(settle, first.schema), "labels")
            files[k] = new.inputFiles()
            moved = bool(new.where("moved").take(1)) or moved
        if not moved:
            break
    out = now().select("id", F.col("label").alias("community"))
    return out.unionByName(nodes.select("id", F.col("id").alias("community")).join(out.select("id"), "id", "left_anti"))


def communities(g: PropertyGraph, most_nodes: int = 20_000, rounds: int = 12, block_rows: int = 1_000_000, most_rows: int = TASK_ROWS) -> DataFrame:
    """(id, community) of the communities with more than one member.

    Labels spread one node after another in the order of ids, in components of every size. No label leaves its
    component, so components of up to ``most_nodes`` nodes, a bound on what one task gets as objects, run apart, larger ones
    of up to ``most_rows`` neighbours as arrays (``task_labels``), and what is larger still in blocks of about
    ``block_rows`` neighbours (``ordered_labels``). No bound changes a label.
    """
    comp = written(components(g), "comp")
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = comp.join(size.where(F.col("n") <= most_nodes), "component").where("n > 1")
    large = comp.join(size.where(F.col("n") > most_nodes), "component").select("id", "component")
    inner = g.edges.select("src", "dst").join(small.select(F.col("id").alias("src"), "component"), "src").select("component", "src", "dst")
    rows = small.select("component", F.col("id").alias("src"), F.lit(None).cast("bigint").alias("dst")).unionByName(inner)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["dst"].isna()
        ids = pdf.loc[own, "src"].astype("int64").tolist()
        e = pdf.loc[~own]
        got = sequential_labels(ids, list(zip(e["src"].astype("int64").tolist(), e["dst"].astype("int64").tolist())), rounds)
        return pd.DataFrame({"id": list(got), "community": list(got.values())})

    exact = rows.groupBy("component").applyInPandas(run, "id bigint, community bigint")
    if large.take(1):
        large = written(large, "large")
        rows = g.edges.where("src <> dst").select(F.col("src").alias("id")).join(large.hint("merge"), "id").groupBy("component").agg((F.count(F.lit(1)) * 2).alias("rows"))
        blocks = written(rows.where(F.col("rows") > most_rows).select("component"), "blocks")
        exact = exact.unionByName(task_labels(large.join(blocks, "component", "left_anti"), g.edges, rounds))
        if blocks.take(1):
            exact = exact.unionByName(ordered_labels(large.join(blocks, "component", "left_semi").select("id"), g.edges, rounds, block_rows))
    members = exact.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("community")
    return exact.join(members, "community").select("id", "community")


def entrypoints(g: PropertyGraph) -> DataFrame:
    """(id): functions named main or Main, and sources of an implements edge to an endpoint."""
    mains = g.nodes.where("kind = 'function' and name in ('main', 'Main')").select("id")
    ends = g.nodes.where("kind = 'endpoint'").select(F.col("id").alias("dst"))
    handlers = g.edges.where("kind = 'implements'").join(ends, "dst", "left_semi").select(F.col("src").alias("id"))
    return mains.unionByName(handlers.join(g.nodes.select("id"), "id", "left_semi")).distinct()


def process_roots(g: PropertyGraph) -> DataFrame:
    """Callable entrypoints; in a graph without any, callables that nothing calls."""
    calls = g.nodes.where(F.col("kind").isin(*CALLABLE)).select("id")
    roots = entrypoints(g).join(calls, "id", "left_semi")
    if roots.take(1):
        return roots
    return calls.join(g.edges.where("kind = 'calls'").select(F.col("dst").alias("id")), "id", "left_anti")


def processes(g: PropertyGraph, roots: DataFrame | None = None, most_steps: int = 100) -> DataFrame:
    """(root, step, id): breadth-first walks over calls between callables, neighbours by id, ``most_steps`` steps; walks of one step are left out.

    The position of a node in its walk is exact: within a round by the position of its first caller, then by id.
    """
    calls = g.nodes.where(F.col("kind").isin(*CALLABLE)).select("id")
    e = g.edges.where("kind = 'calls'").select(F.col("src").alias("from_id"), F.col("dst").alias("id")).join(calls, "id", "left_semi")
    e = written(e.join(calls.select(F.col("id").alias("from_id")), "from_id", "left_semi").select("from_id", "id"), "calls")
    frontier = written((process_roots(g) if roots is None else roots).select(F.col("id").alias("root"), "id", F.lit(1).cast("bigint").alias("step")), "walk")
    seen = frontier
    while True:
        new = frontier.select("root", F.col("id").alias("from_id"), F.col("step").alias("caller")).join(e, "from_id").groupBy("root", "id").agg(F.min("caller").alias("caller"))
        new = new.join(seen.select("root", "id"), ["root", "id"], "left_anti")
        base = seen.groupBy("root").agg(F.max("step").alias("base"))
        w = Window.partitionBy("root").orderBy("caller", "id")  # a root's frontier: at most most_steps times a node's callees
        placed = new.join(base, "root").withColumn("step", F.col("base") + F.row_number().over(w)).where(F.col("step") <= most_steps)
        frontier = written(placed.select("root", "id", "step"), "walk")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    longer = seen.groupBy("root").agg(F.max("step").alias("n")).where("n > 1").select("root")
    return seen.join(longer, "root").select("root", "step", "id")


def listing(groups: DataFrame, g: PropertyGraph, needle: str = "") -> DataFrame:
    """(community, size, names): communities with a member whose name holds the text, largest first, their first ten names by id."""
    named = groups.join(g.nodes.select("id", "name"), "id")
    w = Window.partitionBy("community").orderBy("id")
    hit = named.where(F.col("name").contains(needle)).select("community").distinct()
    ten = named.withColumn("r", F.row_number().over(w)).where("r <= 10")
    names = ten.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda s: s["name"]), ", ").alias("names"))
    return named.groupBy("community").agg(F.count(F.lit(1)).alias("size")).join(hit, "community").join(names, "community").select("community", "size", "names")


def graph_stats(g: PropertyGraph, groups: DataFrame, walks: DataFrame) -> DataFrame:
    """(measure, value): nodes, edges, communities, processes and edges by confidence."""
    one = lambda name, df: df.select(F.lit(name).alias("measure"), F.col("n").alias("value"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    out = one("nodes", count(g.nodes)).unionByName(one("edges", count(g.edges)))
    out = out.unionByName(one("communities", groups.agg(F.count_distinct("community").alias("n")))).unionByName(one("processes", walks.agg(F.count_distinct("root").alias("n"))))
    return out.unionByName(g.edges.groupBy(F.col("confidence").alias("measure")).agg(F.count(F.lit(1)).alias("value")))


def rename_plan(g: PropertyGraph, files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, repo, file_path, occurrences, ambiguous): whole-word occurrences per file that a rename would touch.

    names(name, repo) must each have exactly one definition, others give no rows. Files are the declaring one and those
    of nodes with an edge to it that isn't AMBIGUOUS nor explains. files has (repo, file_path, text).
    """
    from weftgraph.functions.text import whole_word_count

    own = g.nodes.where("kind not in ('file', 'doc')").join(names.select("repo", "name").distinct(), ["repo", "name"])
    one = own.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("file_path").alias("file_path")).where("n = 1")
    users = g.edges.where("confidence <> 'AMBIGUOUS' and kind <> 'explains'").join(one.select(F.col("id").alias("dst"), "repo", "name"), "dst")
    users = users.join(g.nodes.select(F.col("id").alias("src"), F.col("repo").alias("r2"), "file_path"), "src").where("repo = r2").select("repo", "name", "file_path")
    touched = one.select("repo", "name", "file_path").unionByName(users).distinct()
    text = files.where("text is not null").select("repo", "file_path", "text").dropDuplicates(["repo", "file_path"])
    counted = touched.join(text, ["repo", "file_path"]).select("name", "repo", "file_path", whole_word_count(F.col("text"), F.col("name")).cast("bigint").alias("occurrences"))
    return counted.where("occurrences > 0")
