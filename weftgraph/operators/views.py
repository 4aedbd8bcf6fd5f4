"""Derived views: API surfaces, graph diff, drift, pull-request insight, cross-repository links, areas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import endpoint_shape, is_vendored, parent_dir
from weftgraph.graph import PropertyGraph
from weftgraph.operators.graph_algos import degrees, entrypoints, touched, touched_counts
from weftgraph.session import written

HUB_DEGREE = 10
# What marks a line that explains itself.
MARKERS = ("WHY:", "HACK:")


# surfaces


def surfaces(g: PropertyGraph) -> DataFrame:
    """(repo, shape, name, declared, observed, handlers, consumers, state) of endpoints grouped by method and flattened path.

    The declared name wins, then the least. Handlers have an implements edge to it, consumers a calls edge.
    """
    e = g.nodes.where("kind = 'endpoint'").select("id", "repo", "name", endpoint_shape(F.col("name")).alias("shape"), (F.col("perspective") == "declared").alias("is_declared"))
    into = g.edges.where("kind in ('implements', 'calls')").join(e.select(F.col("id").alias("dst"), "repo", "shape"), "dst")
    uses = into.groupBy("repo", "shape").agg(
        F.count_distinct(F.when(F.col("kind") == "implements", F.col("src"))).alias("handlers"), F.count_distinct(F.when(F.col("kind") == "calls", F.col("src"))).alias("consumers")
    )
    s = e.groupBy("repo", "shape").agg(
        F.coalesce(F.min(F.when(F.col("is_declared"), F.col("name"))), F.min("name")).alias("name"), F.max("is_declared").alias("declared"), F.max(~F.col("is_declared")).alias("observed")
    )
    # repo may be null: joined null-safely
    s, uses = s.alias("s"), uses.alias("u")
    got = s.join(uses, F.col("s.repo").eqNullSafe(F.col("u.repo")) & (F.col("s.shape") == F.col("u.shape")), "left")
    got = got.select("s.repo", "s.shape", "name", "declared", "observed", F.coalesce("handlers", F.lit(0)).alias("handlers"), F.coalesce("consumers", F.lit(0)).alias("consumers"))
    d, o, h, c = F.col("declared"), F.col("observed"), F.col("handlers") > 0, F.col("consumers") > 0
    state = F.when(d & (o | h), "matched").when(d, "declared only").when(o & h & ~c, "exposed").when(o & h, "undeclared").otherwise("unknown")
    return got.withColumn("state", state)


def mismatch_summary(s: DataFrame) -> DataFrame:
    return s.groupBy("repo", "state").agg(F.count(F.lit(1)).alias("surfaces"), F.sum("consumers").alias("consumers"))


def surface_map(g: PropertyGraph, tools: bool = False, needle: str = "") -> DataFrame:
    """(repo, name, state, role, symbol, file_path, line, confidence): the route map, or the tool map, of surfaces whose name holds the text.

    One row for each handler and each consumer of a surface, so that none is a list however many use it; a surface without
    any has one row with null from role on.
    """
    s = surfaces(g).where(F.col("name").contains(needle)).where(F.col("shape").startswith("TOOL ") if tools else ~F.col("shape").startswith("TOOL "))
    e = g.nodes.where("kind = 'endpoint'").select(F.col("id").alias("dst"), F.col("repo").alias("_repo"), endpoint_shape(F.col("name")).alias("_shape"))
    who = g.nodes.select(F.col("id").alias("src"), F.col("name").alias("symbol"), "file_path", F.col("start_line").alias("line"))
    role = F.when(F.col("kind") == "implements", "handler").otherwise("consumer").alias("role")
    uses = g.edges.where("kind in ('implements', 'calls')").join(e, "dst").join(who, "src").select("_repo", "_shape", role, "symbol", "file_path", "line", "confidence").distinct()
    got = s.join(uses, F.col("repo").eqNullSafe(F.col("_repo")) & (F.col("shape") == F.col("_shape")), "left")
    return got.select("repo", "name", "state", "role", "symbol", "file_path", "line", "confidence")


def api_impact(g: PropertyGraph) -> DataFrame:
    """(root, dependents): per endpoint with handlers, how many symbols depend on its handlers, to the fixpoint."""
    ends = g.nodes.where("kind = 'endpoint'").select(F.col("id").alias("dst"))
    seeds = g.edges.where("kind = 'implements'").join(ends, "dst", "left_semi").select(F.col("dst").alias("root"), F.col("src").alias("id"))
    seeds = written(seeds.distinct(), "seeds")
    return touched_counts(seeds, *touched(g, seeds)).withColumnRenamed("n", "dependents")


# diff and drift


def qualified(nodes: DataFrame) -> DataFrame:
    """One symbol per (repo, 'kind name'): same-named symbols collapse, the greatest file counts."""
    return nodes.where("name is not null").groupBy("repo", F.concat_ws(" ", "kind", "name").alias("symbol")).agg(F.max("file_path").alias("file_path"))


def compare(before: PropertyGraph, after: PropertyGraph) -> DataFrame:
    """(repo, symbol, change, old_file, new_file): symbols added, removed and moved between two states of a graph."""
    a, b = qualified(before.nodes).alias("a"), qualified(after.nodes).alias("b")
    j = a.join(b, F.col("a.repo").eqNullSafe(F.col("b.repo")) & (F.col("a.symbol") == F.col("b.symbol")), "full")
    change = F.when(F.col("a.symbol").isNull(), "added").when(F.col("b.symbol").isNull(), "removed").when(~F.col("a.file_path").eqNullSafe(F.col("b.file_path")), "moved")
    return j.select(F.coalesce("a.repo", "b.repo").alias("repo"), F.coalesce("a.symbol", "b.symbol").alias("symbol"), change.alias("change"), F.col("a.file_path").alias("old_file"), F.col("b.file_path").alias("new_file")).where("change is not null")


def edge_names(g: PropertyGraph) -> DataFrame:
    n = g.nodes.where("name is not null").select("id", F.concat_ws(" ", "kind", "name").alias("q"))
    e = g.edges.join(n.select(F.col("id").alias("src"), F.col("q").alias("source")), "src").join(n.select(F.col("id").alias("dst"), F.col("q").alias("target")), "dst")
    return e.select("source", "target", "kind").distinct()


def compare_edges(before: PropertyGraph, after: PropertyGraph) -> DataFrame:
    """(source, target, kind, change) of qualified edges that only one state has."""
    a, b = edge_names(before), edge_names(after)
    keys = ["source", "target", "kind"]
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def fan_in_shift(before: PropertyGraph, after: PropertyGraph) -> DataFrame:
    """(symbol, was, now) where the number of incoming edges changed; by size of the change, then now, then name."""

    def fan(g: PropertyGraph, name: str) -> DataFrame:
        n = g.nodes.where("name is not null").select(F.col("id").alias("dst"), F.concat_ws(" ", "kind", "name").alias("symbol"))
        return g.edges.join(n, "dst").groupBy("symbol").agg(F.count(F.lit(1)).alias(name))

    j = fan(before, "was").join(fan(after, "now"), "symbol", "full").fillna(0, ["was", "now"]).where("was <> now")
    return j.orderBy(F.abs(F.col("now") - F.col("was")).desc(), F.col("now").desc(), "symbol")


def drift(declared: DataFrame, live: DataFrame) -> DataFrame:
    """(table, state) of declared(name) and live(name): matched, declared_only, live_only by the bare lower-case name."""
    bare = lambda df, flag: df.where("name is not null").select(F.lower(F.regexp_extract("name", r'([^."`]+)["`]?\s*$', 1)).alias("table")).distinct().withColumn(flag, F.lit(True))
    j = bare(declared, "d").join(bare(live, "l"), "table", "full")
    return j.select("table", F.when(F.col("d") & F.col("l"), "matched").when(F.col("d"), "declared_only").otherwise("live_only").alias("state"))


# pull requests


def rollup(checks: Column) -> Column:
    """The worst of an array of check states: any failure, else the last one that is pending, else success; null for none."""
    bad = F.exists(checks, lambda c: F.upper(c).isin("FAILURE", "ERROR", "CANCELLED", "TIMED_OUT"))
    pending = F.filter(checks, lambda c: F.upper(c).isin("PENDING", "QUEUED", "IN_PROGRESS", "EXPECTED"))
    return F.when(F.size(checks) < 1, F.lit(None).cast("string")).when(bad, "FAILURE").when(F.size(pending) > 0, F.upper(F.element_at(pending, -1))).otherwise("SUCCESS")


def pr_symbols(g: PropertyGraph, prs: DataFrame) -> DataFrame:
    """(repo, number, id) of the symbols in the files of prs(repo, number, files array)."""
    f = prs.select("repo", "number", F.explode(F.array_distinct("files")).alias("file_path"))
    return f.join(g.nodes.where("kind <> 'file'").select("repo", "file_path", "id"), ["repo", "file_path"]).select("repo", "number", "id").distinct()


def pr_insight(g: PropertyGraph, prs: DataFrame) -> DataFrame:
    """(repo, number, symbols, hubs, blast_radius, tests, risk, band) of prs(repo, number, draft, checks array, files array).

    Points: 3 a hub (ten incoming edges or more), one per 25 dependents, 4 where something is touched and no test depends
    on it, 3 for a failing check. Bands: low to 3, medium to 9, high from 10.
    """
    from weftgraph.functions.text import is_test_file

    sym = written(pr_symbols(g, prs).withColumn("root", F.xxhash64("repo", "number")), "symbols")
    hubs = degrees(g).where(F.col("in_degree") >= HUB_DEGREE).select("id")
    n_sym = sym.groupBy("root").agg(F.count(F.lit(1)).alias("symbols"))
    n_hub = sym.join(hubs, "id", "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("hubs"))
    rest, covers, whole = touched(g, sym.select("root", "id"))
    radius = touched_counts(sym, rest, covers, whole).withColumnRenamed("n", "blast_radius")
    # of the pairs only those of tests are made
    files = written(g.nodes.where(is_test_file(F.col("file_path"))).select("id", "file_path"), "tests")
    reached = rest.join(files, "id").unionByName(whole.join(files, "id").join(covers, "core").select("id", "root", "file_path"))
    tests = reached.join(sym.select("root", "id"), ["root", "id"], "left_anti").groupBy("root").agg(F.count_distinct("file_path").alias("tests"))
    p = prs.select("repo", "number", "draft", rollup(F.col("checks")).alias("check_state")).withColumn("root", F.xxhash64("repo", "number"))
    for part in (n_sym, n_hub, radius, tests):
        p = p.join(part, "root", "left")
    p = p.fillna(0, ["symbols", "hubs", "blast_radius", "tests"])
    risk = F.col("hubs") * 3 + F.floor(F.col("blast_radius") / 25) + F.when((F.col("symbols") > 0) & (F.col("tests") == 0), 4).otherwise(0) + F.when(F.col("check_state") == "FAILURE", 3).otherwise(0)
    return p.withColumn("risk", risk.cast("bigint")).withColumn("band", F.when(F.col("risk") >= 10, "high").when(F.col("risk") >= 4, "medium").otherwise("low")).drop("root")


def review_queue(insight: DataFrame) -> DataFrame:
    """Ready before draft, riskiest first, then by number."""
    return insight.orderBy(F.col("draft").asc_nulls_first(), F.col("risk").desc(), "number", "repo")


def overlaps(insights: DataFrame, asked: DataFrame) -> DataFrame:
    """(repo, left, right, shared_hubs, shared_communities, severity): for each asked(repo, number) the requests of its repository that touch the same hubs or communities.

    insights(repo, number, hubs array, communities array), one row a pull request. The asked requests, those open for
    review, are a stated set against all rows; partners are found through the shared keys. Symbols shared are semantic,
    communities alone adjacent.
    """
    out = []
    for col, name in (("hubs", "hub"), ("communities", "community")):
        a = insights.select("repo", "number", F.explode(F.array_distinct(col)).alias(name)).where(F.col(name).isNotNull())
        left = a.join(asked.select("repo", "number").distinct(), ["repo", "number"], "left_semi").withColumnRenamed("number", "left")
        out.append(left.join(a.withColumnRenamed("number", "right"), ["repo", name]).where("left <> right").groupBy("repo", "left", "right").agg(F.count(F.lit(1)).alias(f"shared_{col}")))
    j = out[0].join(out[1], ["repo", "left", "right"], "full").fillna(0, ["shared_hubs", "shared_communities"])
    return j.withColumn("severity", F.when(F.col("shared_hubs") > 0, "semantic").otherwise("adjacent"))


def latest_insights(raw: DataFrame) -> DataFrame:
    """One row per (repo, number): the last computation; equal times keep the greater risk, then the greater title."""
    w = Window.partitionBy("repo", "number").orderBy(F.col("computed_at").desc_nulls_last(), F.col("risk").desc_nulls_last(), F.col("blast_radius").desc_nulls_last(), F.col("title").desc_nulls_last())
    return raw.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def overlap_counts(raw: DataFrame) -> DataFrame:
    """(repo, hub, pull_requests, pairs): how many pairs of pull requests meet at each hub, by counting, without making a pair."""
    h = latest_insights(raw).select("repo", "number", F.explode(F.array_distinct("hubs")).alias("hub")).where("hub is not null")
    n = h.groupBy("repo", "hub").agg(F.count(F.lit(1)).alias("pull_requests"))
    return n.withColumn("pairs", (F.col("pull_requests") * (F.col("pull_requests") - 1) / 2).cast("bigint"))


def triage(raw: DataFrame) -> DataFrame:
    """(repo, low, medium, high, mean_risk, worst): the risk bands of a repository's pull requests."""
    r = F.col("risk")
    return latest_insights(raw).where("risk is not null").groupBy("repo").agg(
        F.count_if(r < 4).alias("low"), F.count_if((r >= 4) & (r < 10)).alias("medium"), F.count_if(r >= 10).alias("high"), F.round(F.avg(r), 6).alias("mean_risk"), F.max(r).alias("worst")
    )


# federation


def links_by_name(g: PropertyGraph) -> DataFrame:
    """(kind, consumer, producer, links): endpoints, schemas, tables and documents that repositories name alike, per pair of repositories.

    The producer declares the name, the consumer only observes it. Names are grouped first; a pair is a count, so hot names cost one row per repository.
    """
    n = g.nodes.where("kind in ('endpoint', 'schema', 'database_table', 'component') and name is not null and repo is not null")
    name = F.when(F.col("kind") == "endpoint", endpoint_shape(F.col("name"))).otherwise(F.col("name"))
    per = n.select("repo", "kind", name.alias("key"), (F.col("perspective") == "declared").alias("declared")).groupBy("kind", "key", "repo").agg(F.max("declared").alias("declared"))
    p = per.where("declared").select("kind", "key", F.col("repo").alias("producer"))
    c = per.where("not declared").select("kind", "key", F.col("repo").alias("consumer"))
    return c.join(p, ["kind", "key"]).where("consumer <> producer").groupBy("kind", "consumer", "producer").agg(F.count(F.lit(1)).alias("links"))


def members(groups: DataFrame, name: str) -> DataFrame:
    """(repo) of a group and of all groups below it; groups(name, repo), a slash parts the levels."""
    return groups.where((F.col("name") == name) | F.startswith(F.col("name"), F.lit(name + "/"))).select("repo").distinct()


def workspace_status(summaries: DataFrame) -> DataFrame:
    """(repo, passes, indexed_at, files, nodes, edges): the registry as its last pass left it."""
    last = F.max_by(F.struct("indexed_at", "files", "nodes", "edges"), F.struct("indexed_at", "pass_id")).alias("l")
    return summaries.groupBy("repo").agg(F.count(F.lit(1)).alias("passes"), last).select("repo", "passes", "l.indexed_at", "l.files", "l.nodes", "l.edges")


def distribution(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, low, p50, p95, high, mean) of a column: nearest-rank percentiles per key, with windows instead of collected lists; null values don't count."""
    w, n = Window.partitionBy(key).orderBy(value), Window.partitionBy(key)
    r = rows.where(F.col(value).isNotNull()).select(key, value, (F.row_number().over(w) - 1).alias("_k"), (F.count(F.lit(1)).over(n) - 1).alias("_last"))
    at = lambda q: F.max(F.when(F.col("_k") == F.ceil(F.col("_last") * q / 100), F.col(value)))
    return r.groupBy(key).agg(F.min(value).alias("low"), at(50).alias("p50"), at(95).alias("p95"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"))


def why_hack(files: DataFrame) -> DataFrame:
    """(repo, file_path, line, text): lines that hold one of MARKERS, trimmed, in order."""
    lines = files.where("text is not null").dropDuplicates(["file_id"]).select("repo", "file_path", F.posexplode(F.split("text", r"\r?\n")).alias("k", "text"))
    return lines.where(F.col("text").contains(MARKERS[0]) | F.col("text").contains(MARKERS[1])).select("repo", "file_path", (F.col("k") + 1).alias("line"), F.trim("text").alias("text"))


# communities and areas


def community_summary(g: PropertyGraph, groups: DataFrame) -> DataFrame:
    """(community, size, internal, external, entrypoints, worst, representatives): representatives are five names by (degree, id)."""
    a = groups.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = groups.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = g.edges.join(a, "src").join(b, "dst")
    level = F.when(F.col("confidence") == "EXTRACTED", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    inner = e.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("internal"), F.max(level).alias("w"))
    outer = e.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("community")).groupBy("community").agg(F.count(F.lit(1)).alias("external"))
    entry = entrypoints(g).join(groups, "id").groupBy("community").agg(F.count(F.lit(1)).alias("entrypoints"))
    d = groups.join(degrees(g).select("id", "degree"), "id", "left").fillna(0, ["degree"]).join(g.nodes.select("id", "name"), "id")
    w = Window.partitionBy("community").orderBy(F.col("degree").desc(), "id")
    top = d.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda s: s["name"]), ", ").alias("representatives"))
    s = groups.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    s = reduce(lambda x, y: x.join(y, "community", "left"), [s, inner, outer, entry, top]).fillna(0, ["internal", "external", "entrypoints"])
    return s.select("community", "size", "internal", "external", "entrypoints", F.when(F.col("w") == 0, "EXTRACTED").when(F.col("w") == 1, "INFERRED").when(F.col("w") == 2, "AMBIGUOUS").alias("worst"), "representatives")


def bundles(g: PropertyGraph, groups: DataFrame) -> DataFrame:
    """(low, high, kind, extracted, inferred, ambiguous): edges between communities, by unordered pair and kind."""
    e = g.edges.join(groups.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(groups.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst").where("a <> b")
    return e.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "kind").agg(*(F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")))


def fold_tiny(g: PropertyGraph, groups: DataFrame, least: int = 3) -> DataFrame:
    """(id, community): members of communities under ``least`` move to the dominant community of their file where that one is large enough; renumbered from 0 by (size desc, id)."""
    size = groups.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    m = groups.join(size, "community").join(g.nodes.select("id", "repo", "file_path"), "id")
    per_file = m.groupBy("repo", "file_path", "community").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("here"))
    w = Window.partitionBy("repo", "file_path").orderBy(F.col("n").desc(), "community")
    dominant = per_file.withColumn("r", F.row_number().over(w)).where("r = 1").select("repo", "file_path", F.col("community").alias("dom"), F.col("n").alias("dom_n"))
    j = m.alias("m").join(dominant.alias("d"), F.col("m.repo").eqNullSafe(F.col("d.repo")) & F.col("m.file_path").eqNullSafe(F.col("d.file_path")))
    moved = j.select("id", F.when((F.col("n") < least) & (F.col("dom_n") >= least), F.col("dom")).otherwise(F.col("community")).alias("community"))
    sizes = moved.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return moved.join(numbered(sizes, F.col("n").desc(), F.col("community").asc()).select("community", "number"), "community").select("id", F.col("number").alias("community"))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``number``, from 0 in the order given, without one task that sees them all.

    Ranges of the order are sorted apart; a row's number is its place in its range plus the rows of the ranges before.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(ranges, "_part").withColumn("number", F.col("_base") + F.col("_at")).drop("_id", "_part", "_at", "_base")


def area_names(g: PropertyGraph, groups: DataFrame) -> DataFrame:
    """(community, area): the deepest directory that covers at least half of the members, else the file of the first; vendored files apart."""
    m = groups.join(g.nodes.where(~is_vendored(F.coalesce(F.col("file_path"), F.lit("")))).select("id", "file_path"), "id").where("file_path is not null")
    size = m.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min_by("file_path", "id").alias("first"))
    parts = F.split(parent_dir(F.col("file_path")), "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    cover = m.where(parent_dir(F.col("file_path")) != "").select("community", F.explode(dirs).alias("dir")).groupBy("community", "dir").agg(F.count(F.lit(1)).alias("k")).join(size, "community").where("k * 2 >= n")
    w = Window.partitionBy("community").orderBy(F.size(F.split("dir", "/")).desc(), F.length("dir").desc(), F.col("k").desc(), "dir")
    best = cover.withColumn("r", F.row_number().over(w)).where("r = 1").select("community", "dir")
    return size.join(best, "community", "left").select("community", F.coalesce("dir", "first").alias("area"), F.col("n").alias("symbols"))


def distinct_area_names(g: PropertyGraph, groups: DataFrame) -> DataFrame:
    """(community, area, symbols) with names of their own: of areas that share a name the largest, then the least community, keeps it.

    The others are called after the file that holds most of their symbols, the least among equals; where that name is
    taken too, by a kept name or by a lesser community, the community's number is put behind it.
    """
    named = area_names(g, groups)
    m = groups.join(g.nodes.select("id", "file_path"), "id").where("file_path is not null")
    m = m.where(~is_vendored(F.col("file_path"))).groupBy("community", "file_path").agg(F.count(F.lit(1)).alias("n"))
    file = m.groupBy("community").agg(F.min_by("file_path", F.struct((-F.col("n")).alias("n"), "file_path")).alias("file"))
    order = Window.partitionBy("area").orderBy(F.col("symbols").desc(), "community")
    r = named.join(file, "community", "left").withColumn("_r", F.row_number().over(order))
    r = r.withColumn("own", F.when(F.col("_r") == 1, F.col("area")).otherwise(F.col("file")))
    among = Window.partitionBy("own").orderBy(F.when(F.col("_r") == 1, 0).otherwise(1), "community")
    r = r.withColumn("_q", F.row_number().over(among))
    return r.select("community", F.when(F.col("_q") == 1, F.col("own")).otherwise(F.concat("own", F.lit(" #"), F.col("community"))).alias("area"), "symbols")


def areas(g: PropertyGraph, groups: DataFrame, least: int = 8, most: int = 12) -> DataFrame:
    """(area, community, symbols) of the largest areas of at least ``least`` symbols, each under a name of its own."""
    a = distinct_area_names(g, groups).where(F.col("symbols") >= least)
    return a.orderBy(F.col("symbols").desc(), "area", "community").limit(most)


def area_coupling(g: PropertyGraph, named: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, edges): edges between areas, unordered."""
    of = groups.join(named.select("community", "area"), "community").select("id", "area")
    e = g.edges.join(of.select(F.col("id").alias("src"), F.col("area").alias("x")), "src").join(of.select(F.col("id").alias("dst"), F.col("area").alias("y")), "dst").where("x <> y")
    return e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("edges"))
