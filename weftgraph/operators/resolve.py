"""Reference resolution: raw references to edges, as joins with a prioritised ladder.

Every rule yields (src, dst, kind, confidence, rule_seq); on an edge's key the later rule wins. A reference that one
candidate answers gets the rule's tag, one that several answer links all of them as AMBIGUOUS. Names are looked up
within a repository.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import endpoint_shape, mention_tokens
from weftgraph.graph import upsert_edges
from weftgraph.session import written

IMPORT = "module string, symbol string, local string, glob boolean"
CALL = "callee string, receiver string, caller_type string"
INHERIT = "base string, relation string"
LOCAL = "var string, type string"
ROOT_FILES = ("__init__", "index", "mod", "lib", "main")
SUFFIXES = ("py", "pyw", "js", "mjs", "cjs", "jsx", "ts", "tsx", "rs", "go", "java")


def tagged(candidates: DataFrame, keys: list[str], unique: str) -> DataFrame:
    """confidence: ``unique`` where a reference has exactly one candidate, else AMBIGUOUS."""
    w = Window.partitionBy(*keys)
    return candidates.withColumn("confidence", F.when(F.count(F.lit(1)).over(w) == 1, unique).otherwise("AMBIGUOUS"))


def symbols(nodes: DataFrame) -> DataFrame:
    """One node per (repo, file, name) apart from files: the last declaration counts."""
    n = nodes.where("kind <> 'file'")
    return n.groupBy("repo", "file_path", "name").agg(F.max_by(F.struct("id", "kind", "start_line"), F.struct("start_line", "id")).alias("n")).select("repo", "file_path", "name", F.col("n.id").alias("id"), F.col("n.kind").alias("kind"))


def file_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'file'").groupBy("repo", "file_path").agg(F.min("id").alias("id"))


def candidate_paths(file_path: str, module: str, aliases: list[tuple[str, list[str]]] = []) -> list[str]:  # noqa: B006
    """Paths, without extension, that a module name may stand for, best first; a leading ** stands for any directory."""
    here = file_path.rpartition("/")[0]
    out: list[str] = []

    def normal(p: str) -> str:
        parts: list[str] = []
        for x in p.split("/"):
            if x == "..":
                parts = parts[:-1]
            elif x not in ("", "."):
                parts.append(x)
        return "/".join(parts)

    def spread(p: str, anywhere: bool) -> None:
        p = p.rpartition(".")[0] if p.rpartition(".")[2] in SUFFIXES and "/" in p else p
        for tail in ("", *(f"/{r}" for r in ROOT_FILES)):
            if p:
                out.append(("**/" if anywhere else "") + p + tail)

    if module.startswith("./") or module.startswith("../"):
        spread(normal(f"{here}/{module}"), False)
        return out
    if module.startswith("."):
        dots = len(module) - len(module.lstrip("."))
        base = here
        for _ in range(dots - 1):
            base = base.rpartition("/")[0]
        spread(normal(f"{base}/{module.lstrip('.').replace('.', '/')}"), False)
        return out
    for pattern, targets in aliases:
        head, star, tail = pattern.partition("*")
        if module == pattern or star and module.startswith(head) and module.endswith(tail):
            middle = module[len(head) : len(module) - len(tail)] if star else ""
            for t in targets:
                spread(normal(t.replace("*", middle)), False)
    flat = module.replace("::", "/")
    for own in ("crate/", "self/", "super/"):
        if flat.startswith(own):
            flat = flat[len(own) :]
    flat = flat.replace(".", "/") if "/" not in flat else flat
    spread(flat, False)
    spread(f"{here}/{flat}" if here else flat, False)
    spread(flat, True)
    return out


def resolve_modules(files: DataFrame, imports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(repo, file_path, module, target_file): the files a module name stands for.

    Candidate paths are a pure function of the names; they meet the files by equality, a suffix candidate by equality with
    one of the file path's suffixes. The least position wins; among suffix hits the longest shared path, then the shortest, then the path.
    aliases(repo, pattern, targets) of a repository are few and travel with each of its imports.
    """
    asked = imports.select("repo", "file_path", "module").distinct()
    if aliases is not None:
        per = aliases.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("pattern", "targets"))).alias("aliases"))
        asked = asked.join(per, "repo", "left")
    else:
        asked = asked.withColumn("aliases", F.lit(None).cast("array<struct<pattern:string,targets:array<string>>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, path, module, al in zip(pdf["repo"], pdf["file_path"], pdf["module"], pdf["aliases"]):
                known = [(a["pattern"], list(a["targets"])) for a in al] if al is not None else []
                rows += [(repo, path, module, p, i) for i, p in enumerate(candidate_paths(path, module, known))]
            yield pd.DataFrame(rows, columns=["repo", "file_path", "module", "path", "pos"])

    cand = asked.mapInPandas(run, "repo string, file_path string, module string, path string, pos int")
    bare = files.select("repo", F.col("file_path").alias("target_file"), F.regexp_replace("file_path", r"\.[^./]+$", "").alias("path")).distinct()
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("**/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    keyed = bare.select("repo", "target_file", F.explode(F.concat(F.array("path"), suffixes)).alias("path"))
    hits = cand.join(keyed, ["repo", "path"])
    shared = F.size(F.array_intersect(F.split("file_path", "/"), F.split("target_file", "/")))
    w = Window.partitionBy("repo", "file_path", "module").orderBy("pos", shared.desc(), F.length("target_file"), "target_file")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("repo", "file_path", "module", "target_file")


def bindings(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(repo, file_path, local, target_file, symbol, glob): what a local name stands for; the last import of a name counts."""
    i = refs.where("kind = 'import'").select("repo", "file_path", F.from_json("target", IMPORT).alias("t")).select("repo", "file_path", "t.*")
    b = i.join(resolved, ["repo", "file_path", "module"])
    w = Window.partitionBy("repo", "file_path", "local").orderBy(F.col("target_file").desc(), F.col("symbol").desc())
    named = b.where("not glob").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return named.select("repo", "file_path", "local", "target_file", "symbol", "glob").unionByName(b.where("glob").select("repo", "file_path", "local", "target_file", "symbol", "glob").distinct())


def owners(refs: DataFrame, syms: DataFrame, files: DataFrame) -> DataFrame:
    """References with src: the owner's node in their file, the file's node where there is no owner."""
    s = syms.select("repo", "file_path", F.col("name").alias("owner"), F.col("id").alias("owner_id"))
    f = files.select("repo", "file_path", F.col("id").alias("file_id"))
    return refs.join(s, ["repo", "file_path", "owner"], "left").join(f, ["repo", "file_path"], "left").withColumn("src", F.coalesce("owner_id", "file_id")).where("src is not null").drop("owner_id", "file_id")


def doc_mentions(nodes: DataFrame, docs: DataFrame, most: int | None = 2) -> DataFrame:
    """explains edges from docs(id, repo, text) to the named symbols: INFERRED for one candidate; names of more than ``most`` are no mention."""
    t = docs.where("text is not null").select(F.col("id").alias("src"), "repo", F.explode(mention_tokens(F.col("text"))).alias("name"))
    names = nodes.where("kind not in ('file', 'doc') and name is not null").select("repo", "name", F.col("id").alias("dst"))
    n = names.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"))
    ok = n.where(F.col("n") <= most) if most is not None else n
    return t.join(names.join(ok, ["repo", "name"]), ["repo", "name"]).select("src", "dst", F.lit("explains").alias("kind"), F.when(F.col("n") == 1, "INFERRED").otherwise("AMBIGUOUS").alias("confidence"), F.lit(1).alias("rule_seq"))


def import_edges(refs: DataFrame, resolved: DataFrame, syms: DataFrame, files: DataFrame) -> DataFrame:
    """imports edges from the file: to the named member of the module, else to its file; outside modules give none."""
    i = refs.where("kind = 'import'").select("repo", "file_path", F.from_json("target", IMPORT).alias("t")).select("repo", "file_path", "t.module", "t.symbol")
    src = files.select("repo", "file_path", F.col("id").alias("src"))
    b = i.join(resolved, ["repo", "file_path", "module"]).join(src, ["repo", "file_path"])
    member = syms.select("repo", F.col("file_path").alias("target_file"), F.col("name").alias("symbol"), F.col("id").alias("member"))
    whole = files.select("repo", F.col("file_path").alias("target_file"), F.col("id").alias("whole"))
    j = b.join(member, ["repo", "target_file", "symbol"], "left").join(whole, ["repo", "target_file"], "left")
    return j.select("src", F.coalesce("member", "whole").alias("dst"), F.lit("imports").alias("kind"), F.lit("EXTRACTED").alias("confidence"), F.lit(2).alias("rule_seq")).where("dst is not null and src <> dst").distinct()


def call_edges(refs: DataFrame, syms: DataFrame, files: DataFrame, bound: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls edges by the ladder; the least rung with a candidate answers a call.

    1 the receiver's type (self, a typed local, or a type's own name) has the member; 2 the receiver is an imported name;
    3 the callee is one; 4 self and the same file; 5 the receiver names one file's module; 6 exactly one hit among wildcard
    imports; 7 the same file; 8 the whole repository.
    """
    c = refs.where("kind = 'call'").select("repo", "file_path", "owner", F.from_json("target", CALL).alias("t")).select("repo", "file_path", "owner", "t.*")
    c = written(owners(c, syms, files).withColumn("call", F.xxhash64("repo", "file_path", "owner", "callee", "receiver", "caller_type")), "asked")
    target = syms.select("repo", F.col("file_path").alias("target_file"), F.col("name").alias("callee"), F.col("id").alias("dst"))
    here = lambda df: df.join(target, ["repo", "target_file", "callee"])
    is_self = F.col("receiver").isin("self", "this", "cls")
    members = refs.where("kind = 'member'").select("repo", F.col("file_path").alias("target_file"), F.col("owner").alias("type"), F.col("target").alias("callee")).distinct()
    typed_members = members.join(target, ["repo", "target_file", "callee"])
    local = refs.where("kind = 'local'").select("repo", "file_path", "owner", F.from_json("target", LOCAL).alias("l")).select("repo", "file_path", "owner", F.col("l.var").alias("receiver"), F.col("l.type").alias("type")).distinct()
    typed = c.where(is_self & (F.col("caller_type") != "")).withColumn("type", F.col("caller_type")).unionByName(c.join(local, ["repo", "file_path", "owner", "receiver"]).select(*c.columns, "type")).unionByName(c.where((F.col("receiver") != "") & ~F.col("receiver").contains(".")).withColumn("type", F.col("receiver")))
    # a type is looked up where it is declared: in the file itself, or through an import
    in_file = typed.withColumn("target_file", F.col("file_path"))
    via = typed.join(bound.select("repo", "file_path", F.col("local").alias("type"), "target_file"), ["repo", "file_path", "type"]).select(*in_file.columns)
    pick = ["call", "src", "dst"]
    r1 = in_file.unionByName(via).join(typed_members, ["repo", "target_file", "type", "callee"]).select(*pick, F.lit(1).alias("rung"))
    head = F.element_at(F.split("receiver", r"\."), 1)
    b = bound.where("not glob").select("repo", "file_path", "local", "target_file", "symbol")
    r2 = here(c.where("receiver <> ''").withColumn("local", head).join(b, ["repo", "file_path", "local"])).select(*pick, F.lit(2).alias("rung"))
    r3 = c.where("receiver = ''").join(b.withColumnRenamed("local", "callee"), ["repo", "file_path", "callee"]).select("repo", "call", "src", "target_file", F.coalesce(F.nullif("symbol", F.lit("")), F.col("callee")).alias("callee"))
    r3 = r3.join(target, ["repo", "target_file", "callee"]).select(*pick, F.lit(3).alias("rung"))
    r4 = here(c.where(is_self).withColumn("target_file", F.col("file_path"))).select(*pick, F.lit(4).alias("rung"))
    stem = files.select("repo", F.col("file_path").alias("target_file"), F.regexp_extract("file_path", r"([^/.]+)\.[^/]*$", 1).alias("module"))
    r5 = here(c.where("receiver <> ''").withColumn("module", F.element_at(F.split("receiver", r"\."), -1)).join(stem, ["repo", "module"])).select(*pick, F.lit(5).alias("rung"))
    r6 = here(c.where("receiver = ''").join(bound.where("glob").select("repo", "file_path", "target_file").distinct(), ["repo", "file_path"])).select(*pick, F.lit(6).alias("rung"))
    r7 = here(c.where("receiver = ''").withColumn("target_file", F.col("file_path"))).select(*pick, F.lit(7).alias("rung"))
    def single(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy("call").agg(F.count_distinct("dst").alias("k")).where("k = 1").select("call"), "call")

    first = written(r1.unionByName(r2).unionByName(r3).unionByName(single(r4)).unionByName(single(r5)).unionByName(single(r6)).unionByName(single(r7)), "rungs")
    # only what no earlier rung answers meets all equal names of its repository
    callable_ = nodes.where("kind in ('function', 'method', 'struct', 'component')").select("repo", F.col("name").alias("callee"), F.col("id").alias("dst"))
    r8 = c.where("receiver = ''").join(first.select("call").distinct(), "call", "left_anti").join(callable_, ["repo", "callee"]).select(*pick, F.lit(8).alias("rung"))
    best = first.groupBy("call").agg(F.min("rung").alias("rung"))
    won = written(first.join(best, ["call", "rung"], "left_semi").unionByName(r8).select("call", "src", "dst", "rung").distinct(), "won")
    sure: Column = F.when(F.col("rung").isin(1, 2, 3), "EXTRACTED").otherwise("INFERRED")
    k = won.groupBy("call").agg(F.count_distinct("dst").alias("k"))
    e = won.join(k, "call").where("src <> dst").select("src", "dst", F.lit("calls").alias("kind"), F.when(F.col("k") == 1, sure).otherwise("AMBIGUOUS").alias("confidence"), F.lit(3).alias("rule_seq"))
    w = Window.partitionBy("src", "dst").orderBy(F.when(F.col("confidence") == "EXTRACTED", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2))
    return e.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def inheritance_edges(refs: DataFrame, syms: DataFrame, bound: DataFrame, nodes: DataFrame) -> DataFrame:
    """inherits and implements edges: through a binding, else the only one in the file, else all of the repository."""
    i = refs.where("kind = 'inherit'").select("repo", "file_path", "owner", F.from_json("target", INHERIT).alias("t")).select("repo", "file_path", "owner", "t.base", "t.relation")
    src = syms.select("repo", "file_path", F.col("name").alias("owner"), F.col("id").alias("src"))
    i = i.join(src, ["repo", "file_path", "owner"])
    t = syms.where("kind in ('struct', 'interface', 'component')").select("repo", F.col("file_path").alias("target_file"), F.col("name").alias("base"), F.col("id").alias("dst"))
    b = bound.where("not glob").select("repo", "file_path", F.col("local").alias("base"), "target_file", "symbol")
    via = i.join(b, ["repo", "file_path", "base"]).select("repo", "src", "relation", "target_file", F.coalesce(F.nullif("symbol", F.lit("")), F.col("base")).alias("base"), F.col("base").alias("asked"))
    r1 = via.join(t, ["repo", "target_file", "base"]).select("src", "relation", "asked", "dst", F.lit(1).alias("rung"))
    r2 = i.withColumn("target_file", F.col("file_path")).join(t, ["repo", "target_file", "base"]).select("src", "relation", F.col("base").alias("asked"), "dst", F.lit(2).alias("rung"))
    r3 = i.join(t.select("repo", "base", "dst"), ["repo", "base"]).select("src", "relation", F.col("base").alias("asked"), "dst", F.lit(3).alias("rung"))
    every = r1.unionByName(r2).unionByName(r3).where("src <> dst")
    key = ["src", "relation", "asked"]
    won = every.join(every.groupBy(*key).agg(F.min("rung").alias("rung")), [*key, "rung"]).distinct()
    return tagged(won, key, "EXTRACTED").select("src", "dst", F.col("relation").alias("kind"), "confidence", F.lit(4).alias("rule_seq")).distinct()


def contract_nodes(refs: DataFrame) -> DataFrame:
    """endpoint nodes of routes and tools."""
    r = refs.where("kind in ('route', 'tool')").select("repo", "file_path", F.col("target").alias("name")).distinct()
    return r.select(F.xxhash64("repo", "file_path", F.lit("endpoint"), "name").alias("id"), "repo", F.lit("endpoint").alias("kind"), "name", "file_path")


def route_edges(refs: DataFrame, syms: DataFrame, endpoints: DataFrame) -> DataFrame:
    """implements edges from the handler in the same file to its endpoint or tool."""
    r = refs.where("kind in ('route', 'tool')").select("repo", "file_path", "owner", F.col("target").alias("endpoint"))
    h = syms.select("repo", "file_path", F.col("name").alias("owner"), F.col("id").alias("src"))
    e = endpoints.select("repo", "file_path", F.col("name").alias("endpoint"), F.col("id").alias("dst"))
    return r.join(h, ["repo", "file_path", "owner"]).join(e, ["repo", "file_path", "endpoint"]).select("src", "dst", F.lit("implements").alias("kind"), F.lit("EXTRACTED").alias("confidence"), F.lit(5).alias("rule_seq")).distinct()


def consumer_edges(refs: DataFrame, syms: DataFrame, files: DataFrame, endpoints: DataFrame) -> DataFrame:
    """calls edges to endpoints: of the exact name, EXTRACTED however many; else of the shape, INFERRED or AMBIGUOUS."""
    c = owners(refs.where("kind = 'consumer'").select("repo", "file_path", "owner", F.col("target").alias("name")), syms, files)
    e = endpoints.select("repo", "name", F.col("id").alias("dst"))
    exact = c.join(e, ["repo", "name"]).select("src", "name", "repo", "dst", F.lit("EXTRACTED").alias("confidence"))
    rest = c.join(exact.select("repo", "name").distinct(), ["repo", "name"], "left_anti").withColumn("shape", endpoint_shape(F.col("name")))
    shaped = rest.join(e.select("repo", endpoint_shape(F.col("name")).alias("shape"), "dst"), ["repo", "shape"])
    loose = tagged(shaped.select("src", "name", "repo", "dst").distinct(), ["src", "repo", "name"], "INFERRED")
    return exact.unionByName(loose.select(*exact.columns)).select("src", "dst", F.lit("calls").alias("kind"), "confidence", F.lit(6).alias("rule_seq")).where("src <> dst").distinct()


def event_edges(refs: DataFrame, syms: DataFrame, files: DataFrame) -> DataFrame:
    """references edges from who emits an event to all who listen, INFERRED; none to itself."""
    side = lambda kind, name: owners(refs.where(F.col("kind") == kind).select("repo", "file_path", "owner", F.col("target").alias("event")), syms, files).select("repo", "event", F.col("src").alias(name)).distinct()
    return side("event_emit", "src").join(side("event_listen", "dst"), ["repo", "event"]).where("src <> dst").select("src", "dst", F.lit("references").alias("kind"), F.lit("INFERRED").alias("confidence"), F.lit(7).alias("rule_seq")).distinct()


def tool_call_edges(refs: DataFrame, syms: DataFrame, files: DataFrame, endpoints: DataFrame) -> DataFrame:
    t = owners(refs.where("kind = 'tool_call'").select("repo", "file_path", "owner", F.concat(F.lit("TOOL "), F.col("target")).alias("name")), syms, files)
    return t.join(endpoints.select("repo", "name", F.col("id").alias("dst")), ["repo", "name"]).select("src", "dst", F.lit("calls").alias("kind"), F.lit("EXTRACTED").alias("confidence"), F.lit(8).alias("rule_seq")).distinct()


def operation_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """implements edges to declared operations from the symbols their candidate names name; owner is the endpoint, target a JSON list of names."""
    o = refs.where("kind = 'operation'").select("repo", F.col("owner").alias("endpoint"), F.posexplode(F.from_json("target", "array<string>")).alias("pos", "name"))
    e = nodes.where("kind = 'endpoint'").select("repo", F.col("name").alias("endpoint"), F.col("id").alias("dst"))
    s = nodes.where("kind in ('function', 'method')").select("repo", "name", F.col("id").alias("src"))
    hit = o.join(s, ["repo", "name"]).join(e, ["repo", "endpoint"])
    best = hit.join(hit.groupBy("repo", "endpoint").agg(F.min("pos").alias("pos")), ["repo", "endpoint", "pos"])
    return tagged(best.select("repo", "endpoint", "src", "dst").distinct(), ["repo", "endpoint"], "INFERRED").select("src", "dst", F.lit("implements").alias("kind"), "confidence", F.lit(9).alias("rule_seq"))


def resolve(nodes: DataFrame, refs: DataFrame, docs: DataFrame | None = None, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with endpoints, edges) of all rules; docs(id, repo, text)."""
    endpoints = contract_nodes(refs)
    base = ["id", "repo", "kind", "name", "file_path"]
    old = nodes.where("kind = 'endpoint'").select(*base)
    all_endpoints = endpoints.unionByName(old).dropDuplicates(["id"])
    syms, files = symbols(nodes), file_nodes(nodes)
    imports = refs.where("kind = 'import'").select("repo", "file_path", F.from_json("target", IMPORT)["module"].alias("module"))
    resolved = written(resolve_modules(files, imports, aliases), "modules")
    bound = written(bindings(refs, resolved), "bindings")
    rules = [
        import_edges(refs, resolved, syms, files), call_edges(refs, syms, files, bound, nodes), inheritance_edges(refs, syms, bound, nodes), route_edges(refs, syms, endpoints),
        consumer_edges(refs, syms, files, all_endpoints), event_edges(refs, syms, files), tool_call_edges(refs, syms, files, all_endpoints), operation_edges(refs, nodes),
    ]
    if docs is not None:
        rules.insert(0, doc_mentions(nodes, docs))
    edges = rules[0]
    for r in rules[1:]:
        edges = edges.unionByName(r)
    more = endpoints.join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(more, allowMissingColumns=True), upsert_edges(edges, edges.limit(0)).drop("rule_seq")


def affected_files(nodes_before: DataFrame, edges_before: DataFrame, refs: DataFrame, edited: DataFrame, nodes_after: DataFrame) -> DataFrame:
    """(repo, file_path) whose references must be resolved again after edited(repo, file_path) changed.

    The edited files; files with an edge into one of them before; files whose references name anything that an edited file
    declared before or declares now: a symbol, an endpoint or its shape, an event or a tool.
    """
    was = nodes_before.join(edited, ["repo", "file_path"], "left_semi")
    now = nodes_after.join(edited, ["repo", "file_path"], "left_semi")
    src = nodes_before.select(F.col("id").alias("src"), "repo", "file_path")
    into = edges_before.join(was.select(F.col("id").alias("dst")), "dst", "left_semi").join(src, "src").select("repo", "file_path")
    names = was.select("repo", "name").unionByName(now.select("repo", "name")).where("name is not null")
    touched = names.unionByName(names.where(F.col("name").startswith("TOOL ")).select("repo", F.substring("name", 6, 10_000).alias("name"))).unionByName(names.where(F.col("name").rlike(r"^[A-Z]+ /")).select("repo", endpoint_shape(F.col("name")).alias("name")))
    events = refs.join(edited, ["repo", "file_path"], "left_semi").where("kind in ('event_emit', 'event_listen')").select("repo", F.col("target").alias("name"))
    t = F.col("target")
    said = F.array_distinct(F.array_compact(F.array(F.col("owner"), t, endpoint_shape(t), F.get_json_object(t, "$.symbol"), F.get_json_object(t, "$.local"), F.get_json_object(t, "$.callee"), F.get_json_object(t, "$.receiver"), F.get_json_object(t, "$.base"))))
    by_name = refs.select("repo", "file_path", F.explode(said).alias("name")).join(touched.unionByName(events).distinct(), ["repo", "name"], "left_semi").select("repo", "file_path")
    return edited.select("repo", "file_path").unionByName(into).unionByName(by_name).distinct()
