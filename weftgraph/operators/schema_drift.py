"""Schemas that drift between the files of a stream: profiles, changes, renames by matching, one unified table.

1. Profile. Records are spread by (file, block of lines), so a file that holds a third of all rows is many groups;
   each block is folded into one row per path with algebraic counts (records, values by type), and only these
   compact rows are added up per (file, path).
2. Changes. One window per (stream, path) over the files' profile rows finds paths that come, go or change type.
3. Renames. For paths that go or come, value sketches (count and sum of hashes over the runs that both files hold)
   are made with plain aggregates; equal sketches of equal type are the edges of a bipartite graph between the
   versions, and a maximum-weight matching on it (name likeness decides among equals) gives the renames.
4. Unification. Rename chains give every path one canonical name, under which all runs come out in one table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.session import written

#: Lines of a file that one group holds at most.
BLOCK_LINES = 4096
TYPES = ("string", "number", "boolean", "array")
LANGUAGES = "repository.languages"


def no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def parse(body: str | None) -> dict | None:
    """The record of a line; None if it isn't a JSON object."""
    if not body:
        return None
    try:
        got = json.loads(body, parse_constant=no_constant)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def fields(record: dict) -> dict[str, object]:
    """Dotted paths to the values that aren't objects; of an object at repository.languages only md counts."""
    out: dict[str, object] = {}
    stack = [("", record)]
    while stack:
        at, node = stack.pop()
        for k, v in node.items():
            path = at + k
            if isinstance(v, dict):
                if path == LANGUAGES:
                    v = {"md": v["md"]} if "md" in v else {}
                stack.append((path + ".", v))
            else:
                out[path] = v
    return out


def type_of(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (int, float)):
        return "number"
    return "array"


def canonical(v: object) -> str:
    """One text for equal values: 3 and 3.0 are equal numbers, a string never equals a number."""
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        v = int(v)
    if isinstance(v, list):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    return json.dumps(v, sort_keys=True, ensure_ascii=False)


def sketch(v: object) -> int:
    return int.from_bytes(hashlib.blake2b(canonical(v).encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big")


def blocks(records: DataFrame, *more: str) -> DataFrame:
    """Records clustered and sorted by (file, block of lines), each line once: exact repeats of a row fall into the same block."""
    r = records.where("file_id is not null").select(
        "file_id", F.coalesce("line_no", F.lit(0)).alias("line_no"), "body", *more,
        F.floor(F.coalesce("line_no", F.lit(0)) / BLOCK_LINES).cast("int").alias("block"),
    )
    return r.repartition("file_id", "block").sortWithinPartitions("file_id", "block", "line_no")


def profile(records: DataFrame) -> DataFrame:
    """(file_id, path, n_records, n_string, n_number, n_boolean, n_array); the path '' counts the file's records.

    Lines that aren't JSON objects, null lines and repeats of the same line are ignored.
    """
    schema = "file_id bigint, path string, n_records bigint, n_string bigint, n_number bigint, n_boolean bigint, n_array bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: int | None = None
        got: dict[str, list[int]] = {}
        line: tuple | None = None
        rows: list[list] = []
        for pdf in batches:
            for f, n, body in zip(pdf["file_id"].tolist(), pdf["line_no"].tolist(), pdf["body"].tolist()):
                if f != now:
                    rows += ([now, p, *c] for p, c in got.items())
                    now, got, line = f, {}, None
                if (n, body) == line:
                    continue
                line = (n, body)
                record = parse(body)
                if record is None:
                    continue
                got.setdefault("", [0, 0, 0, 0, 0])[0] += 1
                for path, v in fields(record).items():
                    c = got.get(path)
                    if c is None:
                        c = got[path] = [0, 0, 0, 0, 0]
                    c[0] += 1
                    kind = type_of(v)
                    if kind is not None:
                        c[1 + TYPES.index(kind)] += 1
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        rows += ([now, p, *c] for p, c in got.items())
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    columns = ["file_id", "path", "n_records", "n_string", "n_number", "n_boolean", "n_array"]
    part = blocks(records).select("file_id", "line_no", "body").mapInPandas(run, schema)
    return part.groupBy("file_id", "path").agg(*(F.sum(c).alias(c) for c in columns[2:]))


def layouts(records: DataFrame, files: DataFrame) -> DataFrame:
    """(stream, seq, file_id, path, type): the fields of each file; seq counts the stream's files by (written_at, file_id).

    A field is in at least half of the file's records. Its type is that of most of its non-null values (the first of
    string, number, boolean, array among equals); where it is null throughout, its last type in the stream stays, null
    if it never had one. Files without a JSON record have no layout and are passed over. What is ordered per stream are
    files, one small row each (and one per path), never records.
    """
    p = written(profile(records), "profile")
    n = p.where("path = ''").select("file_id", F.col("n_records").alias("n_file"))
    order = Window.partitionBy("stream").orderBy("written_at", "file_id")
    placed = files.select("file_id", "stream", "written_at").dropDuplicates(["file_id"]).join(n, "file_id").withColumn("seq", F.row_number().over(order))
    kept = p.where("path <> ''").join(placed, "file_id").where("n_records * 2 >= n_file")
    best = F.greatest(*(F.col(f"n_{t}") for t in TYPES))
    own = F.when(best > 0, F.coalesce(*(F.when(F.col(f"n_{t}") == best, F.lit(t)) for t in TYPES)))
    before = Window.partitionBy("stream", "path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        kept.withColumn("type", F.last(own, ignorenulls=True).over(before))
        .select("stream", "seq", "file_id", "path", "type")
        .join(placed.groupBy("stream").agg(F.max("seq").alias("n_files")), "stream")
    )


def steps(layout: DataFrame, placed: DataFrame) -> DataFrame:
    """(file_id, prior_id, change, path, type, old_type): what comes, goes or is retyped in a file against the file before."""
    w = Window.partitionBy("stream", "path").orderBy("seq")
    seen = layout.select(
        "*", F.lag("seq").over(w).alias("lag_seq"), F.lead("seq").over(w).alias("lead_seq"), F.lag("type").over(w).alias("lag_type")
    )
    here = F.col("lag_seq") == F.col("seq") - 1
    event = F.array(
        F.when((F.col("seq") > 1) & ~F.coalesce(here, F.lit(False)), F.struct(F.col("seq").alias("at"), F.lit("comes").alias("change"))),
        F.when((F.col("seq") < F.col("n_files")) & ~F.coalesce(F.col("lead_seq") == F.col("seq") + 1, F.lit(False)), F.struct((F.col("seq") + 1).alias("at"), F.lit("goes").alias("change"))),
        F.when(here & (F.col("lag_type") != F.col("type")), F.struct(F.col("seq").alias("at"), F.lit("retyped").alias("change"))),
    )
    flat = seen.select("stream", "path", "type", F.explode(F.filter(event, lambda e: e.isNotNull())).alias("e"))
    ids = placed.select("stream", F.col("seq").alias("at"), "file_id", "prior_id")
    return flat.select("stream", "path", "type", F.col("e.at").alias("at"), F.col("e.change").alias("change")).join(ids, ["stream", "at"])


def sequence(layout: DataFrame) -> DataFrame:
    """(stream, seq, file_id, prior_id) of the files that have a layout."""
    w = Window.partitionBy("stream").orderBy("seq")
    return layout.select("stream", "seq", "file_id").distinct().withColumn("prior_id", F.lag("file_id").over(w))


def value_sketches(records: DataFrame, change: DataFrame) -> DataFrame:
    """(at_file, side, path, n, s): over the runs that a file shares with the one before, how many carry the path and the sum of their value hashes.

    side is 'goes' (the earlier file's path) or 'comes'. Only files with paths on both sides are parsed again, only for these paths.
    """
    moved = change.where("change in ('goes', 'comes')")
    both = moved.groupBy(F.col("file_id").alias("at_file"), "prior_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("change") == "goes", F.col("path")))).alias("goes"),
        F.array_sort(F.collect_set(F.when(F.col("change") == "comes", F.col("path")))).alias("comes"),
    ).where("size(goes) > 0 and size(comes) > 0")
    wanted = both.select(F.col("prior_id").alias("file_id"), "at_file", F.lit("goes").alias("side"), F.col("goes").alias("paths")).unionByName(
        both.select(F.col("at_file").alias("file_id"), "at_file", F.lit("comes").alias("side"), F.col("comes").alias("paths"))
    )
    schema = "at_file bigint, side string, run string, path string, type string, s bigint"
    columns = ["at_file", "side", "run", "path", "type", "s"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for body, at, side, paths in zip(pdf["body"].tolist(), pdf["at_file"].tolist(), pdf["side"].tolist(), pdf["paths"].tolist()):
                record = parse(body)
                if record is None or record.get("run_id") is None:
                    continue
                name, got = canonical(record["run_id"]), fields(record)
                rows.append([at, side, name, "", None, 0])
                rows += ([at, side, name, p, type_of(got[p]), sketch(got[p])] for p in paths if p in got)
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    parsed = records.select("file_id", "body").join(wanted, "file_id").select("body", "at_file", "side", "paths").mapInPandas(run, schema)
    # a repeated line counts once; a run whose repeats differ in a value keeps the least hash on both sides
    once = written(parsed.groupBy("at_file", "run", "side", "path").agg(F.min("s").alias("s")), "values")
    sides = once.where("path = ''").groupBy("at_file", "run").agg(F.count(F.lit(1)).alias("n_sides")).where("n_sides = 2").select("at_file", "run")
    # sums of 48-bit hashes, each mixed with its run, fit a long for as many runs as files can hold; n guards against the rest
    return (
        once.where("path <> ''").join(sides, ["at_file", "run"])
        .groupBy("at_file", "side", "path")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("run", "s").bitwiseAND(F.lit((1 << 47) - 1))).alias("s"))
        .join(sides.groupBy("at_file").agg(F.count(F.lit(1)).alias("n_shared")), "at_file")
        .where("n = n_shared")
    )


def likeness(a: str, b: str) -> float:
    """Name likeness of two paths: shared letter pairs of the whole path, and of its last part."""

    def dice(x: str, y: str) -> float:
        p, q = {x[i : i + 2] for i in range(len(x) - 1)}, {y[i : i + 2] for i in range(len(y) - 1)}
        return 2 * len(p & q) / (len(p) + len(q)) if p and q else 0.0

    return dice(a, b) + dice(a.rpartition(".")[2], b.rpartition(".")[2])


def match(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Maximum matching of greatest total name likeness, by shortest augmenting paths (successive, Bellman-Ford)."""
    left = sorted({a for a, _ in edges})
    cost = {(a, b): 1.0 - likeness(a, b) / 4 for a, b in edges}
    out_of: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        out_of.setdefault(a, []).append(b)
    mate: dict[str, str] = {}  # right -> left
    of: dict[str, str] = {}  # left -> right
    while True:
        dist = {a: 0.0 for a in left if a not in of}
        back: dict[str, str] = {}
        changed, ends = True, {}
        while changed:
            changed = False
            for a in list(dist):
                for b in out_of[a]:
                    if of.get(a) == b:
                        continue
                    d = dist[a] + cost[a, b]
                    if d < ends.get(b, 1e18) - 1e-12:
                        ends[b], back[b], changed = d, a, True
                        c = mate.get(b)
                        if c is not None and d - cost[c, b] < dist.get(c, 1e18) - 1e-12:
                            dist[c] = d - cost[c, b]
        free = sorted((d, b) for b, d in ends.items() if b not in mate)
        if not free:
            return sorted(of.items())
        b = free[0][1]
        while True:
            a = back[b]
            was = of.get(a)
            mate[b], of[a] = a, b
            if was is None:
                break
            b = was


def renames(records: DataFrame, change: DataFrame) -> DataFrame:
    """(file_id, old_field, new_field) by matching, in each file, paths that go with paths that come."""
    sk = value_sketches(records, change)
    typed = change.where("change in ('goes', 'comes')").select(F.col("file_id").alias("at_file"), F.col("change").alias("side"), "path", "type").join(sk, ["at_file", "side", "path"])
    g = typed.where("side = 'goes'").select("at_file", F.col("path").alias("old"), F.col("type").alias("t"), "n", "s")
    c = typed.where("side = 'comes'").select("at_file", F.col("path").alias("new"), F.col("type").alias("u"), "n", "s")
    edges = g.join(c, ["at_file", "n", "s"]).where("t = u or t is null or u is null").select("at_file", "old", "new")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = match(list(zip(pdf["old"].tolist(), pdf["new"].tolist())))
        return pd.DataFrame([(int(pdf["at_file"].iloc[0]), a, b) for a, b in got], columns=["file_id", "old_field", "new_field"])

    return edges.groupBy("at_file").applyInPandas(run, "file_id bigint, old_field string, new_field string")


def changes(records: DataFrame, files: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """(file_id, change, old_field, new_field) of each file against the file before in its stream.

    Null bodies, lines that don't parse, repeated rows, empty tables: no change comes of them. Columns beyond the ones
    named here are not read. ``layout`` is that of ``layouts``, where the caller has it already.
    """
    layout = written(layouts(records, files), "layouts") if layout is None else layout
    change = written(steps(layout, sequence(layout)), "steps")
    named = written(renames(records, change), "renames")
    old = named.select("file_id", F.col("old_field").alias("path"), F.lit("goes").alias("change"))
    new = named.select("file_id", F.col("new_field").alias("path"), F.lit("comes").alias("change"))
    rest = change.where("change <> 'retyped'").join(old.unionByName(new), ["file_id", "path", "change"], "left_anti")
    empty = F.lit("")
    return (
        named.select("file_id", F.lit("renamed").alias("change"), "old_field", "new_field")
        .unionByName(rest.where("change = 'goes'").select("file_id", F.lit("removed").alias("change"), F.col("path").alias("old_field"), empty.alias("new_field")))
        .unionByName(rest.where("change = 'comes'").select("file_id", F.lit("added").alias("change"), empty.alias("old_field"), F.col("path").alias("new_field")))
        .unionByName(change.where("change = 'retyped'").select("file_id", "change", F.col("path").alias("old_field"), F.col("path").alias("new_field")))
    )


def canonical_names(found: DataFrame, most: int = 100_000) -> dict[str, str]:
    """One name for all names that renames connect: the most frequent old name's, first by name among equals.

    The distinct pairs of field names are a matter of the schema, not of the rows; more than ``most`` are an error.
    """
    pairs = found.where("change = 'renamed'").groupBy("old_field", "new_field").count().limit(most + 1).collect()
    if len(pairs) > most:
        raise ValueError(f"more than {most} distinct renames")
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    weight: dict[str, int] = {}
    for r in sorted(pairs, key=lambda r: (r[0], r[1])):
        weight[r[0]] = weight.get(r[0], 0) + r[2]
        a, b = root(r[0]), root(r[1])
        if a != b:
            parent[b] = a
    members: dict[str, list[str]] = {}
    for x in list(parent):
        members.setdefault(root(x), []).append(x)
    return {x: min(m, key=lambda y: (-weight.get(y, 0), y)) for m in members.values() for x in m}


def column_types(layout: DataFrame, names: dict[str, str], most: int = 100_000) -> dict[str, str]:
    """The type of each canonical field: the one that all files give it, '' where they differ or never tell.

    The distinct (path, type) are a matter of the schema, not of the rows; more than ``most`` are an error.
    """
    got = layout.select("path", "type").distinct().limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} distinct fields")
    kinds: dict[str, set[str]] = {}
    for r in got:
        kinds.setdefault(names.get(r["path"], r["path"]), set()).update([r["type"]] if r["type"] else [])
    return {p: next(iter(k)) if len(k) == 1 else "" for p, k in sorted(kinds.items())}


def _runs(records: DataFrame, files: DataFrame, names: dict[str, str], types: dict[str, str]) -> DataFrame:
    schema = "file_id bigint, line_no int, run_id string, schema_version string, repository string, record string, fields string, rest string"
    key = names.get("run_id", "run_id")
    version, repository = names.get("schema_version", "schema_version"), names.get("repository.name", "repository.name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def dumps(x: dict) -> str:
            return json.dumps(x, sort_keys=True, ensure_ascii=False)

        for pdf in batches:
            rows = []
            for f, n, body in zip(pdf["file_id"].tolist(), pdf["line_no"].tolist(), pdf["body"].tolist()):
                record = parse(body)
                if record is None:
                    continue
                got = {names.get(k, k): v for k, v in fields(record).items()}
                if got.get(key) is None:
                    continue
                text = lambda k: None if got.get(k) is None else str(got[k])
                typed, rest = {}, {}
                for k, v in got.items():
                    kind = types.get(k)
                    if kind is None or kind and kind != "array" and v is not None and type_of(v) != kind:
                        rest[k] = v
                    elif v is not None:
                        typed[k] = v if kind and kind != "array" else dumps(v)
                rows.append((f, n, str(got[key]), text(version), text(repository), dumps(got), dumps(typed), dumps(rest) if rest else None))
            if rows:
                yield pd.DataFrame(rows, columns=["file_id", "line_no", "run_id", "schema_version", "repository", "record", "fields", "rest"])

    flat = records.where("file_id is not null").select("file_id", F.coalesce("line_no", F.lit(0)).alias("line_no"), "body").mapInPandas(run, schema)
    placed = files.select("file_id", "stream", "written_at").dropDuplicates(["file_id"])
    first = F.min_by(F.struct("file_id", "schema_version", "repository", "record", "fields", "rest"), F.struct("written_at", "file_id", "line_no", "record"))
    return flat.join(placed, "file_id").groupBy("stream", "run_id").agg(first.alias("r"), F.count(F.lit(1)).alias("n_copies"))


def unified_runs(records: DataFrame, files: DataFrame) -> DataFrame:
    """(stream, run_id, first_file, n_copies, schema_version, repository, record): each run once, its fields under canonical names.

    record is a JSON object of canonical dotted paths. Of several copies of a run the one in the earliest file (by
    written_at, then line) counts. Records without run_id, under whatever name it goes, are left out.
    """
    got = _runs(records, files, canonical_names(changes(records, files)), {})
    return got.select("stream", "run_id", F.col("r.file_id").alias("first_file"), "n_copies", F.col("r.schema_version").alias("schema_version"), F.col("r.repository").alias("repository"), F.col("r.record").alias("record"))


def typed_runs(records: DataFrame, files: DataFrame) -> DataFrame:
    """(stream, run_id, first_file, n_copies, one column per canonical field, rest): the runs as one table of one schema.

    A column is named by the field's canonical dotted path and typed double, string or boolean where all files agree on
    that; arrays, and fields whose type changes, keep the JSON text of their values, so that none is lost. rest is a JSON
    object of what has no column: fields of single records, and values of another type than their column's; null
    if there is nothing. Which copy of a run counts is as in ``unified_runs``.
    """
    layout = written(layouts(records, files), "layouts")
    names = canonical_names(changes(records, files, layout))
    types = column_types(layout, names)
    got = _runs(records, files, names, types).select("stream", "run_id", "r", "n_copies")
    taken = {"stream", "run_id", "first_file", "n_copies", "rest"}
    paths = [p for p in types if p not in taken and p != names.get("run_id", "run_id")]
    sql = {"number": T.DoubleType(), "boolean": T.BooleanType()}
    schema = T.StructType([T.StructField(p, sql.get(types[p], T.StringType())) for p in paths])
    v = got.withColumn("v", F.from_json("r.fields", schema)) if paths else got.withColumn("v", F.lit(None))
    return v.select("stream", "run_id", F.col("r.file_id").alias("first_file"), "n_copies", *(F.col(f"v.`{p}`").alias(p) for p in paths), F.col("r.rest").alias("rest"))
