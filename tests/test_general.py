"""Schema drift and hot keys: brute force on fixtures, nulls, empty tables, ties, repeats, clashing columns."""

import datetime as dt
import json
import random

import pytest

from weftgraph.operators import hot_keys, schema_drift

EDGES = "src bigint, dst bigint, kind string, confidence string"
INSIGHTS = "repo string, number bigint, hubs array<string>, risk int, computed_at timestamp"
T0 = dt.datetime(2025, 1, 1)


def test_pair_counts_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(30), 7 if rng.random() < 0.4 else rng.randrange(9), rng.choice(["a", "b"]), "x") for _ in range(600)]
    rows += [(None, 7, "a", "x"), (None, 7, "a", "x"), (3, None, "a", "x")] + rows[:20]
    got = {r["dst"]: (r["n_rows"], r["n_partners"]) for r in hot_keys.pair_counts(spark.createDataFrame(rows, EDGES), "dst", "src", "kind").collect()}
    want = {}
    for d in {r[1] for r in rows if r[1] is not None}:
        e = {r[:3] for r in rows if r[1] == d}
        want[d] = (len(e), len({x[0] for x in e if x[0] is not None}))
    assert got == want


def test_heavy_keys(spark):
    e = [(i, 1, "k", None) for i in range(50)] + [(i, 100 + i, "k", None) for i in range(950)]
    i = [("r", n, ["hot"], 1, T0) for n in range(3)] + [("r", n, [f"h{n}"], None, T0) for n in range(100)] + [("r", 1000, None, 2, T0), ("r", 1001, [], 2, T0), ("r", 1002, [None], 2, None)]
    got = {tuple(r) for r in hot_keys.heavy_keys(spark.createDataFrame(e, EDGES), spark.createDataFrame(i, INSIGHTS)).collect()}
    assert got == {("dst", "1"), ("hubs", "hot")}


def test_hub_results_take_the_last_computation(spark):
    later = T0 + dt.timedelta(days=1)
    rows = [("a", 1, ["h", "h"], 5, T0), ("a", 1, ["h"], 1, later), ("a", 1, ["g"], 3, later), ("b", 1, ["h"], None, T0), (None, None, ["h"], 8, None)]
    got = {r["hub"]: (r["pull_requests"], r["mean_risk"]) for r in hot_keys.hub_results(spark.createDataFrame(rows, INSIGHTS)).collect()}
    assert got == {"h": (3, 5.5), "g": (1, 3.0)}


def test_hot_keys_of_empty_tables(spark):
    assert hot_keys.heavy_keys(spark.createDataFrame([], EDGES), spark.createDataFrame([], INSIGHTS)).collect() == []


RECORDS, FILES = "file_id bigint, line_no int, body string", "file_id bigint, stream string, written_at timestamp"


def drift(spark, files, extra=""):
    records, listed = [], []
    for k, (fid, stream, lines) in enumerate(files):
        listed.append((fid, stream, T0 + dt.timedelta(hours=k)))
        records += [(fid, n, b if isinstance(b, (str, type(None))) else json.dumps(b)) for n, b in enumerate(lines)]
    random.Random(3).shuffle(records)
    got = schema_drift.changes(spark.createDataFrame(records, RECORDS), spark.createDataFrame(listed, FILES))
    return {tuple(r) for r in got.select("file_id", "change", "old_field", "new_field").collect()}


def test_changes_of_each_kind(spark):
    a = [{"run_id": i, "x": i * 3, "gone": "s", "m": {"old_name": i + 0.5, "t": 1}} for i in range(8)]
    b = [{"run_id": i, "x": i * 3, "fresh": True, "m": {"new_name": i + 0.5, "t": str(1)}} for i in range(6, 14)]
    got = drift(spark, [(1, "s", a), (2, "s", b)])
    assert got == {(2, "renamed", "m.old_name", "m.new_name"), (2, "removed", "gone", ""), (2, "added", "", "fresh"), (2, "retyped", "m.t", "m.t")}


def test_deviations_nulls_languages_and_broken_lines(spark):
    a = [{"run_id": i, "v": None if i % 2 else 4, "repository": {"languages": {"md": i, "py": i}}} for i in range(6)]
    b = [{"run_id": i, "v": None, "repository": {"languages": {"md": {"files": i}, "rs": 1}}} for i in range(5, 11)]
    b[0] = {"run_id": 5, "v": None, "repository": {"languages": {"md": {"files": 5}}}, "odd": 1}
    got = drift(spark, [(1, "s", a), (2, "s", [*b, '{"run_id": 9, "v', "", None, "[1]", "NaN"])])
    # null throughout keeps its last type; the md number moved below itself
    assert got == {(2, "renamed", "repository.languages.md", "repository.languages.md.files")}


def test_repeated_rows_late_files_and_ties(spark):
    a = [{"run_id": i, "p": i} for i in range(4)]
    files = [(5, "s", a), (6, "s", [{"run_id": 3, "p": 3}]), (7, "t", [{"run_id": 1, "q": 1}])]
    records = [(f, n, json.dumps(x)) for f, _, lines in files for n, x in enumerate(lines)] * 3
    listed = [(6, "s", T0 + dt.timedelta(days=1)), (5, "s", T0), (7, "t", T0), (8, "t", T0), (7, "t", T0)]
    got = schema_drift.changes(spark.createDataFrame(records, RECORDS), spark.createDataFrame(listed, FILES)).collect()
    assert got == []


def test_empty_tables_and_clashing_columns(spark):
    empty = schema_drift.changes(spark.createDataFrame([], RECORDS), spark.createDataFrame([], FILES))
    assert empty.collect() == []
    r = spark.createDataFrame([(1, 0, '{"run_id": 1}', "x", 3)], RECORDS + ", path string, block int")
    f = spark.createDataFrame([(1, "s", T0, 9)], FILES + ", seq int")
    assert schema_drift.changes(r, f).collect() == []


def test_matching_prefers_names_among_equal_values():
    edges = [("m.total_ms", "m.ms_total"), ("m.total_ms", "m.other"), ("m.count", "m.other"), ("m.count", "m.ms_total")]
    assert schema_drift.match(edges) == [("m.count", "m.other"), ("m.total_ms", "m.ms_total")]
    assert schema_drift.match([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("c", "z")]) == [("a", "x"), ("b", "y"), ("c", "z")]


def test_unified_runs(spark):
    a = [{"run_id": "r1", "size": 1}, {"run_id": "r2", "size": 2}]
    b = [{"run_id": "r2", "bytes": 2}, {"run_id": "r3", "bytes": 3}]
    records = [(1, n, json.dumps(x)) for n, x in enumerate(a)] + [(2, n, json.dumps(x)) for n, x in enumerate(b)]
    files = [(1, "s", T0), (2, "s", T0 + dt.timedelta(days=1))]
    got = {r["run_id"]: (r["n_copies"], json.loads(r["record"])) for r in schema_drift.unified_runs(spark.createDataFrame(records, RECORDS), spark.createDataFrame(files, FILES)).collect()}
    assert got == {"r1": (1, {"run_id": "r1", "size": 1}), "r2": (2, {"run_id": "r2", "size": 2}), "r3": (1, {"run_id": "r3", "size": 3})}


def test_typed_runs_are_one_table(spark):
    a = [{"run_id": f"r{i}", "size": i, "m": {"t": 1.5}, "tags": ["x"], "code": 7} for i in range(4)]
    b = [{"run_id": f"r{i}", "bytes": i, "m": {"t": 1.5}, "tags": [], "code": "7"} for i in range(3, 7)]
    b[3] |= {"odd": True, "m": {"t": "slow"}}
    c = [{"id": f"r{i}", "bytes": i, "m": {"t": None}, "tags": None, "code": "7"} for i in range(6, 9)]
    records = [(f, n, json.dumps(x)) for f, lines in ((1, a), (2, b), (3, c)) for n, x in enumerate(lines)]
    files = [(k, "s", T0 + dt.timedelta(days=k)) for k in (1, 2, 3)]
    df = schema_drift.typed_runs(spark.createDataFrame(records, RECORDS), spark.createDataFrame(files, FILES))
    kinds = dict(df.dtypes)
    assert (kinds["size"] if "size" in kinds else kinds["bytes"], kinds["m.t"], kinds["tags"], kinds["code"]) == ("double", "double", "string", "string")
    got = {r["run_id"]: r.asDict() for r in df.collect()}
    name = "bytes" if "bytes" in kinds else "size"
    assert {k: v[name] for k, v in got.items()} == {f"r{i}": float(i) for i in range(7)} and got["r3"]["n_copies"] == 2
    assert got["r0"]["tags"] == '["x"]' and got["r0"]["code"] == "7" and got["r4"]["code"] == '"7"' and got["r0"]["rest"] is None
    assert json.loads(got["r6"]["rest"]) == {"odd": True, "m.t": "slow"} and got["r6"]["m.t"] is None
    empty = schema_drift.typed_runs(spark.createDataFrame([], RECORDS), spark.createDataFrame([], FILES))
    assert empty.collect() == [] and empty.columns == ["stream", "run_id", "first_file", "n_copies", "rest"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_streams_match_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"f{i}" for i in range(8)]
    files, fid, run = [], 0, 0
    for s in range(3):
        fields, last = {n: n for n in names}, []
        for _ in range(5):
            fid += 1
            for n in names:
                u = rng.random()
                if u < 0.12:
                    fields[n] = f"{n}_v{rng.randrange(99)}"
                elif u < 0.2:
                    fields.pop(n, None)
                elif n not in fields and u < 0.5:
                    fields[n] = n
            fresh = [{"run_id": (run := run + 1), **{n: rng.randrange(10**6) for n in names}} for _ in range(6)]
            runs = [*last, *fresh]
            last = fresh[-3:]
            files.append((fid, f"s{s}", [{"run_id": r["run_id"], **{f: r[n] for n, f in fields.items()}} for r in runs]))
    want, before = set(), {}
    for fid, stream, lines in files:
        now = {r["run_id"]: r for r in lines}
        keys = set(lines[0])
        if stream in before:
            old, old_keys = before[stream]
            gone, come = old_keys - keys, keys - old_keys
            shared = [i for i in now if i in old]
            pairs = {(a, b) for a in gone for b in come if all(old[i][a] == now[i][b] for i in shared)}
            want |= {(fid, "renamed", a, b) for a, b in pairs}
            want |= {(fid, "removed", a, "") for a in gone - {p[0] for p in pairs}} | {(fid, "added", "", b) for b in come - {p[1] for p in pairs}}
        before[stream] = (now, keys)
    assert drift(spark, files) == want
