"""Response shapes, source budget, as-of and interval joins, retention."""

import json

from weftgraph.operators import shapes
from weftgraph.streaming import watch

ORDER = {"required": ["id", "lines"], "properties": {"id": {}, "note": {}, "lines": {"type": "array", "items": {"$ref": "#/x/Line"}}}}
LINE = {"required": ["sku"], "properties": {"sku": {}, "order": {"$ref": "#/x/Order"}}}


def test_flatten_follows_references_once():
    got = shapes.flatten_schema({"$ref": "#/x/Order"}, {"Order": ORDER, "Line": LINE})
    assert got == {"id": True, "note": False, "lines": True, "lines.sku": True, "lines.order": False}
    assert shapes.flatten_schema(None, {}) == {} and shapes.flatten_schema({"$ref": "#/x/None"}, {}) == {}


def test_returned_fields():
    code = "def show(id):\n    base = {'id': id}\n    row = {**base, 'lines': [{'sku': 1} for _ in x]}\n    row['total'] = 3\n    if id:\n        return jsonify(row)\n    return dict(error='x')\n"
    assert shapes.returned_fields(code, "show") == {"id", "lines", "lines.sku", "total", "error"}
    assert shapes.returned_fields(code, "other") is None and shapes.returned_fields("def (", "x") is None


def test_shape_check(spark):
    op = json.dumps({"responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/x/Order"}}}}}})
    rows = [("r", "GET /o", op, json.dumps({"Order": ORDER, "Line": LINE}), "show", "def show():\n    return {'id': 1, 'more': 2}\n"), ("r", "GET /x", op, None, "gone", "x = 1"), ("r", "GET /y", None, None, "show", None)]
    got = shapes.shape_check(spark.createDataFrame(rows, "repo string, endpoint string, operation string, schemas string, handler string, text string")).collect()
    assert [(r["missing"], r["extra"], r["missing_required"]) for r in got] == [("lines,lines.order,lines.sku,note", "more", "lines,lines.sku")]


def test_source_budget_skips_what_does_not_fit(spark):
    nodes = spark.createDataFrame([("r", p, "function") for p, n in (("a", 3), ("b", 2), ("c", 1)) for _ in range(n)], "repo string, file_path string, kind string")
    files = spark.createDataFrame([("r", "a", "x" * 60), ("r", "b", "x" * 70), ("r", "c", "x" * 30), ("r", "d", None)], "repo string, file_path string, text string")
    assert shapes.source_budget(nodes, files, 100) == [("r", "a"), ("r", "c")]


def test_as_of_and_interval(spark):
    m = spark.createDataFrame([("f", 3), ("f", 9), ("f", 20), ("g", 1)], "file string, line int")
    d = spark.createDataFrame([("f", 3, "x"), ("f", 9, "b"), ("f", 9, "a"), ("f", 12, "z")], "file string, start_line int, target string")
    assert sorted(tuple(r) for r in shapes.nearest_below(m, d, ["file"]).collect()) == [("f", 3, "x"), ("f", 9, "a")]
    s = spark.createDataFrame([("f", 5, 6), ("f", 50, 51)], "file string, start int, end int")
    r = spark.createDataFrame([("f", 1, 40, 1), ("f", 4, 9, 2), ("f", 6, 9, 3)], "file string, start_line int, end_line int, owner int")
    assert [tuple(x) for x in shapes.innermost(s, r, ["file"]).collect()] == [("f", 5, 6, 2)]


def test_retention(spark, tmp_path):
    store = watch.Revision(spark, str(tmp_path))
    df = spark.createDataFrame([("a", 1)], "file_path string, n int")
    store.bootstrap(df)
    for b in range(4):
        assert store.replace(df.select("file_path"), df, b)
    assert store.number == 4 and store.prune(2) == 3 and store.read().count() == 1 and store.prune(2) == 0
