"""Answers as text: an aligned table, or JSON."""

from __future__ import annotations

import json

from pyspark.sql import Row

from weftgraph.plans.planner import Answer

WIDTH = 60


def plain(v: object) -> object:
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


def cell(v: object) -> str:
    v = plain(v)
    if v is None:
        text = ""
    elif isinstance(v, dict) and "file" in v:
        text = f"{v['name']} ({v['file']}:{v['line']})"
    elif isinstance(v, list) and v and isinstance(v[0], dict) and "type" in v[0]:
        text = " -> ".join([str(v[0]["source"]), *(str(e["target"]) for e in v)])
    elif isinstance(v, (dict, list)):
        text = json.dumps(v, ensure_ascii=False)
    else:
        text = str(v)
    return text if len(text) <= WIDTH else text[: WIDTH - 1] + "…"


def to_table(answer: Answer) -> str:
    rows = [[cell(v) for v in r] for r in answer.rows.collect()]  # a page: at most 1000 rows an arm
    if not rows:
        return "no rows"
    wide = [max(len(c), *(len(r[k]) for r in rows)) for k, c in enumerate(answer.columns)]
    lines = ["  ".join(c.ljust(w) for c, w in zip(x, wide)).rstrip() for x in [answer.columns, *rows]]
    lines.append(f"{len(rows)} rows" + (", more were left out" if answer.truncated() else ""))
    return "\n".join(lines)


def to_json(answer: Answer) -> str:
    rows = [[plain(v) for v in r] for r in answer.rows.collect()]
    return json.dumps({"columns": answer.columns, "rows": rows, "truncated": answer.truncated()}, ensure_ascii=False)
