"""Cells of sheets as services send them: JSON of any depth as text nodes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

NODES = "array<struct<text:string,type:string,link:string>>"


def _plain(text: str) -> dict:
    return {"text": text, "type": "text", "link": ""}


def _first(d: dict, *keys: str) -> str:
    return next((d[k] for k in keys if isinstance(d.get(k), str)), "")


def _written(v) -> str:
    """A number or truth value as text: whole numbers below 1e21 in full."""
    if isinstance(v, bool):
        return "true" if v else "false"
    x = float(v)
    return f"{x:.0f}" if x == x and abs(x) < 1e21 and x.is_integer() else repr(x)


def _listed(items: list) -> list[dict]:
    """Nodes of a list; lists in it are opened in place, however deep."""
    out, todo = [], [iter(items)]
    while todo:
        for v in todo[-1]:
            if isinstance(v, dict):
                text = _first(v, "text", "value")
                if text:
                    out.append({"text": text, "type": _first(v, "type") or "text", "link": _first(v, "link")})
            elif isinstance(v, list):
                todo.append(iter(v))
                break
            elif isinstance(v, str) and v:
                out.append(_plain(v))
        else:
            todo.pop()
    return out


def nodes(raw: str | None) -> list[dict]:
    """The nodes of one cell."""
    if not raw:
        return []
    try:
        v = json.loads(raw)
    except (ValueError, RecursionError):
        return [_plain(raw)]
    if v is None or v == "":
        return []
    if isinstance(v, dict):
        if "rich_text" in v:
            return _listed(v["rich_text"]) if isinstance(v["rich_text"], list) else []
        text = next((v[k] for k in ("text", "value") if isinstance(v.get(k), str)), None)
        return [] if text is None else [_plain(text)]
    if isinstance(v, list):
        return _listed(v)
    return [_plain(v if isinstance(v, str) else _written(v))]


def cell_nodes(cell: Column) -> Column:
    """(text, type, link) of the nodes of a cell written as JSON.

    A string is a node, a number or truth value as it is written, null and the empty string none. Of an object, its ``rich_text`` list
    counts, else its ``text``, else its ``value``, if they are strings. Of a list, objects are nodes with text, type and link, strings are nodes,
    lists are opened in place, and other things and nodes without text are left out. What is no JSON, or nested deeper than a reader goes, is one text.
    """

    @pandas_udf(NODES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for cells in batches:
            yield cells.map(nodes)

    return run(cell.cast("string"))


def same_cells(a: Column, b: Column) -> Column:
    """Whether the texts of two cells' nodes are equal, but for line ends behind them."""
    text = lambda n: F.regexp_replace(F.array_join(F.transform(n, lambda x: x["text"]), ""), "[\\r\\n]+$", "")
    return text(a) == text(b)
