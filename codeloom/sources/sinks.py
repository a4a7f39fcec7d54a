"""Results as Parquet tables, and as the JSON files that readers of reports expect."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame

from ..schema import SCHEMA_VERSION


def write_parquet(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def _rows(df: DataFrame, order: str) -> Iterator[dict]:
    """Rows in order, fetched partition by partition."""
    for row in df.orderBy(order).toLocalIterator():
        yield {k: v for k, v in row.asDict(recursive=True).items() if k != "order"}


def _dumped(value: object, indent: int) -> str:
    return json.dumps(value, indent=4).replace("\n", "\n" + " " * indent)


def _stream(path: str, parts: Iterator[str], begin: str, end: str) -> None:
    """Items between brackets, written as they come: no more than one is held."""
    with Path(path).open("w", encoding="utf-8") as out:
        out.write(begin)
        _items(out, parts, 4)
        out.write(end)


def _items(out: TextIO, parts: Iterator[str], indent: int) -> None:
    empty = True
    for part in parts:
        out.write(("" if empty else ",") + "\n" + " " * indent + part)
        empty = False
    if not empty:
        out.write("\n" + " " * (indent - 4))


def write_ledger_json(ledgers: DataFrame, path: str, column: str = "legacy") -> None:
    """``{id: notation}``, indented."""
    _stream(path, (f"{json.dumps(r['root'])}: {json.dumps(r[column])}" for r in _rows(ledgers.select("root", column), "root")), "{", "}")


def write_keyed_json(df: DataFrame, path: str, key: str) -> None:
    """``{key: entry}``, indented: enhanced ledgers and clusters."""
    _stream(path, (f"{json.dumps(r[key])}: {_dumped({k: v for k, v in r.items() if k != key}, 4)}" for r in _rows(df, key)), "{", "}")


def write_rows_json(df: DataFrame, path: str, order: str) -> None:
    """A list of rows, indented."""
    _stream(path, (_dumped(r, 4) for r in _rows(df, order)), "[", "]")


def write_sections_json(sections: dict[str, tuple[DataFrame, str] | object], path: str) -> None:
    """One object; a (DataFrame, order) is written as a list of its rows, anything else as it is."""
    with Path(path).open("w", encoding="utf-8") as out:
        out.write("{")
        for i, (name, part) in enumerate(sections.items()):
            out.write(("," if i else "") + f"\n    {json.dumps(name)}: ")
            if isinstance(part, tuple):
                out.write("[")
                _items(out, (_dumped(r, 8) for r in _rows(*part)), 8)
                out.write("]")
            else:
                out.write(_dumped(part, 4))
        out.write("\n}")


def diagnostics(findings: DataFrame) -> dict:
    """valid, errors, warnings and their numbers, of findings (severity, kind, ord, message); a report for people, held whole."""
    rows = findings.orderBy("kind", "ord", "message").select("severity", "message").toLocalIterator()
    found: dict[str, list[str]] = {"error": [], "warning": []}
    for r in rows:
        found[r["severity"]].append(r["message"])
    errors, warnings = found["error"], found["warning"]
    return {"valid": not errors, "errors": errors, "warnings": warnings, "error_count": len(errors), "warning_count": len(warnings)}


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str, generator: str = "codeloom", version: str = "1.0.0", findings: DataFrame | None = None, extensions: dict | None = None) -> None:
    """The graph (normalised) in its versioned envelope, nodes and edges in their order, with diagnostics of ``findings`` and extensions."""
    loads = lambda m: {k: json.loads(v) for k, v in (m or {}).items()}

    def node(r: dict) -> dict:
        extra = loads(r.pop("metadata_extra", None))
        return {k: v for k, v in r.items() if k != "node_idx"} | {"metadata": extra | (r["metadata"] or {}), "attributes": loads(r["attributes"])}

    def edge(r: dict) -> dict:
        return {k: v for k, v in r.items() if k != "edge_idx"} | {"attributes": loads(r["attributes"])}

    counts = {"directed": True, "multigraph": True, "node_count": nodes.count(), "edge_count": edges.count()}
    head = {"schema": f"{generator}.graph", "schema_version": SCHEMA_VERSION, "generator": {"name": generator, "version": version}, "graph": counts}
    empty = {"valid": True, "errors": [], "warnings": [], "error_count": 0, "warning_count": 0}
    with Path(path).open("w", encoding="utf-8") as out:
        out.write(json.dumps(head, indent=4)[:-2])
        for name, parts in (("nodes", map(node, _rows(nodes, "node_idx"))), ("edges", map(edge, _rows(edges, "edge_idx")))):
            out.write(f',\n    "{name}": [')
            _items(out, (_dumped(p, 8) for p in parts), 8)
            out.write("]")
        for name, part in (("diagnostics", diagnostics(findings) if findings is not None else empty), ("extensions", extensions or {})):
            out.write(f',\n    "{name}": {_dumped(part, 4)}')
        out.write("\n}")
