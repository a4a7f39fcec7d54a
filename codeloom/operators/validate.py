"""Graph diagnostics as rows: severity, kind, ord and message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_TYPES, NODE_TYPES, GraphSchemaError
from ..texts import say


def duplicate_ids(df: DataFrame, column: str = "id") -> DataFrame:
    return df.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).count().where("count > 1").select(column)


def _finding(holds: Column, severity: str, kind: str, message: Column) -> Column:
    return F.when(holds, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), message.alias("message")))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _quote(c: Column) -> Column:
    return F.concat(F.lit("'"), F.coalesce(c, F.lit("None")), F.lit("'"))


def _edge_name() -> Column:
    return F.concat(F.lit("edge "), F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("edge_idx").cast("string")))


def _at(kind: str, ord_: str) -> Column:
    return F.concat(F.lit(f"{kind}["), F.col(ord_), F.lit("]"))


def _each(df: DataFrame, ord_: str, findings: list[Column]) -> DataFrame:
    """The findings of each row, in one pass."""
    return df.select(F.col(ord_).cast("long").alias("ord"), F.explode(F.array_compact(F.array(*findings))).alias("f")).select("f.severity", "f.kind", "ord", "f.message")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All findings. Errors: blank ids and ends, duplicate ids, confidence out of range. Warnings: unregistered types, ends without a node.

    One pass over the nodes, one over the edges, one join of all ends with the known ids, and a count of ids each.
    """
    edge = _edge_name()
    of_nodes = [
        _finding(_blank("id"), "error", "node_id", say("blank_id", _at("nodes", "node_idx"))),
        _finding(~_blank("id") & ~F.coalesce(F.col("type"), F.lit("")).isin(*NODE_TYPES), "warning", "node_type", say("node_type", _quote(F.col("id")), _quote(F.col("type")))),
    ]
    of_edges = [
        _finding(_blank("id"), "error", "edge_id", say("blank_id", _at("edges", "edge_idx"))),
        *[_finding(_blank(end), "error", f"edge_{end}", say("blank_end", _at("edges", "edge_idx"), end)) for end in ("source", "target")],
        _finding(~F.coalesce(F.col("type"), F.lit("")).isin(*EDGE_TYPES), "warning", "edge_type", say("edge_type", edge, _quote(F.col("type")))),
        _finding(F.expr("confidence IS NOT NULL AND NOT confidence BETWEEN 0 AND 1"), "error", "confidence", say("confidence", edge)),
    ]
    known = nodes.where(~_blank("id")).select(F.col("id").alias("known")).distinct()
    end = F.explode(F.array(*[F.struct(F.lit(e).alias("side"), F.col(e).alias("at")) for e in ("source", "target")]))
    ends = edges.select(F.col("edge_idx").cast("long").alias("ord"), edge.alias("edge"), end.alias("e")).select("ord", "edge", "e.*").where("coalesce(at, '') <> ''")
    missing = ends.join(known, F.col("at") == F.col("known"), "left_anti")
    missing = missing.select(F.lit("warning").alias("severity"), F.concat(F.lit("missing_"), "side").alias("kind"), "ord", say("missing_end", F.col("edge"), F.col("side"), _quote(F.col("at"))).alias("message"))
    twice = lambda df, kind: duplicate_ids(df).select(F.lit("error").alias("severity"), F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("ord"), say(kind, F.col("id")).alias("message"))
    found = _each(nodes, "node_idx", of_nodes).unionByName(_each(edges, "edge_idx", of_edges)).unionByName(missing)
    return found.unionByName(twice(nodes, "duplicate_node")).unionByName(twice(edges, "duplicate_edge"))


def check_strict(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises with the first errors, if there are any."""
    errors = validate(nodes, edges).where("severity = 'error'").orderBy("kind", "ord", "message").limit(20).collect()
    if errors:
        raise GraphSchemaError("; ".join(r["message"] for r in errors))
