"""Nodes and edges in the stable form: defaults, clamped confidences, ids, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions.ids import edge_id, major
from ..functions.scores import unit
from ..schema import EDGES, NODES, SCHEMA_MAJOR, SCHEMA_VERSION, GraphSchemaError


def _blank(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def _json_map(fields: dict[str, Column]) -> Column:
    """A map of the fields' JSON values, without nulls."""
    none = F.create_map().cast("map<string,string>")
    if not fields:
        return none
    values = F.create_map(*[x for name, c in fields.items() for x in (F.lit(name), F.to_json(F.struct(c.alias("v"))))])
    return F.transform_values(F.map_filter(values, lambda k, v: v != "{}"), lambda k, v: F.substr(v, F.lit(6), F.length(v) - 6))


def _as_map(df: DataFrame, column: str) -> Column:
    """A column of JSON objects, read as structs or maps, as a map of JSON values; anything else as empty."""
    kind = df.schema[column].dataType
    none = F.create_map().cast("map<string,string>")
    if kind.typeName() == "struct":
        return F.when(F.col(column).isNotNull(), _json_map({k: F.col(column)[k] for k in kind.names})).otherwise(none)
    return F.coalesce(F.col(column).cast("map<string,string>"), none) if kind.typeName() == "map" else none


def _with_columns(df: DataFrame, schema, known: tuple[str, ...] = ()) -> DataFrame:
    """Missing columns of ``schema`` as nulls; extra columns go to ``attributes`` as JSON."""
    have = set(df.columns)
    spilled = [c for c in df.columns if c not in {f.name for f in schema} | set(known)]
    for field in schema:
        if field.name not in have:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    if spilled:
        own = _as_map(df, "attributes")
        extra = _json_map({c: F.col(c) for c in spilled})
        df = df.withColumn("attributes", F.map_concat(own, F.map_filter(extra, lambda k, v: ~F.map_contains_key(own, k))))
    return df


def normalize_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as in ``NODES``: missing names from the id's last part, types UNKNOWN; the file from ``source`` (a struct), the node or its metadata, lines from the node or its metadata.

    Columns that the schema does not know go to ``attributes`` as JSON values, and such fields of ``metadata`` to ``metadata_extra``. Idempotent.
    """
    df = _with_columns(nodes, NODES)
    kinds = {f.name: f.dataType for f in NODES["metadata"].dataType}

    def inside(column: str, field: str, kind) -> Column:
        have = df.schema[column].dataType
        fits = have.typeName() == "struct" and field in have.names and (field != "metrics" or have[field].dataType.typeName() == "struct")
        return F.col(column)[field].cast(kind) if fits else F.lit(None).cast(kind)

    id_ = F.coalesce(F.col("id").cast("string"), F.lit(""))
    last = F.coalesce(_blank(F.element_at(F.split(id_, r"\."), -1)), id_)
    name = F.coalesce(_blank(F.col("name")), last)
    meta = {k: inside("metadata", k, kind) for k, kind in kinds.items()}
    file = F.coalesce(_blank(inside("source", "file", "string")), _blank(F.col("file")), meta["file"])
    begin, end = F.coalesce(F.col("line_start").cast("int"), meta["line_start"]), F.coalesce(F.col("line_end").cast("int"), meta["line_end"])
    defaults = {"file": file, "line_start": begin, "line_end": end}
    filled = [F.coalesce(meta[k], defaults.get(k, F.lit(None).cast(kinds[k]))).alias(k) for k in kinds]
    more = df.schema["metadata"].dataType
    extra = _json_map({k: F.col("metadata")[k] for k in more.names if k not in kinds} if more.typeName() == "struct" else {})
    extra = F.map_concat(_as_map(df, "metadata_extra"), extra)
    place = [F.coalesce(inside("source", k, "int" if k != "file" else "string"), defaults[k]).alias(k) for k in ("file", "line_start", "line_end")]
    return df.select(
        F.col("node_idx").cast("long").alias("node_idx"), id_.alias("id"), name.alias("name"), F.coalesce(_blank(F.col("qualified_name")), name).alias("qualified_name"),
        F.coalesce(_blank(F.col("type")), F.lit("UNKNOWN")).alias("type"), F.col("language").cast("string").alias("language"), file.alias("file"),
        begin.alias("line_start"), end.alias("line_end"), F.struct(*filled).alias("metadata"),
        _as_map(df, "attributes").alias("attributes"), F.struct(*place).alias("source"), extra.alias("metadata_extra"),
    )


def normalize_edges(edges: DataFrame) -> DataFrame:
    """Edges as in ``EDGES``: a number as confidence in [0, 1] to 4 places (text and all else: null), evidence a list, type DEPENDENCY and id by default."""
    df = _with_columns(edges, EDGES)
    source, target = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "target"))
    kind = F.coalesce(_blank(F.col("type")), F.lit("DEPENDENCY"))
    evidence = F.col("evidence") if df.schema["evidence"].dataType.typeName() == "array" else F.when(F.col("evidence").isNotNull(), F.array(F.col("evidence").cast("string")))
    number = isinstance(df.schema["confidence"].dataType, (NumericType, BooleanType))
    confidence = F.round(unit(F.col("confidence").cast("double")), 4) if number else F.lit(None).cast("double")
    confidence = F.when(F.col("confidence").isNotNull(), confidence)
    return df.select(
        F.col("edge_idx").cast("long").alias("edge_idx"), F.coalesce(_blank(F.col("id")), edge_id(source, target, kind)).alias("id"), source.alias("source"), target.alias("target"), kind.alias("type"),
        confidence.alias("confidence"),
        F.coalesce(evidence.cast("array<string>"), F.array().cast("array<string>")).alias("evidence"), _as_map(df, "attributes").alias("attributes"),
        F.col("resolution").cast("string").alias("resolution"), F.col("line").cast("int").alias("line"),
    )


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (source, target, type)."""
    return edges.groupBy("source", "target", "type").agg(F.min_by(F.struct(*[c for c in edges.columns if c not in ("source", "target", "type")]), "edge_idx").alias("e")).select("source", "target", "type", "e.*").select(*edges.columns)


def upsert_nodes(nodes: DataFrame, imported: str = "imported") -> DataFrame:
    """One row per id: the first real definition, else the first placeholder, at the place of the id's first row."""
    rest = [c for c in nodes.columns if c not in ("id", "node_idx")]
    picked = nodes.groupBy("id").agg(F.min("node_idx").alias("node_idx"), F.min_by(F.struct(*rest), F.struct(F.coalesce(F.col(imported), F.lit(False)), F.col("node_idx"))).alias("n"))
    return picked.select("node_idx", "id", "n.*").select(*nodes.columns)


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id, the last: what lookups by id see."""
    rest = [c for c in nodes.columns if c != "id"]
    return nodes.groupBy("id").agg(F.max_by(F.struct(*rest), "node_idx").alias("n")).select("id", "n.*").select(*nodes.columns)


def rank_edges(edges: DataFrame, priority: tuple[str, ...], by: str = "source") -> DataFrame:
    """Adds ``rank``: the order in which a node's edges are followed (type priority, target, position)."""
    order = F.when(F.lit(False), 0)
    for i, kind in enumerate(priority):
        order = order.when(F.col("type") == kind, i)
    line = Window.partitionBy(by).orderBy(order.otherwise(len(priority)), "target", "edge_idx")
    return edges.withColumn("rank", F.row_number().over(line))


def compatibility(version: Column) -> Column:
    """What a reader of this schema makes of a version."""
    m = major(version)
    return F.struct(version.alias("requested_version"), F.lit(SCHEMA_VERSION).alias("supported_version"), ((m == 0) | (m == SCHEMA_MAJOR)).alias("compatible"), (m == 0).alias("requires_migration"))


def _major(version: str) -> int:
    head = str(version).split(".", 1)[0]
    return int(head) if head.lstrip("-").isdigit() else 0


def check_migration(from_version: str, to_version: str) -> None:
    """Raises unless a graph of ``from_version`` can be read as ``to_version``."""
    if _major(to_version) != SCHEMA_MAJOR:
        raise GraphSchemaError(f"unsupported target graph schema {to_version}; this runtime supports major {SCHEMA_MAJOR}")
    if _major(from_version) > SCHEMA_MAJOR:
        raise GraphSchemaError(f"graph schema {from_version} is newer than supported {SCHEMA_VERSION}")
