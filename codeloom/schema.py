"""The graph model: schemas, registered types and fixed orders."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_MAJOR, SCHEMA_VERSION = 1, "1.0.0"

# Registered node and edge types, and the orders and weights that results depend on.
NODE_TYPES = ("VERTEX", "PARTICLE", "TRANSFORM", "MEDIATOR", "FRONTEND", "JAVASCRIPT", "AJAX", "DEPENDENCY", "UNKNOWN")
EDGE_TYPES = ("CALL", "CONTAINS", "PARTICLE_ENTANGLEMENT", "SERIALIZER_ENTANGLEMENT", "AJAX", "EVENT", "OBSERVATION", "VIRTUAL", "DEPENDENCY")
TRACE_PRIORITY = ("SERIALIZER_ENTANGLEMENT", "CALL", "PARTICLE_ENTANGLEMENT", "EVENT", "AJAX", "DEPENDENCY", "VIRTUAL", "OBSERVATION", "CONTAINS")
TERMINAL_TYPES = ("PARTICLE", "TRANSFORM", "AJAX", "DEPENDENCY")
DEPENDENCY_EDGES = ("PARTICLE_ENTANGLEMENT", "SERIALIZER_ENTANGLEMENT", "CALL", "OBSERVATION", "AJAX", "EVENT", "VIRTUAL", "DEPENDENCY")
REVIEW_TYPES = ("VERTEX", "TRANSFORM", "FRONTEND")
HIGH_RISK_TYPES = ("VERTEX", "FRONTEND")

METRICS = T.StructType([T.StructField(n, T.IntegerType()) for n in (
    "loc", "cyclomatic_complexity", "branch_count", "call_count", "assignment_count", "return_count", "raise_count", "exception_handler_count", "field_count", "relationship_count")])
METADATA = T.StructType([
    *[T.StructField(n, T.DoubleType()) for n in ("mass", "charge", "spin", "energy", "coupling", "lifetime")],
    T.StructField("file", T.StringType()), T.StructField("lines", T.IntegerType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()),
    T.StructField("metrics", METRICS), T.StructField("metric_scope", T.StringType()),
])
SOURCE = T.StructType([T.StructField("file", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType())])
NODES = T.StructType([
    T.StructField("node_idx", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("id", "name", "qualified_name", "type", "language", "file")],
    T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()),
    T.StructField("metadata", METADATA), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("source", SOURCE), T.StructField("metadata_extra", T.MapType(T.StringType(), T.StringType())),
])
EDGES = T.StructType([
    T.StructField("edge_idx", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("id", "source", "target", "type")],
    T.StructField("confidence", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StringType())),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("resolution", T.StringType()), T.StructField("line", T.IntegerType()),
])


class GraphSchemaError(ValueError):
    """A graph that a strict reader refuses."""
