"""Source trees and graph files as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import relative_path
from ..texts import say

# Folders that are not part of a project.
EXCLUDED_DIRS = ("venv", ".venv", "env", "__pycache__", ".git", "node_modules")


def read_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (), excluded: tuple[str, ...] = EXCLUDED_DIRS) -> DataFrame:
    """(path, rel_path, content) of the files under ``root`` outside excluded folders; files that are not UTF-8 have null content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    files = files.withColumn("path", path).withColumn("rel_path", relative_path(F.col("path"), root.removeprefix("file://")))
    folders = F.slice(F.split("rel_path", "/"), F.lit(1), F.size(F.split("rel_path", "/")) - 1)
    files = files.where(~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in excluded])))
    if suffixes:
        wanted = F.lit(False)
        for s in suffixes:
            wanted = wanted | F.endswith("rel_path", F.lit(s))
        files = files.where(wanted)
    return files.select("path", "rel_path", F.expr("try_validate_utf8(cast(content AS string))").alias("content"))


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON graph file, plain or in the versioned envelope, with their positions."""
    whole = spark.read.option("multiLine", "true").json(path)

    def part(name: str, idx: str) -> DataFrame:
        if name not in whole.columns or not whole.schema[name].dataType.simpleString().startswith("array<struct"):
            return spark.createDataFrame([], f"{idx} long, id string")
        return whole.select(F.posexplode(name).alias(idx, "x")).select(F.col(idx).cast("long").alias(idx), "x.*")

    return part("nodes", "node_idx"), part("edges", "edge_idx")


# The parts of the envelope; all else at the top are extensions.
_ENVELOPE = ("schema", "schema_version", "generator", "graph", "nodes", "edges", "diagnostics", "extensions")


def read_extensions(spark: SparkSession, path: str) -> dict:
    """What a JSON graph file holds under ``extensions`` and under names that are not of the envelope."""
    top = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rest = F.map_filter("m", lambda k, v: (k == "extensions") | ~k.isin(*_ENVELOPE))
    found = top.select(F.map_entries(rest).alias("e")).first()
    out: dict = {}
    for name, value in sorted((found["e"] if found and found["e"] else []), key=lambda e: e[0] != "extensions"):
        try:
            value = json.loads(value) if value is not None else None
        except ValueError:
            pass  # plain text
        out |= value if name == "extensions" and isinstance(value, dict) else {} if name == "extensions" else {name: value}
    return out


def shape_findings(spark: SparkSession, path: str) -> DataFrame:
    """Errors (severity, kind, ord, message) of a JSON graph file that tables can't show: nodes or edges that are no list or no objects, sources of nodes that are no objects."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    found = None
    for part in ("nodes", "edges"):
        held = whole.select(F.try_variant_get("v", f"$.{part}", "variant").alias("held")).where("held IS NOT NULL")
        listed = held.where(F.schema_of_variant("held").startswith("ARRAY"))
        no_list = held.where(~F.schema_of_variant("held").startswith("ARRAY")).select(F.lit(None).cast("long").alias("ord"), F.lit(f"{part}_shape").alias("kind"), say("no_list", part).alias("message"))
        each = listed.select(F.posexplode(F.try_variant_get("held", "$", "array<variant>")).alias("ord", "x"))
        kind = F.coalesce(F.schema_of_variant("x"), F.lit("VOID"))
        at = F.concat(F.lit(f"{part}["), F.col("ord").cast("string"), F.lit("]"))
        no_object = each.where(~kind.startswith("OBJECT")).select(F.col("ord").cast("long").alias("ord"), F.lit(f"{part}_shape").alias("kind"), say("no_object", at).alias("message"))
        rows = no_list.unionByName(no_object)
        if part == "nodes":
            source = F.try_variant_get("x", "$.source", "variant")
            id_ = F.try_variant_get("x", "$.id", "string")
            text = F.coalesce(F.try_variant_get("x", "$.source", "string"), F.lit("x"))
            odd = kind.startswith("OBJECT") & source.isNotNull() & ~F.schema_of_variant(source).startswith("OBJECT") & ~text.isin("", "0", "false", "[]") & (F.schema_of_variant(source) != "VOID")
            rows = rows.unionByName(each.where(odd & (F.coalesce(id_, F.lit("")) != "")).select(F.col("ord").cast("long").alias("ord"), F.lit("source_shape").alias("kind"), say("no_source", F.concat(F.lit("'"), id_, F.lit("'"))).alias("message")))
        found = rows if found is None else found.unionByName(rows)
    return found.select(F.lit("error").alias("severity"), "kind", "ord", "message")
