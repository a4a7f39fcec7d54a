"""Ledgers: paths and flattened traces in notation, path statistics and graph slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import numbered
from ..functions.notation import HTTP, annotation, diagram, role_of, step
from ..schema import TERMINAL_TYPES, TRACE_PRIORITY
from ..storage import materialize
from .normalize import rank_edges
from .traverse import _SHOWN, node_facts

_HTTP_NOTE = "{ₘ%s,ᴱ^%s,ᵏ^%s}" % (HTTP["mass"], HTTP["energy"], HTTP["coupling"])


def number_paths(paths: DataFrame) -> DataFrame:
    """Adds path_no and path_id (``path_001``), depth-first within each root."""
    n = F.row_number().over(Window.partitionBy("root").orderBy("sort_key"))
    return paths.withColumn("path_no", n).withColumn("path_id", numbered("path_", F.col("path_no")))


def render_paths(paths: DataFrame, interaction: str = "backend") -> DataFrame:
    """Adds trace (role, name, metadata), notation, legacy_notation and truncated to numbered paths (with their node_facts).

    A node's role comes from the last edge of its path that leads to it, so an
    edge that closes a cycle gives the role of its target. All within the row.
    """
    http = interaction == "backend"
    via = lambda node: F.get(F.filter(F.reverse("hops"), lambda h: h["target"] == node), F.lit(0))["type"]
    trace = F.transform("node_ids", lambda node, i: F.struct(role_of(via(node), F.get("node_facts", i)["kind"]).alias("role"), node.alias("name"), F.get("node_facts", i)["meta"].alias("metadata")))
    out = paths.withColumn("trace", trace)
    join = lambda note, head: F.concat(F.lit(head), F.array_join(F.transform("trace", lambda p: step(p["role"], p["name"], note(p))), " -> "))
    out = out.withColumns({
        "notation": join(lambda p: annotation(p["metadata"]), f"g[URL]{_HTTP_NOTE} -> " if http else ""), "legacy_notation": join(lambda _: F.lit(""), "g[URL] -> " if http else ""),
        "truncated": F.col("termination") == "max_depth",
    })
    if http:
        first = F.struct(*[F.lit(HTTP.get(k)).cast("double").alias(k) for k in _SHOWN])
        out = out.withColumn("trace", F.concat(F.array(F.struct(F.lit("PROPAGATOR_HTTP").alias("role"), F.lit("URL").alias("name"), first.alias("metadata"))), "trace"))
    return out.drop("node_facts")


def path_stats(paths: DataFrame) -> DataFrame:
    """Per root: path_count, branching, truncated and cycle counts."""
    n = F.count("*")
    return paths.groupBy("root").agg(n.alias("path_count"), (n > 1).alias("branching"), F.count_if(F.col("termination") == "max_depth").alias("truncated_path_count"), F.count_if(F.col("termination") == "cycle").alias("cycle_path_count"))


def ledger(rendered: DataFrame) -> DataFrame:
    """One row per root: all its paths in both notations, a line each."""
    line = lambda c: F.concat(F.lit("PATH "), F.col("path_no").cast("string"), F.lit(": "), F.col(c))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_no", line(c).alias("l")))), lambda x: x["l"]), "\n")
    return rendered.groupBy("root").agg(join("legacy_notation").alias("legacy"), join("notation").alias("notation"), F.count("*").alias("path_count"))


def slice_nodes(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct nodes of each root's paths; unknown ids as UNKNOWN."""
    ids = paths.select("root", F.explode("node_ids").alias("node")).distinct()
    return ids.join(node_facts(nodes), "node", "left").select("root", F.col("node").alias("id"), F.coalesce("kind", F.lit("UNKNOWN")).alias("type"))


def slice_edges(paths: DataFrame) -> DataFrame:
    """Distinct edges of each root's paths."""
    return paths.select("root", F.explode("hops").alias("h")).select("root", "h.source", "h.target", "h.type").distinct()


def trace_flat(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 4) -> DataFrame:
    """The flattened trace: every visit of a depth-first walk as a row (root, pos, node, role, metadata), pos from 1.

    A path does not come back into itself; siblings may repeat a node. Terminal
    types and unknown targets are visited and not followed.
    """
    facts = node_facts(nodes)
    steps = rank_edges(edges.select("edge_idx", "source", "target", "type"), TRACE_PRIORITY[:-1]).where("coalesce(target, '') <> ''")
    steps = steps.join(facts, F.col("target") == F.col("node"), "left")
    steps = materialize(steps.select(F.col("source").alias("from"), "target", F.col("type").alias("via"), "rank", F.col("kind").alias("to_kind"), F.col("meta").alias("to_meta")), "trace-steps")
    state = roots.select("root").distinct().join(facts, F.col("root") == F.col("node"), "left")
    state = state.select("root", F.col("root").alias("at"), F.array("root").alias("seen"), F.array().cast("array<int>").alias("sort_key"), role_of(F.lit(None).cast("string"), F.col("kind")).alias("role"), "meta", F.lit(True).alias("open"))
    levels = [materialize(state, "trace")]
    for _ in range(max_depth):
        state = levels[-1].where("open")
        if state.isEmpty():
            break
        joined = state.drop("role", "meta", "open").join(steps, F.col("at") == F.col("from")).where(~F.array_contains("seen", F.col("target")))
        state = joined.select(
            "root", F.col("target").alias("at"), F.concat("seen", F.array("target")).alias("seen"), F.concat("sort_key", F.array("rank")).alias("sort_key"),
            role_of(F.col("via"), F.col("to_kind")).alias("role"), F.col("to_meta").alias("meta"), (F.col("to_kind").isNotNull() & ~F.col("to_kind").isin(*TERMINAL_TYPES)).alias("open"),
        )
        levels.append(materialize(state, "trace"))
    visits = reduce(DataFrame.unionByName, [level.drop("seen", "open") for level in levels])
    pos = F.row_number().over(Window.partitionBy("root").orderBy("sort_key"))
    return visits.select("root", pos.alias("pos"), F.col("at").alias("node"), "role", F.col("meta").alias("metadata"))


def flat_ledger(visits: DataFrame, interaction: str = "backend") -> DataFrame:
    """One row per root: the flattened trace in notation, with its length, complexity, energy and coupling."""
    http = interaction == "backend"
    note = step(F.col("role"), F.col("node"), annotation(F.col("metadata")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", note.alias("n")))), lambda x: x["n"]), " -> ")
    m = lambda k, d: F.coalesce(F.col(f"metadata.{k}"), F.lit(d))
    add = HTTP if http else {"mass": 0.0, "energy": 0.0, "coupling": 0.0}
    out = visits.groupBy("root").agg(joined.alias("body"), F.count("*").alias("n"), F.sum(m("mass", 1.0)).alias("mass"), F.sum(m("energy", 0.5)).alias("energy"), F.max(m("coupling", 0.5)).alias("coupling"))
    head = f"g[URL]{_HTTP_NOTE} -> " if http else ""
    return out.select("root", F.concat(F.lit(head), "body").alias("notation"), (F.col("n") + int(http)).alias("trace_length"), (F.col("mass") + add["mass"]).alias("complexity"), (F.col("energy") + add["energy"]).alias("energy"), F.greatest(F.col("coupling"), F.lit(add["coupling"])).alias("coupling"))


def minimal_ledger(nodes: DataFrame) -> DataFrame:
    """Each view as ``g[URL] -> V[id]``."""
    return nodes.where("type = 'VERTEX'").select("id", F.concat(F.lit("g[URL] -> "), step(F.lit("VERTEX"), F.col("id"))).alias("notation"))


def minimal_ledger_with_metadata(nodes: DataFrame) -> DataFrame:
    """Each view after its request: id, notation with properties, diagram, interaction_type, complexity, energy and coupling."""
    seen = node_facts(nodes).where("kind = 'VERTEX'")
    first = F.struct(*[F.lit(HTTP.get(k)).cast("double").alias(k) for k in _SHOWN])
    steps = F.array(F.struct(F.lit("PROPAGATOR_HTTP").alias("role"), F.lit("URL").alias("name"), first.alias("metadata")), F.struct(F.lit("VERTEX").alias("role"), F.col("node").alias("name"), F.col("meta").alias("metadata")))
    m = lambda k, d: F.coalesce(F.col(f"meta.{k}"), F.lit(d))
    return seen.select(
        F.col("node").alias("id"), F.concat(F.lit(f"g[URL]{_HTTP_NOTE} -> "), step(F.lit("VERTEX"), F.col("node"), annotation(F.col("meta")))).alias("notation"), diagram(steps).alias("diagram"),
        F.lit("backend").alias("interaction_type"), (m("mass", 1.0) + HTTP["mass"]).alias("complexity"), (m("energy", 0.5) + HTTP["energy"]).alias("energy"), F.greatest(m("coupling", 0.5), F.lit(HTTP["coupling"])).alias("coupling"),
    )


def ghosts(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """Ids of nodes that no ledger (``used.name``) shows."""
    return nodes.select("id").distinct().join(used.select(F.col("name").alias("id")).distinct(), "id", "left_anti")
