"""Traversals: paths level by level, breadth-first search by rounds, closures by components.

A level of paths is one join of the paths that go on with the edges out of
their ends; it is written to shared storage, paths that end there are set
aside, and only the others take part in the next one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import edge_confidence
from ..schema import DEPENDENCY_EDGES, TERMINAL_TYPES, TRACE_PRIORITY
from ..storage import materialize
from .components import connected_components
from .normalize import latest_nodes, rank_edges

_HOP = "array<struct<source:string,target:string,type:string>>"
_SHOWN = ("mass", "charge", "spin", "energy", "coupling", "lifetime")


def node_facts(nodes: DataFrame) -> DataFrame:
    """(node, kind, meta): type and shown properties of each id."""
    have = nodes.schema["metadata"].dataType.names if "metadata" in nodes.columns else []
    meta = F.struct(*[(F.col(f"metadata.{k}") if k in have else F.lit(None)).cast("double").alias(k) for k in _SHOWN])
    return latest_nodes(nodes.select("id", "node_idx", "type", meta.alias("meta"))).select(F.col("id").alias("node"), F.col("type").alias("kind"), "meta")


def enumerate_paths(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 4, *, with_facts: bool = False) -> DataFrame:
    """All root-to-leaf paths of each ``roots.root``: root, node_ids, hops, sort_key, termination, cycle_to.

    A path ends at a terminal type, a node without edges (leaf), the depth
    limit, or an edge back into itself (cycle: the closing edge is kept, its
    target is not repeated). Edges to blank targets are not followed.
    ``sort_key`` (ranks of the edges taken) orders a root's paths depth-first. ``with_facts`` adds node_facts: (kind, meta) of each of node_ids.
    """
    facts = node_facts(nodes) if with_facts else latest_nodes(nodes.select("id", "node_idx", "type")).select(F.col("id").alias("node"), F.col("type").alias("kind"))
    fact = F.struct(*[c for c in facts.columns if c != "node"])
    steps = rank_edges(edges.select("edge_idx", "source", "target", "type"), TRACE_PRIORITY).join(facts, F.col("target") == F.col("node"), "left")
    steps = materialize(steps.select(F.col("source").alias("from"), "target", "type", "rank", F.col("kind").alias("target_kind"), fact.alias("target_fact")), "path-steps")
    state = roots.select("root").distinct().join(facts, F.col("root") == F.col("node"), "left")
    ended = F.when(F.col("kind").isin(*TERMINAL_TYPES), "terminal")
    kept = ["root", "node_ids", *["node_facts"] * with_facts, "hops", "sort_key", "termination", "cycle_to"]
    state = state.select("root", F.array("root").alias("node_ids"), F.array(fact).alias("node_facts"), F.array().cast(_HOP).alias("hops"), F.array().cast("array<int>").alias("sort_key"), ended.alias("termination"), F.lit(None).cast("string").alias("cycle_to"), F.col("root").alias("at"))
    state = materialize(state.select(*kept, "at"), "paths")
    done = [state.where("termination IS NOT NULL")]
    for _ in range(max_depth):
        state = state.where("termination IS NULL")
        if state.isEmpty():
            break
        joined = state.join(steps, F.col("at") == F.col("from"), "left").where(F.col("from").isNull() | (F.coalesce(F.col("target"), F.lit("")) != ""))
        moved, back = F.col("from").isNotNull(), F.array_contains("node_ids", F.col("target"))
        onward = moved & ~F.coalesce(back, F.lit(False))
        hop = F.array(F.struct(F.col("from").alias("source"), "target", "type"))
        columns = {
            "node_ids": F.when(onward, F.concat("node_ids", F.array("target"))).otherwise(F.col("node_ids")),
            "hops": F.when(moved, F.concat("hops", hop)).otherwise(F.col("hops")),
            "sort_key": F.when(moved, F.concat("sort_key", F.array("rank"))).otherwise(F.col("sort_key")),
            "termination": F.when(~moved, "leaf").when(back, "cycle").when(F.col("target_kind").isin(*TERMINAL_TYPES), "terminal"),
            "cycle_to": F.when(moved & back, F.col("target")),
            "at": F.when(onward, F.col("target")).otherwise(F.col("at")),
        }
        if with_facts:
            columns["node_facts"] = F.when(onward, F.concat("node_facts", F.array("target_fact"))).otherwise(F.col("node_facts"))
        state = materialize(joined.select("root", *[c.alias(k) for k, c in columns.items()]).select(*kept, "at"), "paths")
        done.append(state.where("termination IS NOT NULL"))
    leaves = steps.select("from").distinct().withColumn("goes_on", F.lit(True))
    last = state.where("termination IS NULL").join(leaves, F.col("at") == F.col("from"), "left")
    done.append(last.withColumn("termination", F.when(F.col("goes_on"), "max_depth").otherwise("leaf")))
    return reduce(DataFrame.unionByName, [d.select(kept) for d in done])


def impact_paths(edges: DataFrame, seeds: DataFrame, max_depth: int = 6, *, weighted: bool = True, least: float = 0.2, by: tuple[str, ...] = ()) -> DataFrame:
    """Every simple path against dependency edges from each seed (columns seed, confidence): seed, node, node_path, edge_path, depth, confidence.

    Each hop gives a row. Confidence is multiplied by the edge's and by 0.96 on
    the first hop, 0.92 on later ones, and rounded to 4 places; a path goes on
    while it is at least ``least``. Unweighted, every path goes on. ``by`` names columns of the seeds that go along.
    """
    sure = edge_confidence(F.col("confidence"), F.col("type"))
    back = edges.where(F.col("type").isin(*DEPENDENCY_EDGES) & (F.coalesce(F.col("source"), F.lit("")) != "")).select(
        F.col("target").alias("into"), F.struct("source", "target", "type", sure.alias("confidence"), "resolution").alias("edge")
    )
    back = materialize(back, "impact-edges")
    kind = back.schema["edge"].dataType.simpleString()
    state = seeds.select(*by, F.col("seed"), F.col("seed").alias("node"), F.array("seed").alias("node_path"), F.array().cast(f"array<{kind}>").alias("edge_path"), F.lit(0).alias("depth"), F.col("confidence").cast("double").alias("confidence"))
    levels = [state.limit(0)]
    for depth in range(max_depth):
        joined = state.join(back, F.col("node") == F.col("into")).where(~F.array_contains("node_path", F.col("edge.source")))
        next_ = F.round(F.col("confidence") * F.col("edge.confidence") * F.lit(0.96 if depth == 0 else 0.92), 4) if weighted else F.col("confidence")
        level = joined.select(
            *by, "seed", F.col("edge.source").alias("node"), F.concat("node_path", F.array("edge.source")).alias("node_path"), F.concat("edge_path", F.array("edge")).alias("edge_path"),
            F.lit(depth + 1).alias("depth"), next_.alias("confidence"),
        )
        level = materialize(level, "impact")
        levels.append(level)
        state = level.where(F.col("confidence") >= least) if weighted else level
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, owner_idx, owner, level) of every node that ``roots`` (id, node_idx) lead to over edges of any type.

    The owner is the root that a breadth-first search from all roots, in order,
    gets there from first: on each level the least of the owners that lead there.
    """
    links = materialize(edges.where("coalesce(target, '') <> ''").select("source", "target").distinct(), "reach-links")
    seen = materialize(roots.select("id", F.struct("node_idx", "id").alias("owner"), F.lit(0).alias("level")), "reach")
    frontier, level = seen, 0
    while True:
        level += 1
        found = frontier.join(links, F.col("id") == F.col("source")).groupBy("target").agg(F.min("owner").alias("owner"))
        fresh = found.join(seen.select("id"), F.col("target") == F.col("id"), "left_anti").select(F.col("target").alias("id"), "owner", F.lit(level).alias("level"))
        frontier = materialize(fresh, "reach")
        if frontier.isEmpty():
            return seen.select("id", F.col("owner.node_idx").alias("owner_idx"), F.col("owner.id").alias("owner"), "level")
        seen = seen.unionByName(frontier)


def closure(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Ids of everything connected with ``targets.id`` over edges in either direction, the targets included."""
    links = edges.select("source", "target").where("coalesce(source, '') <> '' AND coalesce(target, '') <> ''")
    roots = materialize(connected_components(links, "source", "target"), "closure-roots")
    ids = targets.select("id").distinct()
    met = roots.join(ids, F.col("node") == F.col("id"), "left_semi").select("root").distinct()
    return roots.join(met, "root", "left_semi").select(F.col("node").alias("id")).unionByName(ids).distinct()


def subgraph(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and (deduplicated) edges of the targets' closure; all of the graph without targets."""
    if targets.isEmpty():
        return nodes, edges
    ids = closure(edges, targets)
    firsts = edges.groupBy("source", "target", "type").agg(F.min("edge_idx").alias("edge_idx")).select("edge_idx")
    return nodes.join(ids, "id", "left_semi"), edges.join(ids, F.col("source") == ids["id"], "left_semi").join(firsts, "edge_idx", "left_semi")
