"""Semantic profiles and clusters of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions.ids import numbered
from ..storage import materialize
from .normalize import latest_nodes
from .ranges import global_prefix, shuffle_partitions


def profiles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, type, tokens, subjects, intent, role, edge_types and evidence of nodes of the profiled types."""
    base = latest_nodes(nodes.where(F.col("type").isin(*S.PROFILED_TYPES)).select("id", "node_idx", "type"))
    linked = edges.groupBy(F.col("source").alias("id")).agg(
        F.array_sort(F.collect_set("type")).alias("edge_types"),
        F.collect_set(F.when((F.col("type") == "PARTICLE_ENTANGLEMENT") & (F.coalesce(F.col("target"), F.lit("")) != ""), S.subject(F.col("target")))).alias("linked"),
    )
    df = base.join(linked, "id", "left").withColumn("tokens", S.tokens(F.col("id")))
    linked_, id_, kind = F.coalesce("linked", F.array().cast("array<string>")), F.col("id"), F.col("type")
    none = F.array().cast("array<string>")
    bare = S.strip_suffix(id_, S.VIEW_SUFFIXES)
    own = (
        F.when(kind == "PARTICLE", F.array(S.subject(id_)))
        .when((kind == "TRANSFORM") & (F.size(linked_) == 0), F.array(S.subject(S.strip_suffix(id_, ("Serializer", "Schema")))))
        .when(~kind.isin("PARTICLE", "TRANSFORM") & (F.size(linked_) == 0) & (bare != id_) & (bare != ""), F.array(S.subject(bare)))
        .otherwise(none)
    )
    subjects = F.array_sort(F.filter(F.array_union(linked_, own), lambda s: (s != "") & ~F.lower(s).isin(*S.INTENTS)))
    df = df.withColumn("subjects", subjects).withColumn("intent", S.intent(id_, kind, F.col("tokens")))
    df = df.withColumn("role", S.role(kind, F.col("intent"), F.size("subjects") > 0))
    evidence = F.array_compact(F.array(
        F.when(F.size("subjects") > 0, F.concat(F.lit("data_subjects="), F.array_join("subjects", ","))),
        F.when(F.col("intent") != "generic", F.concat(F.lit("intent="), "intent")),
        F.when(F.col("edge_types").isNotNull(), F.concat(F.lit("edges="), F.array_join("edge_types", ","))),
    ))
    return df.select("id", "type", "tokens", "subjects", "intent", "role", F.coalesce("edge_types", none).alias("edge_types"), evidence.alias("evidence"))


def _keys() -> Column:
    by_subject = F.transform("subjects", lambda s: F.struct(F.concat(F.lit("data:"), s).alias("scope"), F.col("role").alias("role")))
    flow = F.when(F.col("role") == "crud_interface", F.transform("subjects", lambda s: F.struct(F.concat(F.lit("data:"), s).alias("scope"), F.lit("data_workflow").alias("role"))))
    by_tokens = F.array(F.struct(F.concat(F.lit("tokens:"), F.array_join(F.slice("tokens", 1, 2), "-")).alias("scope"), F.col("role").alias("role")))
    return F.when(F.size("subjects") > 0, F.concat(by_subject, F.coalesce(flow, F.array().cast(flow_type)))).when(F.size("tokens") > 0, by_tokens)


flow_type = "array<struct<scope:string,role:string>>"


def members(profiled: DataFrame) -> DataFrame:
    """(scope, role, id, ...) of every cluster key of every profile."""
    keyed = profiled.withColumnRenamed("role", "own_role").withColumn("role", F.col("own_role")).withColumn("k", F.explode(_keys()))
    return keyed.select(F.col("k.scope").alias("scope"), F.col("k.role").alias("role"), "id", "type", "intent", "subjects", "evidence")


def clusters(profiled: DataFrame) -> DataFrame:
    """Groups of two or more: id, scope, role, members, data_subjects, intents, node_types, confidence, summary.

    Numbered by scope and role (not by the order in which members appear).
    """
    g = members(profiled).groupBy("scope", "role").agg(
        F.array_sort(F.collect_set("id")).alias("members"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("subjects")))).alias("data_subjects"),
        F.array_sort(F.collect_set("intent")).alias("intents"), F.array_sort(F.collect_set("type")).alias("node_types"), F.bool_or(F.size("evidence") > 0).alias("shown"),
    ).where(F.size("members") >= 2)
    score = F.lit(0.5) + F.when(F.size("data_subjects") > 0, 0.25).otherwise(0.0) + F.when((F.size("node_types") == 1) | (F.size("intents") <= 2), 0.15).otherwise(0.0) + F.when(F.col("shown"), 0.1).otherwise(0.0)
    about = F.when(F.size("data_subjects") > 0, F.array_join("data_subjects", ", ")).otherwise(F.col("scope"))
    text = F.concat(F.initcap(F.replace("role", F.lit("_"), F.lit(" "))), F.lit(" around "), about, F.lit(" ("), F.array_join("intents", ", "), F.lit(")"))
    g = global_prefix(materialize(g.withColumn("one", F.lit(1)), "clusters"), ["scope", "role"], "one", "no", shuffle_partitions(profiled.sparkSession))
    return g.select(numbered("semantic_cluster_", F.col("no")).alias("id"), "scope", "role", "members", "data_subjects", "intents", "node_types", F.round(F.least(score, F.lit(0.95)), 2).alias("confidence"), text.alias("summary"))


def memberships(grouped: DataFrame) -> DataFrame:
    """(node, cluster ids) of clusters."""
    return grouped.select("id", F.explode("members").alias("node")).groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("clusters"))


def annotate(ledger: DataFrame, grouped: DataFrame, key: str = "root", fields: tuple[str, ...] = ("id", "summary", "confidence")) -> DataFrame:
    """Ledger rows with the clusters (their ``fields``, in order of those) of their node and their number.

    Sorted and merged, never broadcast: a cluster's summary is repeated for each of its members, which is many times
    what the planner takes the (well compressed) clusters for, and would pass through the driver.
    """
    own = grouped.select(F.explode("members").alias("node"), F.struct(*fields).alias("c")).groupBy("node").agg(F.array_sort(F.collect_list("c")).alias("semantic_clusters"))
    return ledger.join(own.hint("merge"), F.col(key) == F.col("node"), "left").drop("node").withColumn("semantic_cluster_count", F.coalesce(F.size("semantic_clusters"), F.lit(0)))
