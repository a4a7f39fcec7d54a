"""From a project folder to its reports: graph, ledgers, clusters, reachability and impact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frameworks, impact, pyast, reachability, resolve, semantic, trace, traverse, validate
from ..sources.diff import changed_lines, diff_lines
from ..sources.tree import read_tree
from ..storage import materialize
from ..texts import SENTENCES


@dataclass
class Project:
    framework: str
    nodes: DataFrame
    edges: DataFrame

    def focused(self, targets: list[str]) -> Project:
        """The part that is connected with ``targets``; all of it without targets."""
        if not targets:
            return self
        ids = self.nodes.sparkSession.createDataFrame([(t,) for t in targets], "id string")
        return Project(self.framework, *traverse.subgraph(self.nodes, self.edges, ids))

    def ledgers(self, depth: int = 4) -> DataFrame:
        """(root, legacy, notation, path_count) of every view and template."""
        out = None
        for kind, interaction in (("VERTEX", "backend"), ("FRONTEND", "frontend")):
            roots = self.nodes.where(F.col("type") == kind).select(F.col("id").alias("root"))
            paths = trace.number_paths(traverse.enumerate_paths(self.nodes, self.edges, roots, depth, with_facts=True))
            part = trace.ledger(trace.render_paths(paths, interaction))
            out = part if out is None else out.unionByName(part)
        return out

    def clusters(self) -> DataFrame:
        return semantic.clusters(semantic.profiles(self.nodes, self.edges))

    def reachability(self) -> DataFrame:
        return reachability.classify(self.nodes, self.edges)

    def diagnostics(self) -> DataFrame:
        return validate.validate(self.nodes, self.edges)

    def impact(self, diff: str, root: str = "", depth: int = 6) -> dict[str, DataFrame]:
        """changes, changed, impacted, paths, quality and confidence tables of a diff."""
        changes = materialize(changed_lines(diff_lines(self.nodes.sparkSession, diff)), "changes")
        seeds = materialize(impact.seeds(self.nodes, changes, root), "seeds")
        paths = traverse.impact_paths(self.edges, seeds, depth)
        hit = materialize(impact.impacted(self.nodes, paths, seeds), "impacted")
        quality = materialize(impact.quality(self.nodes, self.edges, seeds, changes, hit), "quality")
        return {"changes": changes, "changed": seeds, "impacted": hit, "paths": impact.describe(paths), "quality": quality, "confidence": impact.report_confidence(seeds, hit, quality)}

    def impact_report(self, diff: str, root: str = "", depth: int = 6) -> dict[str, tuple[DataFrame, str] | object]:
        """The sections of one report: changed files, changed and impacted nodes, all paths, risk, quality and what the report is."""
        t = self.impact(diff, root, depth)
        about = {"purpose": SENTENCES["purpose"], "direction": "reverse_dependencies", "max_depth": depth, "confidence_model": SENTENCES["model"]}
        paths = t["paths"].withColumn("order", F.struct("node", -F.col("confidence")))
        return {
            "changed_files": (t["changes"].drop("diff"), "path"), "changed_nodes": (t["changed"], "seed"), "impacted_nodes": (t["impacted"], "node"), "impact_paths": (paths, "order"),
            "risk_summary": impact.risk_summary(t["changed"], t["impacted"], t["quality"], depth), "graph_quality": t["quality"].first().asDict(), "metadata": about,
        }


def scan(spark: SparkSession, root: str, framework: str = "auto") -> Project:
    """The graph of the project in ``root``; ``auto`` detects its framework. Every Python file is parsed once."""
    if framework != "auto":
        frameworks.get(framework)
    files = materialize(read_tree(spark, root), "files")
    facts = materialize(pyast.python_facts(files), "facts")
    if framework == "auto":
        found = frameworks.detect(files, facts.select("rel_path", F.col("all_imports").alias("imports"), "called", F.col("all_decorators").alias("decorators"))).first()
        framework = found["framework"]
    nodes, edges = resolve.build_graph(files, facts, frameworks.get(framework))
    return Project(framework, materialize(nodes, "nodes"), materialize(edges, "edges"))
