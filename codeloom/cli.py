"""Command line: scan a project, write its reports and print a summary."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import reachability
from .plans.project import scan
from .sources import sinks
from .sources.diff import load_diff


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    p.add_argument("path")
    p.add_argument("--target-nodes", "-t", nargs="*", default=[], help="node ids whose connected part is reported")
    p.add_argument("--no-lazy-load", action="store_true", help="report all of the graph even with target nodes")
    p.add_argument("--framework", "-f", default="auto", choices=["auto", "django", "flask", "fastapi", "generic"])
    p.add_argument("--trace-depth", type=int, default=4)
    p.add_argument("--impact-diff", help="a diff, its file, or - for standard input")
    p.add_argument("--impact-depth", type=int, default=6)
    p.add_argument("--out", default=".", help="folder of the reports")
    p.add_argument("--format", default="parquet", choices=["parquet", "json"], help="tables as Parquet, or JSON files")
    a = p.parse_args(args)
    if not Path(a.path).is_dir():
        p.error(f"{a.path} is not a folder")
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    whole = scan(spark, str(Path(a.path).resolve()), a.framework)
    part = whole if a.no_lazy_load else whole.focused(a.target_nodes)
    out = Path(a.out)
    out.mkdir(parents=True, exist_ok=True)
    ledgers = part.ledgers(a.trace_depth)
    classes, clusters = part.reachability(), part.clusters()
    if a.format == "json":
        sinks.write_graph_json(part.nodes, part.edges, str(out / "graph.json"), findings=part.diagnostics())
        sinks.write_ledger_json(ledgers, str(out / "ledger.json"))
        sinks.write_keyed_json(ledgers, str(out / "ledger_enhanced.json"), "root")
        sinks.write_keyed_json(clusters, str(out / "semantic_clusters.json"), "id")
        sinks.write_rows_json(classes, str(out / "reachability.json"), "id")
    else:
        tables = {"nodes": part.nodes, "edges": part.edges, "findings": part.diagnostics(), "ledgers": ledgers, "semantic_clusters": clusters, "reachability": classes}
        sinks.write_parquet(tables, str(out))
    unused = [r.id for r in reachability.possibly_unreachable(classes).orderBy("id").toLocalIterator()]
    print(f"framework {part.framework}: {part.nodes.count()} nodes, {part.edges.count()} edges, {ledgers.count()} ledgers, {len(unused)} possibly unreachable")
    for node in unused:
        print(f"  {node}")
    if a.impact_diff:
        diff, root = load_diff(a.impact_diff), str(Path(a.path).resolve())
        if a.format == "json":
            report = part.impact_report(diff, root, a.impact_depth)
            sinks.write_sections_json(report, str(out / "change_impact.json"))
            changed, hit = report["changed_nodes"][0], report["impacted_nodes"][0]
        else:
            report = part.impact(diff, root, a.impact_depth)
            sinks.write_parquet({f"impact_{name}": df for name, df in report.items()}, str(out))
            changed, hit = report["changed"], report["impacted"]
        print(f"impact: {changed.count()} changed, {hit.count()} impacted nodes")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
