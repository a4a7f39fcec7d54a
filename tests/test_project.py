"""A whole project through the command line, and diffs as a stream."""

from __future__ import annotations

import json
import re

from codeloom import cli
from codeloom.operators.normalize import normalize_edges, normalize_nodes
from codeloom.operators.validate import validate
from codeloom.plans.project import scan
from codeloom.sources.sinks import write_graph_json
from codeloom.sources.tree import read_extensions, read_graph_json, shape_findings
from codeloom.streaming.diffs import impact_stream, read_diffs

MODELS = "from django.db import models\n\n\nclass User(models.Model):\n    name = models.CharField()\n"
VIEWS = "from app.models import User\n\n\nclass UserView:\n    model = User\n\n\ndef lonely():\n    pass\n"


def write(root):
    for path, text in (("manage.py", "import django\n"), ("app/models.py", MODELS), ("app/views.py", VIEWS), ("app/t.html", "{{ user.name }}"), ("venv/x.py", "def hidden(): pass\n")):
        (root / path).parent.mkdir(exist_ok=True, parents=True)
        (root / path).write_text(text)


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path / "p")
    diff = "--- a/app/models.py\n+++ b/app/models.py\n@@ -5,1 +5,1 @@\n-x\n+y\n"
    assert cli.main([str(tmp_path / "p"), "--out", str(tmp_path / "out"), "--format", "json", "--impact-diff", diff]) == 0
    assert "framework django" in capsys.readouterr().out
    ledger = json.loads((tmp_path / "out/ledger.json").read_text())
    assert ledger["python:app.views.UserView"] == "PATH 1: g[URL] -> V[python:app.views.UserView] -> P[python:app.models.User]"
    report = json.loads((tmp_path / "out/change_impact.json").read_text())
    assert list(report) == ["changed_files", "changed_nodes", "impacted_nodes", "impact_paths", "risk_summary", "graph_quality", "metadata"]
    assert [r["id"] for r in report["impacted_nodes"]] == ["python:app.views.UserView"] and report["risk_summary"]["impacted_by_type"] == {"VERTEX": 1}
    assert report["metadata"]["max_depth"] == 6 and [r["node"] for r in report["impact_paths"]] == ["python:app.views.UserView"]
    enhanced = json.loads((tmp_path / "out/ledger_enhanced.json").read_text())
    assert enhanced["python:app.views.UserView"]["path_count"] == 1 and isinstance(json.loads((tmp_path / "out/semantic_clusters.json").read_text()), dict)
    check_contract(json.loads((tmp_path / "out/graph.json").read_text()))
    nodes, edges = read_graph_json(spark, str(tmp_path / "out/graph.json"))
    again = {r.id for r in normalize_nodes(nodes).collect()}
    assert "python:app.models.User" in again and not any("hidden" in x for x in again)
    assert normalize_edges(edges).count() == edges.count()
    assert cli.main([str(tmp_path / "p"), "--out", str(tmp_path / "tables"), "--impact-diff", diff]) == 0
    assert spark.read.parquet(str(tmp_path / "tables/nodes")).count() == nodes.count() and spark.read.parquet(str(tmp_path / "tables/impact_impacted")).count() == 1


# What the exchange format requires.
ENVELOPE = ["schema", "schema_version", "generator", "graph", "nodes", "edges", "diagnostics", "extensions"]
NODE = ["id", "name", "qualified_name", "type", "language", "file", "source", "metadata", "attributes", "line_start", "line_end"]
EDGE = ["id", "source", "target", "type", "confidence", "evidence", "attributes", "resolution", "line"]


def check_contract(graph):
    assert list(graph) == ENVELOPE and graph["schema"].endswith(".graph") and re.fullmatch(r"1\.\d+\.\d+", graph["schema_version"])
    assert set(graph["generator"]) == {"name", "version"} and graph["graph"] == {"directed": True, "multigraph": True, "node_count": len(graph["nodes"]), "edge_count": len(graph["edges"])}
    for node in graph["nodes"]:
        assert set(node) == set(NODE) and node["id"] and {"file", "line_start", "line_end"} <= set(node["source"]) and isinstance(node["metadata"], dict) and isinstance(node["attributes"], dict)
    for edge in graph["edges"]:
        assert set(edge) == set(EDGE) and edge["id"] and (edge["confidence"] is None or 0 <= edge["confidence"] <= 1) and isinstance(edge["evidence"], list)
    d = graph["diagnostics"]
    assert d["valid"] == (not d["errors"]) and (d["error_count"], d["warning_count"]) == (len(d["errors"]), len(d["warnings"]))


def test_envelope_round_trip(spark, tmp_path):
    graph = {
        "schema": "x.graph", "schema_version": "1.0.0", "owner": "team", "extensions": {"kept": [1, 2]},
        "nodes": [
            {"id": "a.b", "source": {"file": "src/a.py", "line_start": 3}, "metadata": {"mass": 0.5, "colour": "red"}, "flag": True},
            {"id": "c", "file": "src/c.py", "line_start": 7, "line_end": 9, "type": "ODD"},
        ],
        "edges": [{"source": "a.b", "target": "gone", "type": "CALL", "confidence": 1.7, "evidence": ["x"], "weight": 2}],
    }
    (tmp_path / "in.json").write_text(json.dumps(graph))
    read = lambda name: [normalize(df) for normalize, df in zip((normalize_nodes, normalize_edges), read_graph_json(spark, str(tmp_path / name)), strict=True)]
    nodes, edges = read("in.json")
    first = nodes.where("id = 'a.b'").first()
    assert (first.file, first.name, first.line_start, first.source.line_start, first.metadata.file) == ("src/a.py", "b", None, 3, "src/a.py")
    assert first.attributes == {"flag": "true"} and first.metadata_extra == {"colour": '"red"'}
    extensions = read_extensions(spark, str(tmp_path / "in.json"))
    assert extensions == {"kept": [1, 2], "owner": "team"}
    write_graph_json(nodes, edges, str(tmp_path / "out.json"), findings=validate(nodes, edges), extensions=extensions)
    written = json.loads((tmp_path / "out.json").read_text())
    check_contract(written)
    assert written["nodes"][0]["metadata"]["colour"] == "red" and written["nodes"][0]["attributes"] == {"flag": True} and written["edges"][0]["attributes"] == {"weight": 2}
    assert written["diagnostics"]["warning_count"] == 2 and written["extensions"] == extensions
    again = read("out.json")
    keep = [c for c in nodes.columns if c not in ("metadata", "metadata_extra", "attributes")]
    assert sorted(map(repr, again[0].select(keep).collect())) == sorted(map(repr, nodes.select(keep).collect()))
    assert [(r.id, r.confidence) for r in again[1].collect()] == [(r.id, 1.0) for r in edges.collect()]
    text = spark.createDataFrame([(0, "a", "b", "CALL", "0.9")], "edge_idx long, source string, target string, type string, confidence string")
    assert normalize_edges(text).first().confidence is None


def test_shapes_of_graph_files(spark, tmp_path):
    def found(graph):
        (tmp_path / "g.json").write_text(json.dumps(graph))
        return sorted(r.message for r in shape_findings(spark, str(tmp_path / "g.json")).collect())

    assert found({"nodes": {"a": 1}, "edges": "none"}) == ["edges must be a list", "nodes must be a list"]
    odd = {"nodes": [{"id": "a", "source": "file.py"}, 3, None, {"id": "b", "source": {}}, {"id": "c", "source": None}], "edges": [[], {"source": "a"}]}
    assert found(odd) == ["edges[0] must be an object", "node 'a'.source must be an object", "nodes[1] must be an object", "nodes[2] must be an object"]
    assert found({}) == found({"nodes": [], "edges": []}) == []


def test_diffs_as_a_stream(spark, tmp_path):
    write(tmp_path / "p")
    project = scan(spark, str(tmp_path / "p"))
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "two.diff").write_text("--- a/app/views.py\n+++ b/app/views.py\n@@ -4,1 +4,1 @@\n-x\n+y\n")
    (drop / "one.diff").write_text("--- a/app/models.py\n+++ b/app/models.py\n@@ -5,1 +5,1 @@\n-x\n+y\n")
    impact_stream(read_diffs(spark, str(drop)), project.nodes, project.edges, str(tmp_path / "hits"), str(tmp_path / "cp"), str(tmp_path / "p")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "hits")).collect()
    assert [(r.diff, r.id, r.impact_status) for r in got] == [("one.diff", "python:app.views.UserView", "strong_candidate")]
