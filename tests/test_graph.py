"""Invariants of the graph operators on small hand-made graphs."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from codeloom.operators import impact, normalize, overview, reachability, semantic, trace, traverse, validate
from codeloom.plans.oracles import ORACLES
from codeloom.plans.queries import QUERIES
from codeloom.schema import GraphSchemaError
from codeloom.sources.diff import changed_lines, diff_lines

NODE = "node_idx long, id string, name string, type string, file string, line_start int, line_end int"
EDGE = "edge_idx long, source string, target string, type string, confidence double, resolution string"


def nodes_of(spark, *rows):
    full = [(i, r[0], r[0].split(".")[-1], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, r[4] if len(r) > 4 else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, NODE)


def edges_of(spark, *rows):
    return spark.createDataFrame([(i, r[0], r[1], r[2] if len(r) > 2 else "CALL", r[3] if len(r) > 3 else None, r[4] if len(r) > 4 else None) for i, r in enumerate(rows)], EDGE)


def paths_of(spark, nodes, edges, root, depth=4):
    found = trace.number_paths(traverse.enumerate_paths(nodes, edges, spark.createDataFrame([(root,)], "root string"), depth)).orderBy("path_no").collect()
    return [(r.node_ids, r.termination, r.cycle_to) for r in found]


def test_edge_ids_confidence_and_idempotence(spark):
    raw = spark.createDataFrame([(0, "a", "b", None, 1.7, True)], "edge_idx long, source string, target string, type string, confidence double, extra boolean")
    once = normalize.normalize_edges(raw)
    row = once.first()
    assert row.id == "edge:" + hashlib.sha256(b"a\x1fDEPENDENCY\x1fb").hexdigest()[:16]
    assert (row.type, row.confidence, row.evidence, row.attributes) == ("DEPENDENCY", 1.0, [], {"extra": "true"})
    assert normalize.normalize_edges(once).collect() == once.collect()


def test_node_defaults_spill_and_idempotence(spark):
    raw = spark.createDataFrame([(0, "python:app.view", "m.py", 3, True)], "node_idx long, id string, file string, line_start int, custom_flag boolean")
    once = normalize.normalize_nodes(raw)
    row = once.first()
    assert (row.name, row.type, row.metadata.file, row.metadata.line_start, row.attributes) == ("view", "UNKNOWN", "m.py", 3, {"custom_flag": "true"})
    assert normalize.normalize_nodes(once).collect() == once.collect()


def test_validation_and_strict(spark):
    nodes = nodes_of(spark, ("same", "VERTEX"), ("same", "ODD"), ("", "VERTEX"))
    edges = normalize.normalize_edges(edges_of(spark, ("same", "gone")))
    kinds = {(r.severity, r.kind) for r in validate.validate(nodes, edges).collect()}
    assert kinds == {("error", "duplicate_node"), ("error", "node_id"), ("warning", "node_type"), ("warning", "missing_target")}
    with pytest.raises(GraphSchemaError):
        validate.check_strict(nodes, edges)


def test_migration_and_compatibility(spark):
    normalize.check_migration("0.0.0", "1.0.0")
    with pytest.raises(GraphSchemaError):
        normalize.check_migration("2.0.0", "1.0.0")
    row = spark.range(1).select(normalize.compatibility(F.lit("0.0.0")).alias("c")).first().c
    assert row.compatible and row.requires_migration


def test_branches_and_diamond(spark):
    nodes = nodes_of(spark, ("view", "VERTEX"), ("left", "MEDIATOR"), ("right", "MEDIATOR"), ("model", "PARTICLE"))
    edges = edges_of(spark, ("view", "left"), ("view", "right"), ("left", "model"), ("right", "model"))
    assert paths_of(spark, nodes, edges, "view") == [(["view", "left", "model"], "terminal", None), (["view", "right", "model"], "terminal", None)]
    paths = traverse.enumerate_paths(nodes, edges, spark.createDataFrame([("view",)], "root string"))
    assert (trace.slice_nodes(paths, nodes).count(), trace.slice_edges(paths).count()) == (4, 4)


def test_cycle_depth_and_leaf(spark):
    nodes = nodes_of(spark, ("view", "VERTEX"), ("worker", "MEDIATOR"))
    assert paths_of(spark, nodes, edges_of(spark, ("view", "worker"), ("worker", "view")), "view", 10) == [(["view", "worker"], "cycle", "view")]
    nodes = nodes_of(spark, ("view", "VERTEX"), ("a", "MEDIATOR"), ("b", "MEDIATOR"))
    edges = edges_of(spark, ("view", "a"), ("a", "b"))
    assert paths_of(spark, nodes, edges, "view", 1) == [(["view", "a"], "max_depth", None)]
    assert paths_of(spark, nodes, edges, "b", 3) == [(["b"], "leaf", None)]
    assert paths_of(spark, nodes, edges, "unknown", 3) == [(["unknown"], "leaf", None)]


def test_reachability_classes(spark):
    nodes = nodes_of(
        spark, ("view", "VERTEX", "app/v.py"), ("service", "MEDIATOR", "app/s.py"), ("t", "MEDIATOR", "tests/test_o.py"), ("sig", "MEDIATOR", "accounts/signals.py"),
        ("on_handler", "MEDIATOR", "x.py"), ("old", "MEDIATOR", "legacy.py"), ("a", "MEDIATOR", "q.py"), ("b", "MEDIATOR", "q.py"), ("dependency:X", "DEPENDENCY"),
    )
    got = {r.id: r.classification for r in reachability.classify(nodes, edges_of(spark, ("view", "service"), ("a", "b"))).collect()}
    assert got == {
        "view": "http_entry_point", "service": "reachable", "t": "test_only", "sig": "framework_entry_point", "on_handler": "dynamic_reference_suspected",
        "old": "possibly_unreachable", "a": "isolated_root", "b": "unknown", "dependency:X": "external_or_unresolved",
    }


def test_reached_from_keeps_owners_of_sources(spark):
    nodes = nodes_of(spark, ("r1", "VERTEX"), ("r2", "VERTEX"), ("m", "MEDIATOR"), ("n", "MEDIATOR"))
    edges = edges_of(spark, ("r2", "m"), ("r1", "m"), ("m", "n"))
    got = {r.id: r.reached_from for r in reachability.classify(nodes, edges).collect()}
    assert got == {"r1": ["r1"], "r2": ["r2"], "m": ["r1", "r2"], "n": ["r1"]}


DIFF = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py
@@ -1,3 +1,4 @@
 one
-two
+two!
+more
 three
@@ -10 +11 @@
-x
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ -1,1 +0,0 @@
-bye
"""


def state_machine(text):
    files, current, old, line, seen = {}, None, None, None, False
    for raw in text.splitlines():
        clean = lambda p: p[2:] if p[:2] in ("a/", "b/") else p
        if raw.startswith("diff --git "):
            current = old = None
        elif raw.startswith("--- "):
            old = clean(raw[4:].strip())
        elif raw.startswith("+++ "):
            new = clean(raw[4:].strip())
            current = new if new != "/dev/null" else old
            files.setdefault(current, (set(), new == "/dev/null"))
        elif current is None:
            continue
        elif raw.startswith("@@ "):
            line, seen = int(raw.split("+")[1].split(" ")[0].split(",")[0]), True
        elif seen:
            if raw.startswith(("+", "-")) and not raw.startswith(("+++", "---")):
                files[current][0].add(line)
            line += not (raw.startswith("-") and not raw.startswith("---"))
    return {k: (sorted(v[0]), v[1]) for k, v in files.items()}


def test_diff_lines(spark):
    got = {r.path: (r.changed_lines, r.deleted) for r in changed_lines(diff_lines(spark, DIFF)).collect()}
    assert got == state_machine(DIFF) == {"m.py": ([2, 3, 11], False), "gone.py": ([0], True)}


def test_impact_confidences(spark):
    nodes = nodes_of(spark, ("model", "PARTICLE", "m.py", 1, 3), ("view", "VERTEX", "v.py", 1, 2), ("user", "MEDIATOR", "u.py", 1, 2), ("far", "MEDIATOR", "f.py", 1, 2))
    edges = edges_of(spark, ("view", "model", "PARTICLE_ENTANGLEMENT"), ("user", "model", "CALL", 0.4), ("far", "view", "CALL", 0.95, "qualified_import"), ("model", "far", "CONTAINS"))
    seeds = impact.seeds(nodes, changed_lines(diff_lines(spark, "--- a/m.py\n+++ b/m.py\n@@ -1,1 +1,1 @@\n-a\n+b\n")))
    assert [(r.seed, r.confidence) for r in seeds.collect()] == [("model", 1.0)]
    paths = traverse.impact_paths(edges, seeds)
    report = {r.id: (r.confidence, r.confidence_label, r.impact_status) for r in impact.impacted(nodes, paths, seeds).collect()}
    assert report == {"view": (0.941, "high", "strong_candidate"), "user": (0.384, "low", "possible_candidate"), "far": (0.822, "high", "strong_candidate")}
    note = [r.evidence for r in impact.describe(paths).where("node = 'far'").collect()][0]
    assert note == ["PARTICLE_ENTANGLEMENT edge with confidence 0.98", "CALL edge resolved as qualified_import with confidence 0.95"]


def test_seed_kinds_and_unmatched_files(spark):
    nodes = nodes_of(spark, ("in", "MEDIATOR", "src/m.py", 1, 2), ("next", "MEDIATOR", "src/m.py", 0, 10), ("after", "MEDIATOR", "src/m.py", 3, 4), ("off", "MEDIATOR", "src/m.py", 50, 60))
    changes = spark.createDataFrame([("m.py", [2, 5], False), ("lost.py", [1], False)], "path string, changed_lines array<int>, deleted boolean")
    seeds = impact.seeds(nodes, changes)
    assert {r.seed: r.confidence for r in seeds.collect()} == {"in": 1.0, "next": 0.55, "after": 0.82}
    empty = impact.impacted(nodes, traverse.impact_paths(edges_of(spark, ("x", "y")), seeds), seeds)
    assert impact.quality(nodes, edges_of(spark, ("x", "y")), seeds, changes, empty).first().score == 0.7  # 1 - 0.1 - 0.2


def test_weak_paths_stop(spark):
    edges = edges_of(spark, ("b", "a", "CALL", 0.2), ("c", "b", "CALL", 0.9), ("d", "c", "CALL", 0.9))
    seeds = spark.createDataFrame([("a", 1.0)], "seed string, confidence double")
    assert {r.node for r in traverse.impact_paths(edges, seeds).collect()} == {"b"}
    assert {r.node for r in traverse.impact_paths(edges, seeds, weighted=False).collect()} == {"b", "c", "d"}


def test_closure_and_subgraph(spark):
    nodes = nodes_of(spark, *[(x, "MEDIATOR") for x in "abcde"])
    edges = edges_of(spark, ("a", "b"), ("c", "b"), ("d", "e"), ("a", "b"))
    got = traverse.subgraph(nodes, edges, spark.createDataFrame([("a",)], "id string"))
    assert ({r.id for r in got[0].collect()}, got[1].count()) == ({"a", "b", "c"}, 2)


def test_notation_and_flat_trace(spark):
    nodes = nodes_of(spark, ("v", "VERTEX"), ("s", "TRANSFORM"), ("m", "MEDIATOR"))
    edges = edges_of(spark, ("v", "m", "CALL"), ("v", "s", "SERIALIZER_ENTANGLEMENT"), ("m", "nowhere", "AJAX"))
    roots = spark.createDataFrame([("v",)], "root string")
    visits = trace.trace_flat(nodes, edges, roots)
    assert [r.node for r in visits.orderBy("pos").collect()] == ["v", "s", "m", "nowhere"]
    shown = trace.render_paths(trace.number_paths(traverse.enumerate_paths(nodes, edges, roots, with_facts=True))).orderBy("path_no").collect()
    assert [r.legacy_notation for r in shown] == ["g[URL] -> V[v] -> ⊗[s]", "g[URL] -> V[v] -> ψ[m] -> em[nowhere]"]


def test_semantic_clusters(spark):
    nodes = nodes_of(spark, ("UserListView", "VERTEX"), ("UserDetailView", "VERTEX"), ("UserSerializer", "TRANSFORM"), ("widget", "MEDIATOR"))
    prof = semantic.profiles(nodes, edges_of(spark, ("x", "y")))
    got = {r.id: (r.subjects, r.intent, r.role) for r in prof.collect()}
    assert got["UserListView"] == (["User"], "read", "crud_interface")
    assert got["UserSerializer"] == (["User"], "transform", "data_transform")
    assert got["widget"] == ([], "read", "supporting_logic")  # "get" lies in "widget"
    groups = {(r.scope, r.role): (r.members, r.confidence) for r in semantic.clusters(prof).collect()}
    assert groups == {("data:User", "crud_interface"): (["UserDetailView", "UserListView"], 0.95), ("data:User", "data_workflow"): (["UserDetailView", "UserListView"], 0.95)}


def test_overview(spark):
    nodes = nodes_of(spark, ("a", "VERTEX"), ("b", "PARTICLE"), ("c", "PARTICLE"))
    edges = edges_of(spark, ("a", "b"))
    assert {r.id for r in overview.isolated(nodes, edges).collect()} == {"c"}
    assert [(r.id, r.degree) for r in overview.most_connected(edges).collect()] == [("a", 1), ("b", 1)]
    assert overview.component_template("rails", "model", "X").startswith("#")


def test_empty_graph(spark):
    nodes, edges = nodes_of(spark, ("x", "VERTEX")).limit(0), edges_of(spark, ("x", "y")).limit(0)
    assert reachability.classify(nodes, edges).count() == 0
    assert validate.validate(nodes, normalize.normalize_edges(edges)).count() == 0
    assert semantic.clusters(semantic.profiles(nodes, edges)).count() == 0


def test_ids_past_999(spark):
    edges = spark.createDataFrame([(i, "root", f"n{i}", "CALL") for i in range(1001)], "edge_idx long, source string, target string, type string")
    nodes = spark.createDataFrame([(0, "root", "VERTEX")], "node_idx long, id string, type string")
    paths = trace.number_paths(traverse.enumerate_paths(nodes, edges, spark.createDataFrame([("root",)], "root string")))
    assert {r.path_id for r in paths.collect()} == {f"path_{n:03}" for n in range(1, 1002)}
    named = spark.createDataFrame([(2 * k + i, f"python:m.Thing{k:04}{'View' if i else ''}", "VERTEX" if i else "PARTICLE") for k in range(1100) for i in (0, 1)], "node_idx long, id string, type string")
    uses = spark.createDataFrame([(k, f"python:m.Thing{k:04}View", f"python:m.Thing{k:04}", "PARTICLE_ENTANGLEMENT") for k in range(1100)], "edge_idx long, source string, target string, type string")
    found = semantic.clusters(semantic.profiles(named, uses)).orderBy("scope", "role").select("id").collect()
    assert [r.id for r in found] == [f"semantic_cluster_{n:03}" for n in range(1, len(found) + 1)]


def test_files_match_by_suffix(spark):
    files = ["src/app/a.py", "app/a.py", "a.py", "lib/b.py", "xa.py", None, ""]
    nodes = spark.createDataFrame([(i, f"n{i}", f) for i, f in enumerate(files)], "node_idx long, id string, file string")
    changed = [("d1", "app/a.py"), ("d1", "deep/lib/b.py"), ("d2", "a.py"), ("d2", "zzz.py")]
    changes = spark.createDataFrame([(d, p, [1], False) for d, p in changed], "diff string, path string, changed_lines array<int>, deleted boolean")
    got = {(r.diff, r.id): r.changed_file for r in impact.match_files(nodes, changes, by=("diff",)).collect()}
    want = {}
    for d in ("d1", "d2"):
        own = sorted(p for e, p in changed if e == d)
        for i, f in enumerate(files):
            hit = [p for p in own if f and p == f] or [p for p in own if f and (f.endswith(p) or p.endswith(f))]
            if hit:
                want[d, f"n{i}"] = hit[0]
    assert got == want


def test_ledger_is_annotated_without_a_broadcast_and_with_the_fields_asked_for(spark):
    ledger = spark.sql("SELECT * FROM VALUES ('a'), ('c') AS t(root)")  # tables that the planner knows to be small
    grouped = spark.sql("SELECT * FROM VALUES ('k2', 'two', 0.5D, array('a', 'b')), ('k1', 'one', 0.9D, array('a')) AS t(id, summary, confidence, members)")
    done = semantic.annotate(ledger, grouped)
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()  # summaries, once per member, would pass through the driver
    assert {r.root: [tuple(c) for c in r.semantic_clusters or []] for r in done.collect()} == {"a": [("k1", "one", 0.9), ("k2", "two", 0.5)], "c": []}
    few = semantic.annotate(ledger, grouped, fields=("id",))
    assert {r.root: (r.semantic_cluster_count, [tuple(c) for c in r.semantic_clusters or []]) for r in few.collect()} == {"a": (2, [("k1",), ("k2",)]), "c": (0, [])}


def test_first_edge_of_equal_numbers_is_the_first_of_the_table(spark, tmp_path):
    tables = {
        "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", [(1, 1, 7, 5), (1, 1, 7, 9), (1, 1, 7, 2), (2, 1, 8, 9), (2, 1, 8, 3), (0, 1, 9, None), (1, 1, 9, 4)]),
        "orders": ("o_orderkey long, o_custkey long", [(1, 1)]), "customer": ("c_custkey long, c_nationkey int", [(1, 1)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(1, 1)]), "nation": ("n_nationkey int, n_regionkey int", [(1, 1)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.source, r.type): r.target for r in QUERIES["first_edge_by_type"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute("SET threads = 1")  # of more, arg_min takes a row of equals that depends on which ends first
        for name in tables:
            db.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert got == {(s, t): target for s, t, target in db.execute(ORACLES["first_edge_by_type"]).fetchall()}
    assert [got[f"part:{k}", "DEPENDENCY"] for k in (7, 8, 9)] == ["supplier:5", "supplier:9", "supplier:4"]


def test_first_edge_without_a_place_is_that_of_the_least_target(spark):
    edges = spark.createDataFrame([(1, "a", "y", "CALL"), (1, "a", "x", "CALL"), (1, "a", "z", "CALL"), (None, "b", "u", "CALL"), (3, "b", "v", "CALL")], "edge_idx long, source string, target string, type string")
    assert {r.source: r.target for r in overview.first_edge_by_type(edges).collect()} == {"a": "x", "b": "v"}
