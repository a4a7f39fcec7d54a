"""Queries over the lifted graph, one or more per operator; results are flat so that SQL can be compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, notation, scores
from ..operators import frameworks, impact, normalize, overview, pyast, reachability, resolve, semantic, templates, trace, traverse, validate
from ..sources.diff import changed_lines
from ..storage import materialize
from . import lifted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = lifted.lift(spark, d, lifted.NODES)
    none = lambda n: F.lit(None).cast("double").alias(n)
    meta = F.struct(F.col("mass"), none("charge"), none("spin"), F.when(F.col("type") == "VERTEX", F.lit(0.8)).alias("energy"), none("coupling"), none("lifetime"))
    return rows.withColumn("metadata", meta).drop("mass")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return lifted.lift(spark, d, lifted.EDGES)


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _nodes(spark, d), _edges(spark, d)


def _supply(spark: SparkSession, d: str) -> DataFrame:
    return lifted.lift(spark, d, lifted.SUPPLY)


def _roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("type IN ('VERTEX', 'FRONTEND')").select(F.col("id").alias("root"))


def _text(c: str):
    return F.array_join(c, ",").alias(c)


@query
def normalize_edges(spark, d):
    e = normalize.normalize_edges(_edges(spark, d).withColumn("confidence", F.col("confidence") * 1.06))
    return e.select("edge_idx", "id", "source", "target", "type", "confidence", F.size("evidence").alias("evidence_count"))


@query
def normalize_nodes(spark, d):
    n = normalize.normalize_nodes(_nodes(spark, d).drop("name").withColumn("flag", F.lit(True)))
    return n.select("node_idx", "id", "name", "qualified_name", "type", "file", F.coalesce("line_start", F.lit(-1)).alias("line_start"), F.col("metadata.file").alias("meta_file"), F.col("attributes").getItem("flag").alias("flag"))


@query
def validate_missing_refs(spark, d):
    nodes = _nodes(spark, d).where("type <> 'MEDIATOR'")
    found = validate.validate(nodes, normalize.normalize_edges(_edges(spark, d)))
    return found.groupBy("severity", "kind").agg(F.count("*").alias("n"), F.min("message").alias("first_message"))


@query
def duplicate_ids(spark, d):
    return validate.duplicate_ids(normalize.normalize_edges(_supply(spark, d)))


@query
def node_type_counts(spark, d):
    return overview.type_counts(_nodes(spark, d)).withColumnRenamed("count", "n")


@query
def degree_top5(spark, d):
    return overview.most_connected(_edges(spark, d))


@query
def isolated_nodes(spark, d):
    return overview.isolated(*_graph(spark, d))


@query
def overview_totals(spark, d):
    return overview.totals(*_graph(spark, d))


@query
def neighbors_1hop(spark, d):
    nodes, edges = _graph(spark, d)
    return overview.neighbours(edges, nodes.where("type = 'PARTICLE'"))


@query
def first_edge_by_type(spark, d):
    # lineitem's orders and line numbers do not tell all rows apart: the first of the table counts
    return overview.first_edge_by_type(lifted.lift_in_order(spark, d, lifted.SUPPLY, lifted.EDGES), "place")


@query
def targets_by_type(spark, d):
    return overview.targets_by_type(_edges(spark, d), "PARTICLE_ENTANGLEMENT").select("source", _text("targets"))


@query
def edge_priority_rank(spark, d):
    from ..schema import TRACE_PRIORITY

    return normalize.rank_edges(_edges(spark, d), TRACE_PRIORITY).select("edge_idx", "source", "rank")


@query
def impact_edge_rank(spark, d):
    return impact.order_in_edges(_edges(spark, d)).select("edge_idx", "target", "rank")


@query
def edge_dedup_first(spark, d):
    return normalize.dedup_edges(_supply(spark, d)).select("edge_idx", "source", "target", "type")


@query
def node_upsert(spark, d):
    real = _nodes(spark, d).select("node_idx", "id", "type", F.lit(False).alias("imported"))
    seen = _supply(spark, d).select(F.col("edge_idx").alias("node_idx"), F.col("source").alias("id"), F.lit("UNKNOWN").alias("type"), F.lit(True).alias("imported"))
    return normalize.upsert_nodes(real.unionByName(seen))


@query
def component_closure(spark, d):
    nodes, edges = _graph(spark, d)
    return traverse.closure(edges, nodes.where("type = 'PARTICLE'").select("id"))


@query
def subgraph_reduction(spark, d):
    nodes, edges = _graph(spark, d)
    n, e = traverse.subgraph(nodes, edges, nodes.where("type = 'PARTICLE'").select("id"))
    one = n.agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(nodes.agg(F.count("*").alias("total")))  # one row each
    return one.select("nodes", "edges", F.when(F.col("total") > 0, F.round((1 - F.col("nodes") / F.col("total")) * 100, 4)).alias("reduction"))


def _paths(spark, d, depth=4, with_facts=False):
    nodes, edges = _graph(spark, d)
    return trace.number_paths(traverse.enumerate_paths(nodes, edges, _roots(nodes), depth, with_facts=with_facts)), nodes


def _nation_paths(spark, d):
    """Paths from all nations over the ring (with regions as the only terminal nodes): cycles and depth limits."""
    nodes, edges = _graph(spark, d)
    nodes = nodes.withColumn("type", F.when(F.col("id").startswith("nation:"), "MEDIATOR").otherwise(F.col("type")))
    return trace.number_paths(traverse.enumerate_paths(nodes, edges, nodes.where("id LIKE 'nation:%'").select(F.col("id").alias("root")), 26)), nodes


def _flat(paths):
    return paths.select("root", "path_id", F.array_join("node_ids", ">").alias("nodes"), F.size("hops").alias("hops"), "termination", "cycle_to")


@query
def paths_enumerate(spark, d):
    return _flat(_paths(spark, d)[0])


@query
def paths_depth_cut(spark, d):
    return _flat(_paths(spark, d, 1)[0])


@query
def paths_cycles(spark, d):
    return _flat(_nation_paths(spark, d)[0])


@query
def path_stats(spark, d):
    return trace.path_stats(_paths(spark, d)[0])


@query
def graph_slice(spark, d):
    paths, nodes = _nation_paths(spark, d)
    n = trace.slice_nodes(paths, nodes).groupBy("root").agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "PARTICLE").alias("particles"))
    return n.join(trace.slice_edges(paths).groupBy("root").agg(F.count("*").alias("edges")), "root")


@query
def trace_flat(spark, d):
    nodes, edges = _graph(spark, d)
    return trace.trace_flat(nodes, edges, _roots(nodes)).select("root", "pos", "node", "role")


@query
def flat_ledger(spark, d):
    nodes, edges = _graph(spark, d)
    return trace.flat_ledger(trace.trace_flat(nodes, edges, nodes.where("type = 'VERTEX'").select(F.col("id").alias("root")))).select("root", "notation", "trace_length", F.round("complexity", 6).alias("complexity"), F.round("energy", 6).alias("energy"), "coupling")


@query
def notation_strings(spark, d):
    paths, _ = _paths(spark, d, with_facts=True)
    return trace.render_paths(paths).select("root", "path_id", "notation", "legacy_notation", "truncated")


@query
def branch_ledger(spark, d):
    paths, _ = _paths(spark, d, with_facts=True)
    return trace.ledger(trace.render_paths(paths, "frontend")).select("root", "legacy", "path_count")


@query
def diagram_categories(spark, d):
    paths, _ = _paths(spark, d, with_facts=True)
    shown = trace.render_paths(paths).withColumn("diagram", notation.diagram(F.col("trace")))
    return shown.select("root", "path_id", *[F.size(f"diagram.{c}").alias(c) for c in ("vertices", "propagators", "particles", "interactions")])


@query
def minimal_ledger(spark, d):
    return trace.minimal_ledger(_nodes(spark, d))


@query
def minimal_ledger_metadata(spark, d):
    shown = trace.minimal_ledger_with_metadata(_nodes(spark, d))
    return shown.select("id", "notation", F.size("diagram.vertices").alias("vertices"), F.size("diagram.propagators").alias("propagators"), "interaction_type", F.round("complexity", 6).alias("complexity"), F.round("energy", 6).alias("energy"), "coupling")


@query
def ghost_nodes(spark, d):
    nodes, edges = _graph(spark, d)
    visits = trace.trace_flat(nodes, edges, _roots(nodes))
    return trace.ghosts(nodes, visits.select(F.col("node").alias("name")))


def _classes(spark, d):
    return reachability.classify(*_graph(spark, d))


@query
def reachability_classes(spark, d):
    return _classes(spark, d).select("id", "classification", "confidence", "reachable", F.element_at("evidence", 1).alias("evidence"))


@query
def reachability_summary(spark, d):
    return reachability.summary(_classes(spark, d)).withColumnRenamed("count", "n")


@query
def reachability_totals(spark, d):
    return reachability.totals(_classes(spark, d))


@query
def reached_from(spark, d):
    c = _classes(spark, d).where("reachable")
    return c.select("id", F.size("reached_from").alias("n"), F.array_min("reached_from").alias("first"), F.array_max("reached_from").alias("last"))


@query
def possibly_unreachable(spark, d):
    return reachability.possibly_unreachable(_classes(spark, d))


def _changes(spark, d):
    return changed_lines(lifted.lift(spark, d, lifted.DIFFS))


@query
def diff_parse(spark, d):
    return _changes(spark, d).select("diff", "path", _text("changed_lines"), "deleted")


@query
def changed_seeds(spark, d):
    nodes = _nodes(spark, d)
    return impact.seeds(nodes, _changes(spark, d)).select("seed", "confidence", F.array_join("evidence", " ").alias("evidence"), "changed_file")


def _impact(spark, d):
    nodes, edges = (materialize(x, "graph") for x in _graph(spark, d))
    changes = materialize(_changes(spark, d), "changes")
    seeds = materialize(impact.seeds(nodes, changes), "seeds")
    return nodes, edges, changes, seeds, traverse.impact_paths(edges, seeds)


def _report(spark, d):
    nodes, edges, changes, seeds, paths = _impact(spark, d)
    return nodes, edges, changes, seeds, materialize(impact.impacted(nodes, paths, seeds), "impacted")


@query
def impact_paths(spark, d):
    return _impact(spark, d)[4].select("seed", "node", "depth", "confidence", F.array_join("node_path", " <- ").alias("summary"))


@query
def impact_path_evidence(spark, d):
    shown = impact.describe(_impact(spark, d)[4])
    return shown.select("summary", "confidence", "confidence_label", F.array_join("evidence", "; ").alias("evidence"))


@query
def impact_best(spark, d):
    nodes, _, _, seeds, paths = _impact(spark, d)
    return impact.impacted(nodes, paths, seeds).select("id", "type", "confidence", "confidence_label", "impact_status", "path_count")


@query
def impact_by_type_status(spark, d):
    return impact.by_type_and_status(_report(spark, d)[4]).withColumnRenamed("count", "n")


@query
def review_surfaces(spark, d):
    return impact.review_surfaces(_report(spark, d)[4])


@query
def graph_quality(spark, d):
    nodes, edges, changes, seeds, report = _report(spark, d)
    return impact.quality(nodes, edges, seeds, changes, report)


@query
def report_confidence(spark, d):
    nodes, edges, changes, seeds, report = _report(spark, d)
    return impact.report_confidence(seeds, report, impact.quality(nodes, edges, seeds, changes, report))


@query
def impact_unweighted(spark, d):
    nodes, edges = _graph(spark, d)
    seeds, paths = impact.unweighted(nodes, edges, _changes(spark, d))
    return paths.groupBy("seed", "depth").agg(F.count("*").alias("paths"), F.count_distinct("node").alias("nodes"))


@query
def impact_unweighted_summary(spark, d):
    nodes, edges = _graph(spark, d)
    seeds, paths = impact.unweighted(nodes, edges, _changes(spark, d))
    return impact.unweighted_summary(nodes, seeds, paths)


def _named(spark, d):
    return lifted.lift(spark, d, lifted.NAMED), lifted.lift(spark, d, lifted.NAMED_EDGES)


def _profiles(spark, d):
    return semantic.profiles(*_named(spark, d))


@query
def semantic_tokens(spark, d):
    return _profiles(spark, d).select("id", _text("tokens"))


@query
def semantic_subjects(spark, d):
    return _profiles(spark, d).select("id", "type", _text("subjects"))


@query
def semantic_intent(spark, d):
    return _profiles(spark, d).select("id", "intent", "role")


@query
def semantic_clusters(spark, d):
    c = semantic.clusters(_profiles(spark, d))
    return c.select("id", "scope", "role", _text("members"), _text("data_subjects"), _text("intents"), _text("node_types"), "confidence", "summary")


@query
def cluster_membership(spark, d):
    return semantic.memberships(semantic.clusters(_profiles(spark, d))).select("node", _text("clusters"))


@query
def ledger_annotate(spark, d):
    nodes, edges = _named(spark, d)
    ledger = trace.minimal_ledger(nodes.select("id", "type").distinct())
    done = semantic.annotate(ledger, semantic.clusters(semantic.profiles(nodes, edges)), "id", fields=("id",))
    return done.select("id", "notation", "semantic_cluster_count", F.coalesce(F.array_join(F.transform("semantic_clusters", lambda c: c["id"]), ","), F.lit("")).alias("cluster_ids"))


def _templates(spark, d):
    return lifted.lift(spark, d, lifted.TEMPLATES)


def _template_kind(spark, d, where):
    return templates.template_edges(_templates(spark, d)).where(where).select("source", "target", "target_type", "name", "type")


@query
def template_vars(spark, d):
    return _template_kind(spark, d, "type = 'OBSERVATION'")


@query
def template_js(spark, d):
    return _template_kind(spark, d, "target_type = 'JAVASCRIPT'")


@query
def template_fetch(spark, d):
    return _template_kind(spark, d, "type = 'AJAX'")


@query
def template_deps(spark, d):
    return _template_kind(spark, d, "type = 'DEPENDENCY'")


@query
def template_mass(spark, d):
    t = _templates(spark, d)
    return t.select("rel_path", scores.template_mass(F.col("content")).alias("mass"))


@query
def template_nodes(spark, d):
    return templates.template_nodes(_templates(spark, d)).select("id", "name", "type", "line_start", "line_end")


@query
def physics_metrics(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", F.col("p_size").cast("double").alias("loc"), (F.col("p_partkey") % 9 + 1).cast("double").alias("cc"), (F.col("p_partkey") % 13).cast("double").alias("calls"),
        (F.col("p_partkey") % 5).cast("double").alias("fields"), (F.col("p_partkey") % 3).cast("double").alias("rels"), F.when(F.col("p_partkey") % 2 == 0, "PARTICLE").otherwise("TRANSFORM").alias("type"),
    )
    c = F.col
    return p.select(
        "p_partkey", "type", scores.mass(c("loc"), c("cc"), c("calls"), c("fields"), c("rels"), c("type")).alias("mass"), scores.energy(c("calls"), c("cc")).alias("energy"),
        scores.coupling(c("calls"), c("rels")).alias("coupling"), scores.charge(c("rels"), c("type")).alias("charge"),
    )


@query
def fallback_metrics(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").withColumn("content", F.concat(F.repeat(F.lit("x = models.ForeignKey()\n\n"), F.col("p_size").cast("int") % 9), F.lit("y = models.Char()")))
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "CreateView").otherwise("ListView"))
    return p.select("p_partkey", scores.model_mass(F.col("content")).alias("model_mass"), scores.view_mass(F.col("content"), name).alias("view_mass"))


@query
def suggestions(spark, d):
    return overview.suggestions(*_graph(spark, d))


@query
def unused_imports(spark, d):
    nodes, edges = _graph(spark, d)
    return overview.unused_imports(nodes.withColumn("file", F.when(F.col("type") == "VERTEX", F.concat(F.lit("models/"), "file")).otherwise(F.col("file"))), edges)


@query
def editor_hints(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 4 == 0, "class X(View): ").when(F.col("p_partkey") % 4 == 1, "models.Char ").when(F.col("p_partkey") % 4 == 2, "Serializer ").otherwise(""), "p_name").alias("line"))
    return p.select("p_partkey", overview.line_hint(F.col("line")).alias("hint"))


@query
def guess_framework(spark, d):
    return overview.guess_framework(lifted.lift(spark, d, lifted.NAMED).withColumn("metadata", F.struct(F.lit(1).alias("x"))))


@query
def components_in_file(spark, d):
    nodes, edges = _graph(spark, d)
    own = overview.in_file(nodes, "lib/cli.py")
    around = overview.neighbours(edges, own).groupBy("id").agg(F.count("*").alias("related"))
    return own.select("id", "name", "type").join(around, "id", "left").na.fill(0, ["related"])


@query
def schema_compat(spark, d):
    v = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 5 == 4, "v").otherwise((F.col("o_orderkey") % 5).cast("string")), F.lit(".2.0")).alias("v"))
    return v.withColumn("c", normalize.compatibility(F.col("v"))).select("o_orderkey", "c.*")


@query
def rule_match(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").withColumn("k", F.col("p_partkey") % 10)
    is_class = F.col("k") < 6
    name = F.concat(F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))), F.when(F.col("k") == 1, "View").when(F.col("k") == 2, "Serializer").when(F.col("k") == 6, "_Detail").when(F.col("k") == 7, "_view").otherwise(""))
    bases = F.when(F.col("k") == 3, F.array(F.lit("models.Model"))).when(F.col("k") == 4, F.array(F.lit("a.models.Model"))).when(F.col("k") == 5, F.array(F.lit("xmodels.Model"))).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", name.alias("name"), frameworks.node_type(frameworks.get("django"), name, bases, F.array().cast("array<string>"), is_class).alias("type"))


@query
def module_names(spark, d):
    n = _nodes(spark, d).select("file").distinct()
    return n.select("file", ids.module_name(F.col("file")).alias("module"), ids.relative_path(F.concat(F.lit("/p/"), "file"), "/p").alias("rel"))


@query
def relative_imports(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    module = F.concat(F.lit("a.b"), "n_regionkey", F.lit(".c.m"), "n_nationkey")
    return n.select("n_nationkey", ids.import_module(module, F.when(F.col("n_nationkey") % 2 == 0, "x.y").otherwise(""), F.col("n_nationkey") % 7).alias("target"))


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """A small project per supplier, written out from the table: models, services, views, routes and a page that use each other."""
    n = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"), F.concat(F.lit("Item"), "s_suppkey").alias("name"))
    models = F.concat(F.lit("from django.db import models\n\n\nclass "), "name", F.lit("(models.Model):\n    title = models.CharField()\n    owner = models.ForeignKey('x')\n\n    def save(self):\n        self.check()\n        return helper(self)\n\n    def check(self):\n        if self.title:\n            raise ValueError()\n\n\ndef helper(x):\n    return [y for y in x]\n"))
    views = F.concat(F.lit("from .models import "), "name", F.lit("\nimport shop.p"), "k", F.lit(".services as s\n\n\nclass "), "name", F.lit("ListView:\n    model = "), "name", F.lit("\n    serializer_class = Missing\n\n    def get(self, request):\n        item = "), "name", F.lit("()\n        item.save()\n        s.run(item)\n        return "), "name", F.lit(".objects.all()\n\n\ndef home(request):\n    return "), "name", F.lit("().save()\n"))
    services = F.concat(F.lit("from shop.p"), "k", F.lit(".models import "), "name", F.lit(" as M\n\n\ndef run(item: M):\n    try:\n        item.check()\n    except ValueError:\n        return None\n    while item:\n        item = None\n\n\ndef broken_"), "k", F.lit("():\n    unknown()\n"))
    routes = F.concat(F.lit("from fastapi import APIRouter\n\nrouter = APIRouter()\n\n\n@router.get('/"), "k", F.lit("')\n@cached\ndef show_"), "k", F.lit("(item: int):\n    return item\n\n\n@table\nclass Row"), "k", F.lit(":\n    pass\n"))
    page = F.concat(F.lit("<p>{{ "), F.lower("name"), F.lit(".title }}</p><script>function show"), "k", F.lit("() { fetch('/api/"), "k", F.lit("'); }</script>\n"))
    files = F.array(*[F.struct(F.concat(F.lit("shop/p"), "k", F.lit(f"/{f}")).alias("rel_path"), text.alias("content")) for f, text in (("models.py", models), ("views.py", views), ("services.py", services), ("routes.py", routes), ("__init__.py", F.lit("")), ("bad.py", F.lit("def (:\n")), ("page.html", page))])
    return n.select(F.explode(files).alias("f")).select("f.*", F.col("f.rel_path").alias("path"))


@query
def rule_match_decorators(spark, d):
    """Types by decorator, of every part as a class or function under two frameworks."""
    p = spark.read.parquet(f"{d}/part.parquet").withColumn("k", F.col("p_partkey") % 8)
    mark = F.element_at(F.array(*[F.lit(x) for x in ("app.route('/')", "bp.route('/x')", "router.get('/')", "table", "APIRouter()", "cached", "app.get", "tableless")]), (F.col("k") + 1).cast("int"))
    kinds = [frameworks.node_type(frameworks.get(f), F.lit("shown"), F.array().cast("array<string>"), F.array(mark), F.col("p_partkey") % 3 == 0).alias(f) for f in ("flask", "fastapi")]
    return p.select("p_partkey", *kinds)


def _facts(spark, d):
    return materialize(pyast.python_facts(source_files(spark, d)), "facts")


@query
def py_extract(spark, d):
    return resolve.definitions(_facts(spark, d)).select("id", "kind", "qualified", "line_start", "line_end", _text("bases"))


@query
def component_metrics(spark, d):
    return resolve.definitions(_facts(spark, d)).select("id", "metrics.*")


@query
def call_resolution(spark, d):
    facts = _facts(spark, d)
    return resolve.resolve_calls(facts, resolve.Names(facts)).select("source", "target", "resolution", "confidence", "line")


@query
def component_lookup(spark, d):
    """Definitions meant by name and lines: at the line, around the lines, by name alone, and unclear."""
    n = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"))
    asked = [("models.py", "save", 8, None), ("models.py", "check", 13, 14), ("services.py", "run", None, None), ("services.py", "run", 12, 12), ("services.py", "gone", 1, 2)]
    rows = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(name).alias("name"), F.lit(a).cast("int").alias("line_start"), F.lit(b).cast("int").alias("line_end")) for f, name, a, b in asked])
    wanted = n.select("k", F.explode(rows).alias("w")).select(F.concat(F.lit("shop/p"), "k", F.lit("/"), "w.f").alias("rel_path"), "w.name", "w.line_start", "w.line_end")
    found = resolve.find_components(wanted, _facts(spark, d))
    return found.select("rel_path", "name", F.coalesce("line_start", F.lit(0)).alias("line_start"), "id", F.col("metrics.loc").alias("loc"))


@query
def framework_detect(spark, d):
    found = frameworks.detect(source_files(spark, d), _facts(spark, d).select("rel_path", F.col("all_imports").alias("imports"), "called", F.col("all_decorators").alias("decorators")))
    return found.select("framework", "confidence", F.size("evidence").alias("evidence_count"), F.col("scores").getItem("django").alias("django_score"))


def _project(spark, d):
    files = materialize(source_files(spark, d), "files")
    return resolve.build_graph(files, _facts(spark, d), frameworks.get("django"))


@query
def project_nodes(spark, d):
    return _project(spark, d)[0].select("id", "name", "qualified_name", "type", "language", "line_start", "line_end", F.col("metadata.mass").alias("mass"))


@query
def project_edges(spark, d):
    return _project(spark, d)[1].select("id", "source", "target", "type", "confidence", "resolution")
