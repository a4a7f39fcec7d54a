"""From syntax facts to the graph: names, classes and calls resolved by joins over the whole project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.ids import any_of, import_module, module_name, prefixed, python_id, unresolved_id
from ..schema import EDGES, NODES
from ..storage import materialize
from .frameworks import Framework, node_type
from .normalize import dedup_edges, normalize_edges, normalize_nodes, upsert_nodes
from .ranges import global_prefix, shuffle_partitions
from .templates import template_edges, template_nodes

_RELATION = {"model": ("PARTICLE", "PARTICLE_ENTANGLEMENT"), "serializer_class": ("TRANSFORM", "SERIALIZER_ENTANGLEMENT")}


def definitions(facts: DataFrame) -> DataFrame:
    """One row per class, function and method with its module, qualified name and id."""
    d = facts.select("rel_path", module_name(F.col("rel_path")).alias("module"), F.explode("defs").alias("d")).select("rel_path", "module", "d.*")
    return d.select("*", F.concat_ws(".", "module", F.nullif("parent", F.lit("")), "name").alias("qualified"), python_id(F.col("module"), F.col("parent"), F.col("name")).alias("id"))


def imports(facts: DataFrame) -> DataFrame:
    """(rel_path, local, import_kind, import_path): the last binding of each local name."""
    i = facts.select("rel_path", module_name(F.col("rel_path")).alias("current"), F.explode("imports").alias("i")).select("rel_path", "current", "i.*")
    module = import_module(F.col("current"), F.col("module"), F.col("level"))
    path = F.when(F.col("kind") == "symbol", F.concat_ws(".", F.nullif(module, F.lit("")), "symbol")).otherwise(F.col("module"))
    # a module of no name leaves ".symbol", which no definition has
    path = F.when((F.col("kind") == "symbol") & (module == ""), F.concat(F.lit("."), "symbol")).otherwise(path)
    return i.select("rel_path", "local", "seq", F.col("kind").alias("import_kind"), path.alias("import_path")).groupBy("rel_path", "local").agg(F.max_by(F.struct("import_kind", "import_path"), "seq").alias("i")).select("rel_path", "local", "i.*")


def find_components(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """``wanted`` (rel_path, name, line_start, line_end) with the definition's id and metrics that it means, null if that is not clear.

    Of the file's definitions of the name: the only one that begins at the line, else the only one that spans the lines, else the only one.
    """
    d = definitions(facts).select(F.col("rel_path").alias("file_"), F.col("name").alias("name_"), F.struct("id", "metrics", F.col("line_start").alias("a"), F.col("line_end").alias("b")).alias("d"))
    own = wanted.withColumn("row", F.struct("rel_path", "name", "line_start", "line_end")).distinct()
    held = own.join(d, (F.col("rel_path") == F.col("file_")) & (F.col("name") == F.col("name_")), "left").groupBy("row").agg(F.collect_list("d").alias("all"))
    exact = F.filter("all", lambda x: x["a"] == F.col("row.line_start"))
    around = F.filter("all", lambda x: (x["a"] <= F.col("row.line_start")) & (x["b"] >= F.col("row.line_end")))
    only = lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0)))
    return held.withColumn("hit", F.coalesce(only(exact), only(around), only(F.col("all")))).select("row.*", "hit.id", "hit.metrics")


class Names:
    """Lookups by name and by qualified name."""

    def __init__(self, facts: DataFrame) -> None:
        self.all = definitions(facts)
        found = F.struct("id", "kind", "qualified", "rel_path")
        order = F.struct("rel_path", "seq")
        self.by_qualified = self.all.groupBy(F.col("qualified").alias("q")).agg(F.max_by(found, order).alias("hit"))
        self.in_file = self.all.where("parent = ''").groupBy("rel_path", F.col("name").alias("local")).agg(F.count("*").alias("n"), F.first(found).alias("here")).where("n = 1").drop("n")
        self.in_project = self.all.groupBy(F.col("name").alias("local")).agg(F.count("*").alias("n"), F.first(found).alias("anywhere")).where("n = 1").drop("n")
        self.in_project = materialize(self.in_project, "names")  # so that the join splits names that very many references begin with
        self.imports = imports(facts)

    def resolve(self, refs: DataFrame) -> DataFrame:
        """``refs`` (rel_path, expr) with named (what a bare name refers to) and quoted (what the dotted path, through imports, leads to).

        A bare name is the file's only top-level definition of it; else what
        the name was imported as, found or not; else the project's only definition.
        """
        r = refs.select("rel_path", "expr").where("expr IS NOT NULL").distinct().withColumn("local", F.split_part("expr", F.lit("."), F.lit(1)))
        r = r.join(self.imports, ["rel_path", "local"], "left")
        rest = F.substr("expr", F.length("local") + 1)
        r = r.withColumn("path", F.when(F.col("import_path").isNotNull(), F.concat("import_path", rest)).otherwise(F.col("expr")))
        r = r.join(self.by_qualified, F.col("path") == F.col("q"), "left").withColumnRenamed("hit", "quoted").drop("q")
        r = r.join(self.in_file, ["rel_path", "local"], "left").join(self.in_project, "local", "left")
        named = F.coalesce(F.col("here"), F.when(F.coalesce("import_kind", F.lit("")) == "symbol", F.col("quoted")).otherwise(F.col("anywhere")))
        return r.select("rel_path", "expr", F.when(~F.col("expr").contains("."), named).alias("named"), "quoted")

    def classes(self, refs: DataFrame) -> DataFrame:
        """(rel_path, expr, class): qualified name of the class that an expression names."""
        r = self.resolve(refs).withColumn("hit", F.when(F.col("expr").contains("."), F.col("quoted")).otherwise(F.col("named")))
        return r.where("hit.kind = 'class'").select("rel_path", "expr", F.col("hit.qualified").alias("class"))


def local_types(facts: DataFrame, names: Names) -> DataFrame:
    """(rel_path, owner, variable, class): arguments by annotation, then assignments by annotation or constructor; the last that is known."""
    v = facts.select("rel_path", F.explode("variables").alias("v")).select("rel_path", "v.*")
    known = names.classes(v.select("rel_path", F.explode(F.array("annotation", "constructor")).alias("expr")))
    noted = known.select("rel_path", F.col("expr").alias("annotation"), F.col("class").alias("noted"))
    made = known.select("rel_path", F.col("expr").alias("constructor"), F.col("class").alias("made"))
    v = v.join(noted, ["rel_path", "annotation"], "left").join(made, ["rel_path", "constructor"], "left").withColumn("class", F.coalesce("noted", "made"))
    is_argument = v.where("class IS NOT NULL")
    return is_argument.groupBy("rel_path", "owner", "variable").agg(F.max_by("class", "seq").alias("class"))


def resolve_calls(facts: DataFrame, names: Names) -> DataFrame:
    """(rel_path, seq, owner, source, target, resolution, confidence, line) of calls that lead to a definition; the first rung that holds counts."""
    c = facts.select("rel_path", module_name(F.col("rel_path")).alias("module"), F.explode("calls").alias("c")).select("rel_path", "module", "c.*")
    c = c.withColumn("source", F.concat(F.lit("python:"), F.concat_ws(".", "module", "owner")))
    refs = names.resolve(c.select("rel_path", F.col("callee").alias("expr")))
    bare = c.where("method IS NULL AND callee IS NOT NULL").join(refs.where("named IS NOT NULL").select("rel_path", F.col("expr").alias("callee"), "named"), ["rel_path", "callee"])
    bare = bare.select("rel_path", "seq", "owner", "source", "line", F.lit(1).alias("rung"), F.col("named.qualified").alias("to"), F.lit("name").alias("resolution"), F.lit(0.95).alias("confidence"))
    m = c.where("method IS NOT NULL")
    known = names.classes(m.select("rel_path", F.explode(F.array("receiver", "constructor")).alias("expr")))

    def rung(df: DataFrame, n: int, to: Column, name: str, confidence: float) -> DataFrame:
        return df.select("rel_path", "seq", "owner", "source", "line", F.lit(n).alias("rung"), to.alias("to"), F.lit(name).alias("resolution"), F.lit(confidence).alias("confidence"))

    of = lambda c: F.concat(c, F.lit("."), "method")
    own = rung(m.where("receiver IN ('self', 'cls') AND parent <> ''"), 2, F.concat_ws(".", "module", "parent", "method"), "self_method", 1.0)
    types = local_types(facts, names).withColumnRenamed("variable", "receiver")
    local = rung(m.join(types, ["rel_path", "owner", "receiver"]), 3, of(F.col("class")), "local_instance", 0.9)
    made = rung(m.join(known.withColumnRenamed("expr", "constructor"), ["rel_path", "constructor"]), 4, of(F.col("class")), "constructed_instance", 0.95)
    static = rung(m.join(known.withColumnRenamed("expr", "receiver"), ["rel_path", "receiver"]), 5, of(F.col("class")), "class_method", 0.95)
    quoted = refs.where("quoted IS NOT NULL").select("rel_path", F.col("expr").alias("callee"), "quoted")
    path = rung(m.join(quoted, ["rel_path", "callee"]), 6, F.col("quoted.qualified"), "qualified_import", 0.98)
    every = bare.unionByName(own).unionByName(local).unionByName(made).unionByName(static).unionByName(path)
    hits = every.join(names.by_qualified, F.col("to") == F.col("q"))
    first = hits.groupBy("rel_path", "seq", "owner", "source", "line").agg(F.min_by(F.struct("hit", "resolution", "confidence"), "rung").alias("b"))
    return first.select("rel_path", "seq", "owner", "source", F.col("b.hit.id").alias("target"), "b.resolution", "b.confidence", "line").where("source <> target")


def build_graph(files: DataFrame, facts: DataFrame, framework: Framework) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a project from its files (path, rel_path, content) and facts, normalised.

    Order: code files by path, in each by place in the source; then templates.
    """
    names = Names(facts)
    paths = files.select("rel_path", "path")
    d = names.all.withColumn("type", F.when(F.col("kind") == "method", "MEDIATOR").otherwise(node_type(framework, F.col("name"), F.col("bases"), F.col("decorators"), F.col("kind") == "class")))
    x = F.col("metrics")
    num = lambda k: x[k].cast("double")
    args = (num("call_count"), num("relationship_count"))
    meta = F.struct(
        scores.mass(num("loc"), num("cyclomatic_complexity"), num("call_count"), num("field_count"), num("relationship_count"), F.col("type")).alias("mass"), scores.charge(args[1], F.col("type")).alias("charge"),
        F.lit(0.5).alias("spin"), scores.energy(args[0], num("cyclomatic_complexity")).alias("energy"), scores.coupling(*args).alias("coupling"), F.lit(1.0).alias("lifetime"),
        F.col("path").alias("file"), x["loc"].alias("lines"), F.col("line_start"), F.col("line_end"), x.alias("metrics"), F.lit("component").alias("metric_scope"),
    )
    shape = lambda df: df.select("place", "id", "name", "qualified_name", "type", "language", "file", "line_start", "line_end", "metadata", "imported")
    place = lambda kind: F.struct(F.lit(kind).alias("k"), "rel_path", "seq")
    none = F.lit(None)
    real = shape(d.join(paths, "rel_path").select(place(0).alias("place"), "id", "name", F.col("qualified").alias("qualified_name"), "type", F.lit("python").alias("language"), F.col("path").alias("file"), "line_start", "line_end", meta.alias("metadata"), F.lit(False).alias("imported")))

    relations = facts.select("rel_path", module_name(F.col("rel_path")).alias("module"), F.explode("relations").alias("r")).select("rel_path", "r.seq", F.concat(F.lit("python:"), F.concat_ws(".", "module", "r.owner")).alias("source"), F.col("r.attribute").alias("attribute"), F.col("r.value").alias("expr"))
    orm = facts.select("rel_path", module_name(F.col("rel_path")).alias("module"), F.explode("calls").alias("c")).where("c.model IS NOT NULL")
    orm = orm.where(any_of(F.col("c.text").rlike(p) for p in framework.orm)) if framework.orm else orm.where(F.lit(False))
    orm = orm.select("rel_path", "c.seq", F.concat(F.lit("python:"), F.concat_ws(".", "module", "c.owner")).alias("source"), F.lit("model").alias("attribute"), F.col("c.model").alias("expr"))
    uses = relations.unionByName(orm)
    uses = uses.join(names.resolve(uses.select("rel_path", "expr")), ["rel_path", "expr"], "left").join(paths, "rel_path")
    kind = F.when(F.col("attribute") == "model", "PARTICLE").otherwise("TRANSFORM")
    edge = F.when(F.col("attribute") == "model", "PARTICLE_ENTANGLEMENT").otherwise("SERIALIZER_ENTANGLEMENT")
    uses = uses.withColumns({"to": F.coalesce("named.id", unresolved_id(kind, F.col("expr"))), "kind": kind, "edge": edge})
    home = paths.select(F.col("rel_path").alias("home"), F.col("path").alias("home_path"))
    holders = uses.join(home, F.col("named.rel_path") == F.col("home"), "left")
    empty = F.lit(None).cast(NODES["metadata"].dataType)
    placeholders = shape(holders.select(place(0).alias("place"), F.col("to").alias("id"), F.col("expr").alias("name"), F.coalesce("named.qualified", "expr").alias("qualified_name"), F.col("kind").alias("type"), F.lit("python").alias("language"), F.coalesce("home_path", "path").alias("file"), none.cast("int").alias("line_start"), none.cast("int").alias("line_end"), empty.alias("metadata"), F.lit(True).alias("imported")))

    wanted = any_of(F.endswith("rel_path", F.lit(s)) for s in framework.template_suffixes) if framework.template_suffixes else F.lit(False)
    templates = files.where(wanted)
    t_nodes = template_nodes(templates).join(templates.select("rel_path", "path", "content"), "rel_path").withColumn("seq", F.lit(0))
    t_edges = template_edges(templates, framework.has_template_patterns).join(paths, "rel_path").withColumn("seq", F.col("seq") + 1)
    default = lambda mass, energy=0.5, coupling=0.5: F.struct(mass.alias("mass"), F.lit(1.0).alias("charge"), F.lit(0.5).alias("spin"), energy.alias("energy"), coupling.alias("coupling"), F.lit(1.0).alias("lifetime"), F.col("path").alias("file"), F.lit(0).alias("lines"), none.cast("int").alias("line_start"), none.cast("int").alias("line_end"), none.cast(NODES["metadata"].dataType["metrics"].dataType).alias("metrics"), F.lit("file").alias("metric_scope"))
    half = F.lit(0.5)
    front = shape(t_nodes.select(place(1).alias("place"), "id", "name", "qualified_name", "type", "language", F.col("path").alias("file"), "line_start", "line_end", default(scores.template_mass(F.col("content")), half, half).alias("metadata"), F.lit(False).alias("imported")))
    ajax = F.col("target_type") == "AJAX"
    own_mass = F.when(F.col("target_type") == "JAVASCRIPT", F.lit(0.3)).otherwise(F.lit(1.0))
    shown = F.when(F.col("target_type").isin("OBSERVATION", "JAVASCRIPT"), F.concat("rel_path", F.lit("::"), "name")).otherwise(F.col("name"))
    parts = shape(t_edges.select(place(1).alias("place"), F.col("target").alias("id"), "name", shown.alias("qualified_name"), F.col("target_type").alias("type"), "language", F.col("path").alias("file"), none.cast("int").alias("line_start"), none.cast("int").alias("line_end"), default(own_mass, F.when(ajax, F.lit(1.0)).otherwise(half), F.when(ajax, F.lit(0.7)).otherwise(half)).alias("metadata"), F.lit(False).alias("imported")))
    nodes = real.unionByName(placeholders).unionByName(front).unionByName(parts)
    nodes = upsert_nodes(nodes.withColumnRenamed("place", "node_idx"))
    # a file's number, and the place within it
    nodes = _number(nodes, "node_idx").drop("imported")

    columns = ["place", "source", "target", "type", "confidence", "resolution", "line"]
    flat = lambda df: df.select(*columns)
    contains = d.where("kind = 'method'").select(place(0).alias("place"), python_id(F.col("module"), F.lit(""), F.col("parent")).alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("type"), none.cast("double").alias("confidence"), none.cast("string").alias("resolution"), none.cast("int").alias("line"))
    calls = resolve_calls(facts, names).select(place(0).alias("place"), "source", "target", F.lit("CALL").alias("type"), "confidence", "resolution", "line")
    used = uses.select(place(0).alias("place"), "source", F.col("to").alias("target"), F.col("edge").alias("type"), none.cast("double").alias("confidence"), none.cast("string").alias("resolution"), none.cast("int").alias("line"))
    linked = t_edges.select(place(1).alias("place"), "source", "target", "type", none.cast("double").alias("confidence"), none.cast("string").alias("resolution"), none.cast("int").alias("line"))
    edges = flat(contains).unionByName(flat(calls)).unionByName(flat(used)).unionByName(flat(linked)).withColumnRenamed("place", "edge_idx")
    edges = _number(dedup_edges(edges), "edge_idx")
    return normalize_nodes(nodes), normalize_edges(edges.select(*[c for c in EDGES.names if c in edges.columns]))


def _number(df: DataFrame, column: str) -> DataFrame:
    """``column`` (a place: code or template, file, sequence) as a long in the same order: files are numbered by ranges, sequences follow within."""
    files = df.select(F.col(f"{column}.k").alias("k"), F.col(f"{column}.rel_path").alias("f")).distinct().withColumn("one", F.lit(1))
    files = global_prefix(materialize(files, "file-order"), ["k", "f"], "one", "no", shuffle_partitions(df.sparkSession)).drop("one")
    joined = df.join(files, (F.col(f"{column}.k") == F.col("k")) & (F.col(f"{column}.rel_path") == F.col("f")))
    return joined.withColumn(column, F.col("no").cast("long") * (1 << 32) + F.col(f"{column}.seq")).drop("k", "f", "no")
