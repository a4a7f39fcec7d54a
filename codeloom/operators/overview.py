"""Architecture overviews, neighbourhoods and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").count()


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).where("coalesce(id, '') <> ''")


def degrees(edges: DataFrame) -> DataFrame:
    return _ends(edges).groupBy("id").agg(F.count("*").alias("degree"))


def most_connected(edges: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` ids with most edges; ties by id."""
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(n)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids without any edge."""
    return nodes.select("id").distinct().join(_ends(edges).distinct(), "id", "left_anti")


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolated nodes."""
    one = nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))  # one row each
    return one.crossJoin(isolated(nodes, edges).agg(F.count("*").alias("isolated_count")))


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, neighbour, direction, type) of the edges at ``ids.id``, distinct."""
    own = ids.select("id").distinct()
    out = edges.join(own, F.col("source") == own["id"]).select(own["id"], F.col("target").alias("neighbour"), F.lit("out").alias("direction"), "type")
    into = edges.join(own, F.col("target") == own["id"]).select(own["id"], F.col("source").alias("neighbour"), F.lit("in").alias("direction"), "type")
    return out.unionByName(into).distinct()


def in_file(nodes: DataFrame, file_name: str) -> DataFrame:
    """Nodes whose file is ``file_name`` (compared as a whole)."""
    return nodes.where(F.col("file") == file_name)


def first_edge_by_type(edges: DataFrame, place: str | None = None) -> DataFrame:
    """(source, type, target) of the first edge of each type from each node.

    Of edges with one ``edge_idx`` that of the least ``place`` (any column that can be compared) is the first, then that
    of the least target. Edges without a number or a target are passed over.
    """
    order = F.struct("edge_idx", *[place] * (place is not None), "target")
    return edges.groupBy("source", "type").agg(F.min_by("target", F.when(F.col("edge_idx").isNotNull() & F.col("target").isNotNull(), order)).alias("target"))


def targets_by_type(edges: DataFrame, kind: str) -> DataFrame:
    """(source, targets): targets of edges of one type, in order."""
    both = F.array_sort(F.collect_list(F.struct("edge_idx", "target")))
    return edges.where(F.col("type") == kind).groupBy("source").agg(F.transform(both, lambda x: x["target"]).alias("targets"))


def suggestions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level, message): heavy views, and models without edges."""
    heavy = nodes.where((F.col("type") == "VERTEX") & (F.col("metadata.mass") > 1.5)).select("id", F.lit("warning").alias("level"), F.concat(F.lit("High complexity: "), "id").alias("message"))
    alone = nodes.where("type = 'PARTICLE'").join(_ends(edges).distinct(), "id", "left_anti").select("id", F.lit("info").alias("level"), F.concat(F.lit("Isolated model: "), "id").alias("message"))
    return heavy.unionByName(alone)


def unused_imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Views in files named after models that use no model."""
    views = nodes.where((F.col("type") == "VERTEX") & F.coalesce(F.col("file"), F.lit("")).contains("models"))
    users = edges.where("type = 'PARTICLE_ENTANGLEMENT'").select(F.col("source").alias("id")).distinct()
    return views.join(users, "id", "left_anti").select("id", "file")


def guess_framework(nodes: DataFrame) -> DataFrame:
    """One row: what the graph's names look like."""
    django = F.bool_or((F.col("type") == "VERTEX") & F.col("id").contains("View"))
    flask = F.bool_or((F.col("type") == "PARTICLE") & F.coalesce(F.to_json("metadata"), F.lit("")).contains("db.Model"))
    return nodes.agg(F.when(django, "django").when(flask, "flask").otherwise("generic").alias("framework"))


def line_hint(text: Column) -> Column:
    """What to mind on an editor line; null if nothing."""
    return (
        F.when(text.contains("class ") & text.contains("View"), "Consider linking this view to a model and a serializer")
        .when(text.contains("models.") | text.contains("ForeignKey"), "Model change: check the views and serializers that use it")
        .when(F.lower(text).contains("serializer"), "Check that the serializer's fields match its model")
    )


# The starting points offered for new components.
TEMPLATES = {
    ("django", "model"): """class {name}(models.Model):
    name = models.CharField(max_length=200)
    created_at = models.DateTimeField(auto_now_add=True)
    updated_at = models.DateTimeField(auto_now=True)

    class Meta:
        ordering = ["name"]

    def __str__(self):
        return self.name
""",
    ("django", "view"): """class {name}View(ListView):
    model = {name}
    template_name = "{lower}/list.html"


class {name}DetailView(DetailView):
    model = {name}
    template_name = "{lower}/detail.html"


class {name}CreateView(CreateView):
    model = {name}
    fields = ["name"]
    template_name = "{lower}/form.html"
    success_url = reverse_lazy("{lower}-list")
""",
    ("django", "serializer"): """class {name}Serializer(serializers.ModelSerializer):
    class Meta:
        model = {name}
        fields = ["id", "name", "created_at", "updated_at"]
        read_only_fields = ["id", "created_at", "updated_at"]
""",
    ("flask", "model"): """class {name}(db.Model):
    id = db.Column(db.Integer, primary_key=True)
    name = db.Column(db.String(200), nullable=False)
    created_at = db.Column(db.DateTime, default=datetime.utcnow)
    updated_at = db.Column(db.DateTime, default=datetime.utcnow, onupdate=datetime.utcnow)
""",
    ("flask", "view"): """@{lower}_bp.route("/{lower}s")
def list_{lower}():
    return render_template("{lower}/list.html", items={name}.query.all())


@{lower}_bp.route("/{lower}s/<int:id>")
def detail_{lower}(id):
    return render_template("{lower}/detail.html", item={name}.query.get_or_404(id))
""",
}


def component_template(framework: str, kind: str, name: str) -> str:
    text = TEMPLATES.get((framework, kind))
    return text.format(name=name, lower=name.lower()) if text else f"# no template for {framework} {kind}\n"
