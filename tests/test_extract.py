"""Extraction, call resolution, metrics and framework detection on small source trees."""

from __future__ import annotations

import pytest

from codeloom.operators import frameworks, pyast, resolve, templates
from codeloom.sources.tree import read_tree


def project(spark, framework="generic", **files):
    df = spark.createDataFrame([(p.replace("__", "/").replace("_py", ".py").replace("_html", ".html"), t) for p, t in files.items()], "rel_path string, content string").selectExpr("rel_path", "rel_path AS path", "content")
    return resolve.build_graph(df, pyast.python_facts(df), frameworks.get(framework))


def calls(edges):
    return {(r.source.removeprefix("python:"), r.target.removeprefix("python:"), r.resolution) for r in edges.where("type = 'CALL'").collect()}


def test_rungs_of_call_resolution(spark):
    lib = "def helper():\n    pass\n\n\nclass Box:\n    def save(self):\n        self.check()\n\n    def check(self):\n        helper()\n"
    use = (
        "from pkg.lib import helper as h, Box\nimport pkg.lib as m\n\n\ndef a():\n    h()\n\n\ndef b():\n    m.helper()\n\n\ndef c():\n    x = Box()\n    x.save()\n\n\n"
        "def d():\n    Box().save()\n\n\ndef e():\n    Box.save(1)\n\n\ndef f(y: Box):\n    y.save()\n"
    )
    _, edges = project(spark, pkg__lib_py=lib, use_py=use)
    got = calls(edges)
    assert {("pkg.lib.Box.save", "pkg.lib.Box.check", "self_method"), ("pkg.lib.Box.check", "pkg.lib.helper", "name"), ("use.a", "pkg.lib.helper", "name"), ("use.b", "pkg.lib.helper", "qualified_import")} <= got
    assert {("use.c", "pkg.lib.Box.save", "local_instance"), ("use.d", "pkg.lib.Box.save", "constructed_instance"), ("use.e", "pkg.lib.Box.save", "class_method"), ("use.f", "pkg.lib.Box.save", "local_instance")} <= got
    assert ("use.c", "pkg.lib.Box", "name") in got


def test_ambiguous_names_give_no_edge(spark):
    same = "def run():\n    pass\n"
    nodes, edges = project(spark, a_py=same, b_py=same, c_py="def go():\n    run()\n", bad_py="def (:\n")
    assert calls(edges) == set()
    assert {r.id for r in nodes.collect()} == {"python:a.run", "python:b.run", "python:c.go"}


def test_models_placeholders_and_templates(spark):
    models = "from django.db import models\n\n\nclass User(models.Model):\n    a = models.CharField()\n    b = models.ForeignKey('x')\n"
    views = "from models import User\n\n\nclass UserView:\n    model = User\n    serializer_class = Missing\n\n    def get(self):\n        return User.objects.all()\n"
    page = "{{ user.name }}<script>function f(a) {} const g = (x) => x; async function h() { fetch('/api') } $(x)</script>"
    nodes, edges = project(spark, "django", models_py=models, views_py=views, t_html=page)
    types = {r.id: r.type for r in nodes.collect()}
    assert types["python:models.User"] == "PARTICLE" and types["python:views.UserView"] == "VERTEX" and types["unresolved:transform:Missing"] == "TRANSFORM"
    links = {(r.source, r.target, r.type) for r in edges.collect()}
    assert ("python:views.UserView.get", "python:models.User", "PARTICLE_ENTANGLEMENT") in links
    assert {(t, k) for s, t, k in links if s == "template:t.html"} == {
        ("template-symbol:t.html::user", "OBSERVATION"), ("javascript:t.html::f", "EVENT"), ("javascript:t.html::g", "EVENT"), ("javascript:t.html::h", "EVENT"),
        ("javascript:t.html::h", "VIRTUAL"), ("ajax:/api", "AJAX"), ("dependency:jQuery", "DEPENDENCY"),
    }
    row = nodes.where("id = 'python:models.User'").first()
    assert (row.metadata.metrics.field_count, row.metadata.metrics.relationship_count, row.line_start) == (2, 1, 4)


def test_metrics_leave_nested_functions_out():
    text = "def outer():\n    def inner():\n        for x in y:\n            f()\n    return inner\n\n\nclass A:\n    def big(self):\n        if a and b:\n            try:\n                g()\n            except E:\n                raise\n    def tiny(self):\n        pass\n"
    got = {(d["parent"], d["name"]): d["metrics"] for d in pyast.facts("x.py", text)["defs"]}
    assert (got["", "outer"]["cyclomatic_complexity"], got["", "outer"]["call_count"]) == (1, 0)
    assert (got["A", "big"]["cyclomatic_complexity"], got["A", "tiny"]["cyclomatic_complexity"]) == (4, 1)


@pytest.mark.parametrize(("files", "name"), [
    ({"manage.py": "import django\n"}, "django"),
    ({"app.py": "from flask import Flask\napp = Flask(__name__)\n\n\n@app.route('/')\ndef x():\n    pass\n"}, "flask"),
    ({"main.py": "from fastapi import FastAPI\napp = FastAPI()\n\n\n@app.get('/')\ndef x():\n    pass\n"}, "fastapi"),
    ({"a.py": "def f():\n    pass\n", "Gemfile": "rails\n"}, "generic"),
])
def test_framework_detection(spark, files, name):
    df = spark.createDataFrame(list(files.items()), "rel_path string, content string")
    facts = pyast.python_facts(df).selectExpr("rel_path", "all_imports AS imports", "called", "all_decorators AS decorators")
    got = frameworks.detect(df, facts).first()
    assert got.framework == name and (got.confidence >= 0.8 if name == "django" else (got.confidence == 0.0) == (name == "generic"))
    with pytest.raises(ValueError, match="unsupported"):
        frameworks.get("rails")


def test_read_tree_prunes_and_decodes(spark, tmp_path):
    for path, data in (("a.py", b"x = 1\n"), ("venv/b.py", b"y\n"), ("sub/c.py", b"\xff\xfe"), ("sub/d.txt", b"t")):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(data)
    got = {r.rel_path: r.content for r in read_tree(spark, str(tmp_path), (".py",)).collect()}
    assert got == {"a.py": "x = 1\n", "sub/c.py": None}


def test_template_lines_and_globals(spark):
    df = spark.createDataFrame([("p.html", "a\nb\n"), ("q.html", "console = () => 1; L.map(x)"), ("e.html", "")], "rel_path string, content string")
    assert {r.rel_path: r.line_end for r in templates.template_nodes(df).collect()} == {"p.html": 2, "q.html": 1}
    assert {r.target for r in templates.template_edges(df).collect()} == {"dependency:Leaflet"}
