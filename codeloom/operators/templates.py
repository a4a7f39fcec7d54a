"""Nodes and edges of templates, by regular expressions over whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import prefixed

# What is looked for in a template, as Java patterns ((?U): word characters of all scripts).
PATTERNS = {
    "variables": r"(?U)\{\{\s*([\w.]+)\s*\}\}",
    "js_functions": r"(?U)function\s+(\w+)\s*\(",
    "arrow_functions": r"(?U)(\w+)\s*=\s*(?:async\s+)?(?:function\s*\([^)]*\)|\([^)]*\))\s*=>",
    "fetch_calls": r"""fetch\s*\(\s*['"]([^'"]+)['"]""",
    "async_functions": r"(?U)async\s+function\s+(\w+)",
    "event_listeners": r"""addEventListener\s*\(\s*['"]([^'"]+)['"]""",
}
GLOBALS = ("console", "document", "window", "navigator")
LIBRARIES = (("Leaflet", r"L\.(map|marker)\("), ("jQuery", r"\$\(|jQuery"), ("Bootstrap", r"(?i)bootstrap"), ("Axios", r"axios"))


def found(content: Column, kind: str) -> Column:
    names = F.regexp_extract_all(content, F.lit(PATTERNS[kind]), F.lit(1))
    if kind == "variables":
        return F.transform(names, lambda n: F.split_part(n, F.lit("."), F.lit(1)))
    if kind == "arrow_functions":
        return F.filter(names, lambda n: ~n.isin(*GLOBALS))
    if kind == "event_listeners":
        return F.transform(names, lambda n: F.concat(n, F.lit("_handler")))
    return names


def libraries(content: Column) -> Column:
    return F.array_compact(F.array(*[F.when(content.rlike(p), F.lit(n)) for n, p in LIBRARIES]))


def template_edges(files: DataFrame, patterns: bool = True) -> DataFrame:
    """(rel_path, seq, source, target, target_type, name, type, language): distinct relations of each template, the first of each kept.

    ``files`` has rel_path and content. Without ``patterns`` only libraries are looked for.
    """
    path, seq = F.col("rel_path"), F.col("pos")
    kinds = [
        ("variables", "OBSERVATION", "OBSERVATION", "template", lambda n: prefixed("template-symbol", path, n)),
        ("js_functions", "JAVASCRIPT", "EVENT", "javascript", lambda n: prefixed("javascript", path, n)),
        ("arrow_functions", "JAVASCRIPT", "EVENT", "javascript", lambda n: prefixed("javascript", path, n)),
        ("fetch_calls", "AJAX", "AJAX", None, lambda n: prefixed("ajax", n)),
        ("async_functions", "JAVASCRIPT", "VIRTUAL", "javascript", lambda n: prefixed("javascript", path, n)),
        ("event_listeners", "JAVASCRIPT", "EVENT", "javascript", lambda n: prefixed("javascript", path, n)),
    ]
    base = files.where("coalesce(content, '') <> ''").select("rel_path", "content")
    lists = [_tagged(found(F.col("content"), k), i) for i, (k, *_) in enumerate(kinds)] if patterns else []
    hits = base.select("rel_path", F.posexplode(F.concat(*lists, _tagged(libraries(F.col("content")), len(kinds)))).alias("pos", "hit"))
    name, k = F.col("hit.name"), F.col("hit.k")
    pick = lambda values, other: _choose(k, values, other)
    out = hits.select(
        "rel_path", seq.alias("seq"), prefixed("template", path).alias("source"), pick([f(name) for *_, f in kinds], prefixed("dependency", name)).alias("target"),
        pick([F.lit(t) for _, t, *_ in kinds], F.lit("DEPENDENCY")).alias("target_type"), name.alias("name"), pick([F.lit(e) for _, _, e, *_ in kinds], F.lit("DEPENDENCY")).alias("type"),
        pick([F.lit(x).cast("string") for _, _, _, x, _ in kinds], F.lit(None).cast("string")).alias("language"),
    )
    return out.groupBy("rel_path", "source", "target", "type").agg(F.min_by(F.struct("seq", "target_type", "name", "language"), "seq").alias("h")).select("rel_path", "h.seq", "source", "target", "h.target_type", "h.name", "type", "h.language")


def _tagged(names: Column, k: int) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(k).alias("k"), n.alias("name")))


def _choose(k: Column, values: list[Column], other: Column) -> Column:
    out = F.when(F.lit(False), other)
    for i, v in enumerate(values):
        out = out.when(k == i, v)
    return out.otherwise(other)


def template_nodes(files: DataFrame) -> DataFrame:
    """A FRONTEND node per template, spanning its lines."""
    name = F.element_at(F.split("rel_path", "/"), -1)
    text = F.regexp_replace("content", "\\r\\n|\\r", "\n")
    lines = F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0)
    return files.where("coalesce(content, '') <> ''").select(prefixed("template", F.col("rel_path")).alias("id"), name.alias("name"), F.col("rel_path").alias("qualified_name"), F.lit("FRONTEND").alias("type"), F.lit("template").alias("language"), F.lit(1).alias("line_start"), F.greatest(lines, F.lit(1)).alias("line_end"), "rel_path")
