"""Confidences, labels and physics-like metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence of an edge that names none, by type.
EDGE_CONFIDENCE = {
    "PARTICLE_ENTANGLEMENT": 0.98, "SERIALIZER_ENTANGLEMENT": 0.98, "CALL": 0.88, "AJAX": 0.82,
    "DEPENDENCY": 0.78, "EVENT": 0.72, "OBSERVATION": 0.65, "VIRTUAL": 0.58,
}


def unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double")))


def edge_confidence(confidence: Column, kind: Column) -> Column:
    by_type = F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_CONFIDENCE.items() for x in kv]), kind)
    return F.when(confidence.isNotNull(), unit(confidence)).otherwise(F.coalesce(by_type, F.lit(0.5)))


def label(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.55, "medium").otherwise("low")


def status(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "strong_candidate").when(confidence >= 0.55, "likely_candidate").otherwise("possible_candidate")


def mass(loc: Column, cyclomatic: Column, calls: Column, fields: Column, relations: Column, kind: Column) -> Column:
    base = F.lit(0.2) + F.least(loc, F.lit(200.0)) / 100.0 + (cyclomatic - 1.0) * 0.12 + calls * 0.03
    extra = F.when(kind == "PARTICLE", fields * 0.08 + relations * 0.16).when(kind == "TRANSFORM", fields * 0.05).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(2.0), F.greatest(F.lit(0.1), base + extra)), 2)


def energy(calls: Column, cyclomatic: Column) -> Column:
    return F.round(F.least(F.lit(1.5), F.lit(0.35) + F.least(calls, F.lit(20.0)) * 0.04 + F.least(cyclomatic, F.lit(15.0)) * 0.025), 2)


def coupling(calls: Column, relations: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.lit(0.25) + F.least(calls + relations, F.lit(15.0)) * 0.04), 2)


def charge(relations: Column, kind: Column) -> Column:
    return F.when(kind == "PARTICLE", F.round(F.least(F.lit(1.25), F.lit(1.0) + relations * 0.05), 2)).otherwise(F.lit(1.0))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def template_mass(content: Column) -> Column:
    """Mass of a template from its variables, tags and functions; 0.5 when empty."""
    count = lambda pattern: F.size(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)))
    value = F.lit(0.3) + count(r"\{\{\s*[\w.]+\s*\}\}") * 0.05 + count(r"\{%\s*[^%]+\s*%\}") * 0.1 + count(r"function\s+\w+") * 0.15
    return F.when(F.coalesce(content, F.lit("")) == "", F.lit(0.5)).otherwise(F.round(F.least(F.lit(2.0), value), 2))


def model_mass(content: Column) -> Column:
    relations = occurrences(content, "ForeignKey") + occurrences(content, "ManyToManyField")
    value = F.lit(0.5) + occurrences(content, "models.") * 0.1 + relations * 0.2
    return F.when(F.coalesce(content, F.lit("")) == "", F.lit(1.0)).otherwise(F.round(F.least(F.lit(2.0), value), 2))


def view_mass(content: Column, name: Column) -> Column:
    filled = F.size(F.filter(F.split(content, "\\r\\n|\\r|\\n"), lambda x: F.trim(x) != ""))
    value = F.least(filled / 100.0, F.lit(2.0))
    for word, bonus in (("CreateView", 0.3), ("UpdateView", 0.2), ("ListView", 0.1), ("DetailView", 0.1)):
        value = value + F.when(F.contains(name, F.lit(word)), F.lit(bonus)).otherwise(F.lit(0.0))
    return F.when(F.coalesce(content, F.lit("")) == "", F.lit(1.0)).otherwise(F.round(F.least(F.lit(2.0), value), 2))
