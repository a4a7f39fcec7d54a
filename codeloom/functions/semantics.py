"""Tokens, subjects, intents and roles of node ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the semantic operators.
INTENTS = {
    "create": ("create", "new", "add", "post", "insert"),
    "read": ("read", "retrieve", "detail", "show", "get", "list", "index", "all", "search"),
    "update": ("update", "edit", "patch", "put", "modify"),
    "delete": ("delete", "destroy", "remove"),
}
STOP_TOKENS = ("view", "views", "apiview", "controller", "serializer", "schema", "model", "service", "helper", "manager", "handler", "endpoint", "api", "form", "resource")
PROFILED_TYPES = ("VERTEX", "TRANSFORM", "PARTICLE", "MEDIATOR", "FRONTEND")
SUBJECT_SUFFIXES = ("Serializer", "Schema", "Model")
VIEW_SUFFIXES = ("CreateView", "UpdateView", "DeleteView", "DetailView", "ListView", "View", "Controller")


def tokens(node_id: Column) -> Column:
    """Sorted distinct lower-case words of an id, cut at capitals and other characters than letters and digits."""
    words = F.transform(F.split(F.regexp_replace(node_id, r"(?<!^)(?=[A-Z])", " "), r"[^A-Za-z0-9]+"), lambda w: F.lower(w))
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(F.lit(""), *[F.lit(w) for w in STOP_TOKENS])))


def strip_suffix(value: Column, suffixes: tuple[str, ...]) -> Column:
    """Without the first of ``suffixes`` that ends the value."""
    out = F.lit(None)
    for s in suffixes:
        cut = F.when(F.endswith(value, F.lit(s)), F.substr(value, F.lit(1), F.length(value) - len(s)))
        out = F.coalesce(out, cut)
    return F.coalesce(out, value)


def subject(value: Column) -> Column:
    """A model-like name: suffix stripped, words capitalised and joined."""
    spaced = F.trim(F.regexp_replace(strip_suffix(value, SUBJECT_SUFFIXES), r"[^A-Za-z0-9]+", " "))
    return F.replace(F.initcap(spaced), F.lit(" "), F.lit(""))


def intent(node_id: Column, node_type: Column, words: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, aliases in INTENTS.items():
        out = out.when(F.arrays_overlap(words, F.array(*[F.lit(a) for a in aliases])), name)
    for name, aliases in INTENTS.items():
        out = out.when(F.lower(node_id).rlike("|".join(aliases)), name)
    return out.when(node_type == "TRANSFORM", "transform").when(node_type == "PARTICLE", "data_model").when(node_type == "FRONTEND", "interface").otherwise("generic")


def role(node_type: Column, what: Column, has_subject: Column) -> Column:
    return (
        F.when((node_type == "VERTEX") & (has_subject | what.isin(*INTENTS)), "crud_interface")
        .when(node_type == "TRANSFORM", "data_transform")
        .when(node_type == "PARTICLE", "data_model")
        .when((node_type == "MEDIATOR") & has_subject, "data_service")
        .when(node_type == "FRONTEND", "frontend_surface")
        .otherwise("supporting_logic")
    )
