"""Identity columns: paths, modules, node and edge ids, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def slashes(path: Column) -> Column:
    """Null becomes empty, backslashes become slashes."""
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    clean = slashes(path)
    return F.when(F.startswith(clean, F.lit(root)), F.substr(clean, F.lit(len(root) + 1))).otherwise(clean)


def module_name(rel_path: Column) -> Column:
    """``a/b/__init__.py`` is a.b; the root package is __root__."""
    dotted = F.replace(F.regexp_replace(rel_path, r"\.[^./]+$", ""), F.lit("/"), F.lit("."))
    dotted = F.regexp_replace(dotted, r"(^|\.)__init__$", "")
    return F.when(dotted == "", "__root__").otherwise(dotted)


def python_id(module: Column, parent: Column, name: Column) -> Column:
    return F.concat(F.lit("python:"), F.concat_ws(".", module, F.nullif(parent, F.lit("")), name))


def prefixed(kind: str, *parts: Column) -> Column:
    """``template:``, ``template-symbol:``, ``javascript:``, ``ajax:``, ``dependency:`` ids; parts joined by ``::``."""
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("::", *parts))


def unresolved_id(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("unresolved:"), F.lower(kind), F.lit(":"), name)


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    """``edge:`` and 16 hex digits of the SHA-256 of source, type and target between unit separators."""
    return F.concat(F.lit("edge:"), F.substr(F.sha2(F.concat_ws("\x1f", source, kind, target), 256), F.lit(1), F.lit(16)))


def import_module(module: Column, imported: Column, level: Column) -> Column:
    """The absolute module of a relative import: the last ``level`` parts of the current one go."""
    parts = F.split(module, r"\.")
    base = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - level))
    return F.when(level <= 0, imported).otherwise(F.array_join(F.concat(base, F.when(imported != "", F.array(imported)).otherwise(F.array().cast("array<string>"))), "."))


def numbered(prefix: str, n: Column) -> Column:
    """``prefix`` and the number in three digits or more."""
    text = n.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0")))


def major(version: Column) -> Column:
    return F.coalesce(F.split_part(version, F.lit("."), F.lit(1)).try_cast("int"), F.lit(0))
