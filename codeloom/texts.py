"""Sentences of reports, and how they are filled in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences that results must equal, with {} for what is filled in.
SENTENCES = {
    # reachability
    "entry_type": "Node type {} is a recognized application entry surface.",
    "entry_path": "Source path {} is a conventional executable entry point.",
    "entry_main": "Top-level callable named main is a likely executable entry point.",
    "test_only": "Node is defined in test code or follows test naming conventions.",
    "framework_path": "Source path {} is conventionally loaded by the framework.",
    "framework_hook": "Callable name {} matches a conventional framework hook.",
    "public_api": "Public symbol in __init__.py may be exported for external callers.",
    "dynamic": "Name or path suggests registration, callbacks, plugins, or dynamic loading.",
    "external": "Node represents an external, imported, or unresolved symbol.",
    "no_edges": "No incoming or outgoing graph edges were found.",
    "no_evidence": "No framework, test, public API, or dynamic-loading evidence was detected.",
    "no_callers": "Node has no incoming graph edges but may be called dynamically or externally.",
    "not_reached": "Node was not reached from known entry points, but existing graph evidence is insufficient to call it unused.",
    "reached": "Reachable from a recognized entry point through graph edges.",
    # change impact
    "no_lines": "Changed file matched node file; diff did not provide line-level evidence.",
    "no_span": "Changed file matched, but node source span is unavailable.",
    "overlap": "Changed lines [{}] overlap node source span {}.",
    "adjacent": "Changed line {} is adjacent to node source span {}.",
    "deleted": "Source file was deleted; node span could not be revalidated.",
    "candidates": "Impacted nodes are review candidates, not guaranteed breakages.",
    "depth": "Reverse dependency traversal was limited to {} hops.",
    "purpose": "Evidence-backed change-impact prediction. Results describe potential impact, not guaranteed breakage.",
    "model": "seed confidence multiplied by edge evidence and hop decay",
    # graph diagnostics
    "no_list": "{} must be a list",
    "no_object": "{} must be an object",
    "no_source": "node {}.source must be an object",
    "blank_id": "{}.id must be a non-empty string",
    "blank_end": "{}.{} must be a non-empty string",
    "node_type": "node {} uses unregistered type {}; preserved as an extension",
    "edge_type": "{} uses unregistered type {}; preserved as an extension",
    "duplicate_node": "duplicate node id: {}",
    "duplicate_edge": "duplicate edge id: {}",
    "confidence": "{}.confidence must be null or between 0 and 1",
    "missing_end": "{} references missing {} {}",
    # framework detection
    "manage": "manage.py is present",
    "settings": "Django-style settings.py is present",
    "urls": "Django-style urls.py is present",
    "imported": "{} imported in {}",
    "flask_app": "Flask application constructed in {}",
    "fastapi_app": "FastAPI application constructed in {}",
    "router": "APIRouter used in {}",
    "route": "route decorator used in {}",
    "method": "HTTP method decorator used in {}",
    "dependency": "{} dependency found in {}",
    "none_found": "No supported framework evidence was found.",
}


def say(name: str, *parts: Column | str) -> Column:
    """The sentence with its gaps filled, as a column."""
    first, *rest = SENTENCES[name].split("{}")
    pieces = [F.lit(first)]
    for part, text in zip(parts, rest, strict=True):
        pieces += [F.lit(part) if isinstance(part, str) else part, F.lit(text)]
    return F.concat(*pieces)
