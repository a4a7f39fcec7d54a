"""Roles, symbols and the compact notation of traces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The symbol of each role and of each property.
SYMBOLS = {
    "PROPAGATOR_HTTP": "g", "PROPAGATOR_AJAX": "em", "PROPAGATOR_SIGNAL": "w", "PROPAGATOR_ASYNC": "s",
    "VERTEX": "V", "VERTEX_COUPLING": "Vᶜ", "VERTEX_WEAK": "Vᵂ",
    "PARTICLE": "P", "PARTICLE_ANTIPARTICLE": "P̄", "PARTICLE_VIRTUAL": "P*", "PARTICLE_BOUND": "P₍",
    "TRANSFORM": "⊗", "TRANSFORM_UNITARY": "U", "TRANSFORM_HERMITIAN": "H",
    "VIRTUAL": "~", "MEDIATOR": "ψ", "FRONTEND": "𝔽", "JAVASCRIPT": "𝕁", "DEPENDENCY": "𝔻", "AJAX": "⚡", "EVENT": "🎯",
}
PROPERTIES = (("mass", "ₘ"), ("charge", "ᶜ"), ("spin", "ˢ"), ("energy", "ᴱ^"), ("coupling", "ᵏ^"), ("lifetime", "ᵗ"))
HTTP = {"mass": 0.1, "energy": 1.0, "coupling": 0.9}


def role_of(edge_type: Column, node_type: Column) -> Column:
    """The role of a node reached over an edge (null at the root)."""
    return (
        F.when(edge_type == "SERIALIZER_ENTANGLEMENT", "TRANSFORM")
        .when(edge_type == "PARTICLE_ENTANGLEMENT", "PARTICLE")
        .when(edge_type == "AJAX", "PROPAGATOR_AJAX")
        .otherwise(F.coalesce(node_type, F.lit("MEDIATOR")))
    )


def symbol_of(role: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv]), role), F.lit("?"))


def annotation(metadata: Column, keys=tuple(k for k, _ in PROPERTIES)) -> Column:
    """``{ₘ0.3,ᴱ^0.8}`` of the known properties that are not null; nothing if there is none."""
    shown = [F.concat(F.lit(s), metadata[k].cast("string")) for k, s in PROPERTIES if k in keys]
    body = F.concat_ws(",", *shown)
    return F.when(body != "", F.concat(F.lit("{"), body, F.lit("}"))).otherwise("")


def step(role: Column, name: Column, note: Column | None = None) -> Column:
    return F.concat(symbol_of(role), F.lit("["), name, F.lit("]"), note if note is not None else F.lit(""))


def category(role: Column) -> Column:
    """The list of a diagram that a role belongs to, besides interactions; null if none."""
    return (
        F.when(role.startswith("VERTEX") | (role == "MEDIATOR"), "vertices")
        .when(role.startswith("PROPAGATOR"), "propagators")
        .when(role.startswith("PARTICLE") | role.isin("FRONTEND", "JAVASCRIPT"), "particles")
    )


def diagram(trace: Column) -> Column:
    """A trace (array of structs with a role) as vertices, propagators, particles and interactions."""

    def only(kind: str) -> Column:
        return F.filter(trace, lambda x: category(x["role"]) == kind).alias(kind)

    return F.struct(only("vertices"), only("propagators"), only("particles"), trace.alias("interactions"))
