"""Registered queries: one or more per operator, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import cleaning, compare, embeddings, features, graph, prediction, questions, rounds, sources, splits, streams

MODULES = [sources, cleaning, features, splits, graph, embeddings, prediction, rounds, questions, compare, streams]


def entries() -> dict:
    """``{name: (function of Graphs, sql or None)}`` in module order."""
    out: dict = {}
    for module in MODULES:
        for name, entry in module.CATALOG.items():
            if name in out:
                raise ValueError(f"query '{name}' is registered twice")
            out[name] = entry
    return out
