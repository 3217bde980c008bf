"""Named query plans over the tables of a folder."""

from __future__ import annotations

from importlib import import_module

from .registry import Registry, table

#: Modules of this folder that hold queries.
MODULES = ("shredding", "retrieval", "evaluation", "ingest", "documents", "telemetry", "pages", "books", "contracts")


def all_queries() -> Registry:
    registry = Registry()
    for name in MODULES:
        registry.update(import_module(f"{__name__}.{name}").REGISTRY)
    return registry


__all__ = ["Registry", "all_queries", "table"]
