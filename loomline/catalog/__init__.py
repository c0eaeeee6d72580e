"""All registered queries. Importing the modules fills the registry."""

from __future__ import annotations

from importlib import import_module

MODULES = ("rows", "folds", "text", "graphs", "files", "streams")


def load_all():
    from loomline.catalog.registry import ORACLES, QUERIES
    for name in MODULES:
        import_module(f"loomline.catalog.{name}")
    return QUERIES, ORACLES
