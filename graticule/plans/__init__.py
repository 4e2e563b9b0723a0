"""Queries over the provided tables, one per operator."""

import importlib

from graticule.plans import catalog

MODULES = ["cells", "aggregates", "splits", "evaluation", "grid", "climate", "spatial", "models"]


def _load():
    for name in MODULES:
        importlib.import_module(f"graticule.plans.q_{name}")


def all_queries():
    _load()
    return dict(catalog.QUERIES)


def all_sql():
    _load()
    return dict(catalog.SQL)
