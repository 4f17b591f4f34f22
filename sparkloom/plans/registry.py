"""All queries of the core, by name."""

from __future__ import annotations

import importlib
import pkgutil

import sparkloom.plans as plans


def collect(package) -> tuple[dict, dict]:
    """QUERIES and SQL of every module of a package that has them."""
    queries, sql = {}, {}
    for info in sorted(pkgutil.iter_modules(package.__path__), key=lambda i: i.name):
        module = importlib.import_module(f"{package.__name__}.{info.name}")
        queries |= getattr(module, "QUERIES", {})
        sql |= getattr(module, "SQL", {})
    return queries, sql


def core() -> tuple[dict, dict]:
    return collect(plans)
