"""Import every query module so the registry is complete."""
from __future__ import annotations

from stockgrid.plans import core, incremental, master, quality, reports, views  # noqa: F401
from stockgrid.plans.registry import REGISTRY  # noqa: F401


def queries():
    return {name: q.build for name, q in REGISTRY.items()}


def oracle_sql():
    return {name: q.oracle for name, q in REGISTRY.items() if q.oracle is not None}
