"""Registry of runnable queries over the shared test tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    survey: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, survey: str, oracle: str | None = None):
    """Register a query under ``name``; ``oracle`` is the same result in plain SQL."""

    def register(fn):
        if name in REGISTRY:
            raise KeyError(f"query registered twice: {name}")
        REGISTRY[name] = Query(name, survey, fn, oracle)
        return fn

    return register


def load_all() -> dict[str, Query]:
    """Import every catalog module and return the filled registry."""
    import importlib
    import pkgutil

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return REGISTRY
