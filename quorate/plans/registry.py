"""Registered queries: name -> (callable(spark, folder) -> DataFrame, SQL text or None)."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        REGISTRY[name] = (fn, oracle)
        return fn
    return wrap


def load() -> dict[str, tuple[Callable, str | None]]:
    import importlib
    for mod in ("corpus", "match", "score", "drift", "features", "models", "stream"):
        try:
            importlib.import_module(f"quorate.plans.{mod}")
        except ModuleNotFoundError as exc:
            if exc.name != f"quorate.plans.{mod}":
                raise
    return REGISTRY
