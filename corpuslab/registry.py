"""Name -> query builder, and name -> the same query as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a builder (spark, sf_dir) -> DataFrame, with its SQL where SQL can express it."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def load() -> None:
    import importlib

    for name in ("corpora", "similarity", "splits", "evaluation", "runs", "audits", "tone", "sources", "heads"):
        importlib.import_module(f"corpuslab.queries.{name}")


load()
