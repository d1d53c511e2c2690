"""Registry of the queries run against the driver tables.

Each registered callable takes ``(spark, sf_dir)`` and returns a DataFrame over
the whole input tables. Where an equivalent SQL statement exists it is stored
next to it (DuckDB dialect, run by the correctness check against the same
parquet files).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


PLAN_MODULES = ("vector_queries", "text_queries", "phrase_queries", "store_queries",
                "relevance_queries", "source_queries", "provider_queries", "cbow_queries", "border_queries", "lexicon_queries", "index_queries")


def load_all() -> None:
    """Import every plan module so that its queries register; a module that
    cannot be imported is an error."""
    import importlib

    for mod in PLAN_MODULES:
        importlib.import_module(f"{__package__}.{mod}")
