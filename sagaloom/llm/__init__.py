"""Operators for preparing training text, with their queries. Nothing outside this folder imports it."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and SQL, by problem.
_QUERY_MODULES = ("chunk_queries", "record_queries", "document_queries")


def query_modules() -> list:
    """The modules whose queries the driver's contract offers."""
    return [import_module(f"{__name__}.{m}") for m in _QUERY_MODULES]
