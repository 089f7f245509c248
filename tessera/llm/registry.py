"""Queries and SQL of this subpackage, gathered from its operator modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality_ledger", "mixing", "url_filter", "minhash", "packing", "pii", "vector_graph", "pu_quality", "quotes", "ngram_lm", "pieces", "lexical", "spelling")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
