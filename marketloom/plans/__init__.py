"""Registered queries: operators bound to the given tables, with SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("price", "browse", "merge", "scoring", "metrics", "ranking", "personas", "resolve", "combine", "text", "audit", "ingest", "vectors", "pages", "specs", "sheets", "forms", "reviews", "relevance", "stream")


def load() -> None:
    """Import every group, which registers its queries."""
    for group in GROUPS:
        import_module(f"marketloom.plans.{group}")
