"""Registered queries: one per operator, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from wardwise.catalog.registry import QUERIES, SQL, compose  # noqa: F401

SECTIONS = [
    "scans", "joins", "truth", "estimates", "tables", "bins", "representation", "order", "samples", "shapes",
    "metrics", "space", "census", "models", "resume",
]


def load() -> None:
    """Imports every section, which registers its queries."""
    for section in SECTIONS:
        import_module(f"wardwise.catalog.{section}")
    compose()
