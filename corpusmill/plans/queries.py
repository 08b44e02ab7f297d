"""Registry of the core queries and of their SQL statements."""

from __future__ import annotations

from importlib import import_module

MODULES = ["skew", "corpus", "evaluation", "sequence", "languages", "code"]


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"corpusmill.plans.{name}"), what).items():
            assert key not in found, key
            found[key] = value
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict:
    return _gather("ORACLES")
