"""Registry of the training-data queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_splits", "q_neardup", "q_provenance", "q_overlap", "q_syntax", "q_texts", "q_truncation", "q_licenses"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"corpusmill.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
