"""All named queries of the engine, by operator family."""

from __future__ import annotations

import importlib

#: Modules of quillspark.plans; each has QUERIES and ORACLES.
FAMILIES: list[str] = ["relational", "predicates", "retrieval", "knowledge", "documents", "requests"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in FAMILIES:
        out |= getattr(importlib.import_module(f"quillspark.plans.{name}"), attribute)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
