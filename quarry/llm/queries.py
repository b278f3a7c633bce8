"""The subpackage's queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: One module for each operator, in the order of the operators.
MODULES = ("suffixes", "windows", "langid", "mixing", "pieces", "pii", "warc", "features", "simhash", "mtree")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"quarry.llm.{name}"), what, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
