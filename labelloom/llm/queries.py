"""Queries of the llm subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict = {}
for _name in ("leaks", "listings", "lookalikes", "names", "packing", "scanned", "spans"):
    _m = importlib.import_module(f"labelloom.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLE |= getattr(_m, "ORACLE", {})
