"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import importlib

#: Modules with NAME, query and SQL (None where SQL cannot express the result).
MODULES = ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13")

QUERIES, ORACLES = {}, {}
for _module in MODULES:
    _m = importlib.import_module(f"tidemark.llm.{_module}")
    QUERIES[_m.NAME] = _m.query
    if _m.SQL is not None:
        ORACLES[_m.NAME] = _m.SQL
