"""Registered corpus queries and their oracle SQL; the modules hold both."""

from __future__ import annotations

from importlib import import_module

MODULES = ("suffix_dedup", "warc", "exact_dedup", "licenses", "quality", "pii", "mixing", "packing", "fingerprints", "near_dedup")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"brindle.llm.{_name}")
    QUERIES[_module.NAME] = _module.query
    if _module.ORACLE_SQL:
        ORACLE[_module.NAME] = _module.ORACLE_SQL
