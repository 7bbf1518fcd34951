"""Queries of the text operators and their SQL."""

from importlib import import_module

_MODULES = ("tokenizer", "mixing", "abuse", "site_lines", "near_duplicates", "scan_noise", "pair_defects")

QUERIES: dict = {}
SQL: dict = {}
for _name in _MODULES:
    _module = import_module(f"cardmill.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
