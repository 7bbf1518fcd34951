"""Query plans over the corpus tables, by area."""

from importlib import import_module

_AREAS = ("data_quality", "review", "knowledge", "decks", "notes", "examples")


def _gather(what: str) -> dict:
    found: dict = {}
    for area in _AREAS:
        found |= getattr(import_module(f"cardmill.plans.{area}"), what)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def sql() -> dict:
    return _gather("SQL")
