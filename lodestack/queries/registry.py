"""All queries outside the llm subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from lodestack.queries import changes, content, maintenance, search

_MODULES = (search, content, maintenance, changes)


def queries() -> dict:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
