"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestack.llm import queries as _queries
from lodestack.llm import sql


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracles() -> dict[str, str]:
    return dict(sql.ORACLES)
