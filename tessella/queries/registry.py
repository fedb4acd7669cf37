"""All registered queries of the library."""

from __future__ import annotations

from tessella.queries import metadata, more, passthrough, retrieval, semantic, text  # noqa: F401
from tessella.queries.base import ORACLES, QUERIES
from tessella.queries.semantic import flagship


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["flagship", "oracle_sql", "queries"]
