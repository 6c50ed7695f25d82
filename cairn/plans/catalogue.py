"""All queries of the engine and the SQL that each must equal."""

from __future__ import annotations

from cairn.plans import chunks, conversations, scalars, search  # noqa: F401
from cairn.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
