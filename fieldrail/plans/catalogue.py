"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from . import batches, documents, exports, extraction, intake, policies, reports, retries, summaries

_PLANS = (reports, extraction, summaries, policies, exports, retries, batches, documents, intake)


def queries() -> dict:
    return {name: q for plan in _PLANS for name, q in plan.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
