"""All queries by name, and their SQL."""

from __future__ import annotations

from calltide.plans import contacts, dashboards, events, governance, health, ingest, layouts, more, resolution, schema  # noqa: F401
from calltide.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
