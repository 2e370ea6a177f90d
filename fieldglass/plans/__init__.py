"""Registered queries: each runs an operator over whole tables.

``catalog()`` gives every query with the SQL that must agree with it.
"""

from __future__ import annotations

from fieldglass.plans.registry import ORACLES, QUERIES


def catalog() -> tuple[dict, dict]:
    from fieldglass.plans import documents, files, records, tables  # noqa: F401  (registration)

    return dict(QUERIES), dict(ORACLES)
