"""The registered queries over formats, texts, layouts and pictures, and their SQL."""

from __future__ import annotations

from . import layouts, objects, plans, texts  # noqa: F401  (each module registers its queries)
from .plans import SQL, Q


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
