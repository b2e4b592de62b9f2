"""All queries on the driver's tables, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from . import area, keypoints, pixels, streams, tables

_MODULES = (area, tables, pixels, keypoints, streams)


def queries() -> dict:
    return {name: f for m in _MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
