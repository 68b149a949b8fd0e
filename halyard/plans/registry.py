"""All registered queries of the photo operators, with their DuckDB SQL."""

from __future__ import annotations

from . import features, learning, media, stored, timeline

MODULES = [features, timeline, learning, media, stored]


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
