"""Registered queries: each key has a Spark callable and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from cohortlens.catalog import cleaning, draws, models, panel, sources, tables

_PARTS = [sources, cleaning, panel, tables, draws, models]


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.ORACLES.items()}
