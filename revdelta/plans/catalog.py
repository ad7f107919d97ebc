"""The registered queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from revdelta.plans import comparing, keeping, reporting, reviewing, viewing, visual, wording

MODULES = (reporting, wording, visual, reviewing, viewing, comparing, keeping)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.ORACLES.items()}
