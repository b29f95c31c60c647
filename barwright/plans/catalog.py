"""All queries over the shared tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib

from barwright.plans.registry import QUERIES, SQL, Query

FLAGSHIP = "ma_cross_lookahead"
MODULES = ("relational", "bars", "windows", "studies", "candles", "fib", "options", "text", "dates", "quality", "streams", "sources", "extras", "flow")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"barwright.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
