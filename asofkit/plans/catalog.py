"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from . import queries_jobs, queries_market, queries_more, queries_records, queries_rules, queries_tables  # noqa: F401  they register themselves
from .registry import QUERIES, TWINS


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
