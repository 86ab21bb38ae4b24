"""Registered queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from lexigrid.plans import cleaning, corpus, evaluation, extras, graphs, labels, probe, reports  # noqa: F401  (they register their queries)
from lexigrid.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
