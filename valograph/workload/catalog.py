"""All registered queries."""

from __future__ import annotations

from valograph.workload import rankings, relations, scalars, texts  # noqa: F401  (importing registers the queries)
from valograph.workload.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
