"""All registered queries of the library and their SQL equivalents."""

from __future__ import annotations

from .plans import queries_geometry, queries_relational, queries_thermo, queries_training  # noqa: F401  they register on import
from .plans.registered import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
