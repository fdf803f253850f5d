"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, rounded: Sequence[str] = (), digits: int = 6) -> Callable[[Query], Query]:
    """Adds a query, and the SQL whose rows it must return where SQL can express it.

    Sums of floats depend on the order of rows: the columns in `rounded` are rounded on both sides.
    """

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = query
        if rounded:
            _QUERIES[name] = lambda spark, root: query(spark, root).withColumns({c: F.round(c, digits) for c in rounded})
        if oracle is not None:
            changes = ", ".join(f"round({c}, {digits}) AS {c}" for c in rounded)
            _ORACLES[name] = f"SELECT * REPLACE ({changes}) FROM ({oracle})" if rounded else oracle
        return query

    return add


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    """Importing a plan module registers its queries."""
    from prospectra.plans import aggregates, boards, history, identities, matching, models, probability, production, ranking, refresh, rooms, rules, scalars, statistics, texts  # noqa: F401
