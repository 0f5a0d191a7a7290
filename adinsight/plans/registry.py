"""Registration of queries: an operator call over sample facts, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adinsight.operators import trends
from adinsight.plans.sample_facts import Facts, with_views

QUERIES: dict[str, Callable[[Facts], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[Facts], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name!r} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = with_views(sql)


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Callable[[Facts], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(Facts(spark, sf_dir))

    return {name: bind(query) for name, query in QUERIES.items()}


def as_of(f: Facts) -> Column:
    return trends.latest_complete_month(f["fx_uploads"]).scalar()


def current(f: Facts) -> Column:
    """The month under review, as a literal.

    It is one row of the small table of months the account covers, resolved once:
    as a subquery it would be planned anew for every use.
    """
    row = trends.current_month(f["fx_months"], as_of(f)).first()
    return F.lit(row[0] if row else None).cast("date")


def last_month(f: Facts) -> Column:
    """The newest month of the series, even if it is only partly covered; as a literal, too."""
    return F.lit(f["fx_months"].agg(F.max("month_start")).first()[0]).cast("date")
