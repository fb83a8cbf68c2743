"""The list of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from adfacts.plans.fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def register(name: str, views: str, sql: str | None = None, heavy: bool = False):
    """Add a query. It is called with the DataFrames of ``views``, in that order.

    ``heavy`` marks much work per row: a source with few splits is spread over all cores.
    """

    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(*[view(spark, sf_dir, v, heavy) for v in views.split()])

        QUERIES[name] = query
        if sql is not None:
            CHECKS[name] = with_views(views, sql)
        return build

    return add
