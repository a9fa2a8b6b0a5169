"""Registry of checked queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.plans.driver_sql import with_views
from vigilake.plans.driver_views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of `Views` under a name, with its SQL counterpart if any."""

    def register(plan: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: plan(Views(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql)
        return plan

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded so that summation order cannot show."""
    return df.select(
        *[
            F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
