"""Registered queries: a Spark plan per key and, where SQL can express it, its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.plans.lab_views import Lab

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and integers as bigint, so that both engines present the same types."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double").alias(field.name)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def query(build: Callable[[Lab], DataFrame]) -> Callable[[Lab], DataFrame]:
    """Register ``build`` under its function name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(build(Lab(spark, folder)))

    PLANS[build.__name__] = run
    return build
