"""Registered queries over the driver's tables and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # Importing a plan module registers its queries.
    from casewright.plans import account_queries, case_queries, task_queries  # noqa: F401
    from casewright.plans.registry import PLANS

    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    from casewright.plans import account_oracle, case_oracle, task_oracle
    from casewright.plans.oracle_views import with_views

    texts = {**case_oracle.ORACLE, **task_oracle.ORACLE, **account_oracle.ORACLE}
    return {name: with_views(sql) for name, sql in texts.items()}
