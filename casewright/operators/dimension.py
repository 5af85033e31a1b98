"""Dimension maintenance and profiles over stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright import vocabulary as V
from casewright.functions import text as X


def repair_teams(df: DataFrame, names: Sequence[str], *, team: str = "team", name: str = "staff_name") -> DataFrame:
    """Broken team codes of the listed people become the hidden team."""
    broken = F.col(team).isin(V.BROKEN_TEAM_CODES) & F.col(name).isin(list(names))
    return df.withColumn(team, F.when(broken, F.lit(V.HIDDEN_TEAM)).otherwise(F.col(team)))


def rename_values(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """Bulk rename of a dimension value."""
    return df.withColumn(col, X.map_values(F.col(col), mapping))


def reapply_dimension(
    history: DataFrame, dim: DataFrame, *, key: str, columns: Sequence[str]
) -> DataFrame:
    """Current dimension values over the history; rows without a match keep theirs.

    A key that occurs twice in the dimension raises instead of doubling the history.
    """
    firsts = [F.first(c).alias(f"__{c}") for c in columns]
    unique = F.when(
        F.count("*") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.first(F.col(key).cast("string"))))
    ).otherwise(F.lit(True))
    side = dim.groupBy(key).agg(*firsts, unique.alias("__known"))
    joined = history.join(side, key, "left").filter(F.coalesce("__known", F.lit(True)))
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)))
    return joined.select(*history.columns)


def profile(tables: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows and newest timestamp of each named result."""
    parts = []
    for name, (df, stamp) in tables.items():
        newest = F.max(F.col(stamp).cast("timestamp_ntz")) if stamp else F.lit(None).cast("timestamp_ntz")
        parts.append(df.agg(F.count("*").alias("n"), newest.alias("newest")).select(
            F.lit(name).alias("name"), "n", "newest"
        ))
    return reduce(DataFrame.unionByName, parts)
