"""Join shapes beyond a plain equi-join.

No side is force-broadcast: Spark broadcasts a side whose measured size is under its threshold and
shuffles otherwise, and adaptive execution splits skewed partitions. Sides are reduced to unique
keys before they are joined, so no join here multiplies a hot key by itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.pick import latest_per_key


def lookup(df: DataFrame, dim: DataFrame, on: str, dim_key: str, columns: dict[str, str]) -> DataFrame:
    """Left join to a dimension: its ``columns`` (source name -> new name) are added."""
    key = "__key"
    side = dim.select(
        F.col(dim_key).alias(key), *[F.col(old).alias(new) for old, new in columns.items()]
    )
    return df.join(side, F.col(on) == F.col(key), "left").drop(key)


def anti_null_safe(df: DataFrame, bad: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a partner in ``bad``; null keys match null keys."""
    right = bad.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(right, same, "left_anti")


def semi_either(df: DataFrame, first: str, second: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose first or second column is among the ids.

    Both ends of a row, tagged, meet the ids in one semi-join, so the ids are computed once. Equal rows have equal ends:
    as many of them stay as there were, whichever end was met. Columns must be of types that can be grouped by.
    """
    ends = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("id")) for k, c in enumerate((first, second))])
    tagged = df.select("*", F.explode(F.filter(ends, lambda e: e["id"].isNotNull())).alias("__end"))
    side = ids.select(F.col(id_col).alias("__id")).distinct()
    met = tagged.join(side, F.col("__end.id") == F.col("__id"), "left_semi")
    times = F.greatest(*[F.count_if(F.col("__end.k") == k) for k in (0, 1)]).cast("int")
    counted = met.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(times.alias("__times"))
    return counted.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array_repeat(F.lit(0), F.col("__times")))).drop("col")


def lateral_first(
    df: DataFrame, other: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """One matching row of ``other`` per row, nulls when there is none.

    ``other`` is reduced to one row per key first, so repeated keys cannot fan out.
    """
    first = latest_per_key(other, keys, order).select(*keys, *columns)
    return df.join(first, list(keys), "left")


def attach_counts(df: DataFrame, facts: DataFrame, key: str, name: str) -> DataFrame:
    """Number of fact rows per key as a column, 0 when there are none."""
    counts = facts.groupBy(key).agg(F.count("*").alias(name))
    return df.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def day_spine(df: DataFrame, keys: Sequence[str], days: Sequence[date], name: str) -> DataFrame:
    """Every distinct key combined with every listed day (J20); an explode, not a cross join."""
    spine = F.explode(F.array(*[F.lit(d) for d in days])).alias(name)
    return df.select(*keys).distinct().select(*keys, spine)


def densify(
    spine: DataFrame, facts: DataFrame, keys: Sequence[str], fill: dict[str, object]
) -> DataFrame:
    """Left join facts to a spine; listed measures get a default where there is no fact."""
    joined = spine.join(facts, list(keys), "left")
    for name, value in fill.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return joined


def in_periods(df: DataFrame, day: str, periods: Sequence[tuple[str, date, date]]) -> DataFrame:
    """Range join of rows with named date periods: one row per period that holds the day.

    The periods are a short literal list, so the join is an array filter and an explode.
    """
    table = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            for name, lo, hi in periods
        ]
    )
    first = min(lo for _, lo, _ in periods)
    last = max(hi for _, _, hi in periods)
    hits = F.filter(table, lambda p: F.col(day).between(p["lo"], p["hi"]))
    return (
        df.filter(F.col(day).between(F.lit(first), F.lit(last)))
        .withColumn("__hit", F.explode(hits))
        .withColumn("period", F.col("__hit.name"))
        .drop("__hit")
    )


def linked_pairs(links: DataFrame, cases: DataFrame, note_pattern: str, main: Column, columns: Sequence[str]) -> DataFrame:
    """Case pairs of the matching links, the cases' ``columns`` prefixed ``main_`` and ``og_``.

    Each link is two tagged ends, so the cases are read and joined once for both; ``main`` is a condition on the case at
    the main end. The ends meet again in one aggregate by pair; a link that occurs twice gives its pair twice.
    """
    sides = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("id")) for k, c in enumerate(("case_id", "link_case_id"))])
    ends = links.filter(F.col("notes").like(note_pattern)).select(
        F.col("case_id").alias("main_case_id"), F.col("link_case_id").alias("og_case_id"), F.explode(sides).alias("__end")
    )
    side = cases.select(F.col("case_id").alias("__id"), main.alias("__main"), F.struct(*columns).alias("__row"))
    is_main = F.col("__end.k") == 0
    met = ends.join(side, F.col("__end.id") == F.col("__id"), "inner").filter(F.col("__main") | ~is_main)
    pairs = met.groupBy("main_case_id", "og_case_id").agg(
        F.max(F.when(is_main, F.col("__row"))).alias("__m"),
        F.max(F.when(~is_main, F.col("__row"))).alias("__o"),
        F.count_if(is_main).cast("int").alias("__times"),
    )
    both = pairs.filter(F.col("__m").isNotNull() & F.col("__o").isNotNull())
    return both.select(
        "main_case_id",
        "og_case_id",
        *[F.col(f"__{side}.{c}").alias(f"{name}_{c}") for side, name in (("m", "main"), ("o", "og")) for c in columns],
        F.explode(F.array_repeat(F.lit(0), F.col("__times"))),
    ).drop("col")
