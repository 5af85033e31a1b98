"""One row per key out of many.

All pickers are ``row_number() <= k`` filters. Spark then keeps at most k rows per key and input
partition before the shuffle (WindowGroupLimit), so a key that holds a large share of the rows does
not travel to one task. Orders must end in a unique tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright import vocabulary as V
from casewright.functions.text import priority_rank

_RN = "__rn"


def top_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First k rows per key; ``rank`` keeps the position as a column."""
    window = Window.partitionBy(*keys).orderBy(*order)
    picked = df.withColumn(_RN, F.row_number().over(window)).filter(F.col(_RN) <= k)
    return picked.withColumnRenamed(_RN, rank) if rank else picked.drop(_RN)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Top row per key, e.g. the latest completed task of each case."""
    return top_k_per_key(df, keys, order, 1)


def top1_by(
    df: DataFrame, keys: Sequence[str], metric: str, tie: Sequence[Column] = ()
) -> DataFrame:
    """Row with the largest metric per key."""
    return top_k_per_key(df, keys, [F.col(metric).desc_nulls_last(), *tie], 1)


def priority_pick(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "category",
    priority: Sequence[str] = V.CATEGORY_PRIORITY,
) -> DataFrame:
    """Best value per key by a priority list; equal ranks resolve to the larger text.

    Only the keys and the value survive, so the order is unique by construction.
    """
    rank = priority_rank(F.col(value), priority)
    return latest_per_key(
        df.select(*keys, value), keys, [rank.asc(), F.col(value).desc_nulls_last()]
    )


def case_number(number: str = "case_number", case_id: str = "case_id") -> Column:
    """The number of a case; one without a number stands alone, under a number that no other case has."""
    return F.coalesce(F.col(number), F.concat(F.lit("\0"), F.col(case_id).cast("string")))


def tagged_facts(case_tasks: DataFrame, case_products: DataFrame | None, tie: Sequence[str]) -> DataFrame:
    """Tasks and product lines as rows of one frame: (case_id, done, product_id), one of the last two null.

    ``done`` holds what orders tasks (the first of ``tie``, the case id, the rest) and then what is shown of them, so the
    largest one is the latest task; null dates come last, and a larger case id wins a tie.
    """
    order = [F.col(tie[0]), F.col("case_id"), *[F.col(c) for c in tie[1:]]]
    shown = [F.col("task"), F.col("complete_date").alias("scan"), F.col("department")]
    done = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *shown)
    tasks = case_tasks.select("case_id", done.alias("done"))
    if case_products is None:
        return tasks.withColumn("product_id", F.lit(None).cast("bigint"))
    kind = tasks.schema["done"].dataType
    lines = case_products.select("case_id", F.lit(None).cast(kind).alias("done"), F.col("product_id").cast("bigint").alias("product_id"))
    return tasks.withColumn("product_id", F.lit(None).cast("bigint")).unionByName(lines)


def with_category(facts: DataFrame, products: DataFrame) -> DataFrame:
    """Category of the rows with a product; rows without one keep their place in the shuffle.

    A null key would send all of them to one task, so they get a key of their own that the condition never lets match.
    """
    side = products.select(F.col("product_id").cast("bigint").alias("__product"), "category")
    spread = F.coalesce(F.col("product_id"), F.xxhash64("case_id"))
    return (
        facts.withColumn("__key", spread)
        .join(side, (F.col("__key") == F.col("__product")) & F.col("product_id").isNotNull(), "left")
        .drop("__key", "__product")
    )


def best_category(category: Column, priority: Sequence[str]) -> Column:
    """Aggregate: the best category by a priority list, equal ranks to the larger text; nulls do not count."""
    ranked = F.struct((-priority_rank(category, priority)).alias("rank"), category.alias("category"))
    return F.max(F.when(category.isNotNull(), ranked))["category"]


def of_cases(facts: DataFrame, wanted: DataFrame, key: str = "case_id") -> DataFrame:
    """Facts of the wanted cases only.

    A report looks at few of all cases, so this comes before any ranking or further join. A small
    set of cases is broadcast by its measured size; a large one is joined by shuffle.
    """
    return facts.join(wanted.select(key), key, "left_semi")


def product_categories(case_products: DataFrame, products: DataFrame) -> DataFrame:
    """Category of every product line: case_id, category."""
    return case_products.select("case_id", "product_id").join(
        products.select("product_id", "category"), "product_id", "inner"
    ).select("case_id", "category")
