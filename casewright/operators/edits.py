"""Edit events folded into state, duplicates merged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.sources.tables import small_table


def fold_duplicates(
    df: DataFrame,
    key: str,
    *,
    texts: Sequence[str] = (),
    flags: Sequence[str] = (),
    stamp: str | None = None,
) -> DataFrame:
    """One row per key: longest text per column, flag set if ever set, newest stamp.

    Blank keys are dropped; equally long texts resolve to the larger one.
    """
    measures: list[Column] = []
    for name in texts:
        text = F.coalesce(F.col(name), F.lit(""))
        measures.append(F.max(F.struct(F.length(text).alias("size"), text.alias("text")))["text"].alias(name))
    for name in flags:
        measures.append(F.max(F.coalesce(F.col(name), F.lit(False))).alias(name))
    if stamp:
        measures.append(F.max(stamp).alias(stamp))
    rows = df.withColumn(key, F.trim(F.col(key).cast("string"))).filter(X.non_blank(F.col(key)))
    return rows.groupBy(key).agg(*measures)


def latest_edits(
    edits: DataFrame, key: str, columns: Sequence[str], stamp: str, tie: str
) -> DataFrame:
    """Newest non-null value of every column per key, with the newest stamp.

    ``max_by`` aggregates partially, so a key with very many edits is reduced before the shuffle.
    """
    order = F.struct(F.col(stamp), F.col(tie))
    folded = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns
    ]
    keyed = edits.withColumn(key, F.trim(F.col(key).cast("string"))).filter(X.non_blank(F.col(key)))
    return keyed.groupBy(key).agg(*folded, F.max(stamp).alias(stamp))


def apply_edits(
    state: DataFrame,
    edits: DataFrame,
    *,
    key: str,
    defaults: Mapping[str, object],
    stamp: str = "last_updated",
    tie: str = "edit_id",
) -> DataFrame:
    """State with a batch of partial edits applied.

    A null field leaves the old value alone, an explicit empty value clears it, a new key starts
    from the defaults. Touched rows carry the newest edit time.
    """
    batch = latest_edits(edits, key, list(defaults), stamp, tie)
    new = batch.select(key, *[F.col(c).alias(f"__{c}") for c in (*defaults, stamp)])
    joined = state.join(new, key, "full_outer")
    merged = [
        F.coalesce(F.col(f"__{c}"), F.col(c), F.lit(default)).alias(c)
        for c, default in defaults.items()
    ]
    return joined.select(key, *merged, F.coalesce(F.col(f"__{stamp}"), F.col(stamp)).alias(stamp))


def recipients(df: DataFrame, departments: Sequence[str], default: Sequence[str] = ()) -> DataFrame:
    """Recipient lists per department from JSON texts; every known department appears."""
    known = small_table(df.sparkSession, department=list(departments))
    parsed = df.select("department", X.json_text_list(F.col("emails")).alias("emails"))
    fallback = F.array(*[F.lit(v) for v in default]).cast("array<string>")
    return known.join(parsed, "department", "left").withColumn("emails", F.coalesce("emails", fallback))
