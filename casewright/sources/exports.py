"""Exports of reports and lists."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright import vocabulary as V
from casewright.functions import text as X


def export_cases(df: DataFrame, *, as_of: date) -> DataFrame:
    """Display form of the case list: M/D/YYYY dates, short scan times, Yes/No."""
    blank = F.lit("")
    return df.select(
        F.coalesce("case_number", blank).alias("Case #"),
        F.coalesce("pan_number", blank).alias("Pan #"),
        F.coalesce(F.date_format("ship_date", "M/d/yyyy"), blank).alias("Ship Date"),
        F.coalesce("category", blank).alias("Category"),
        F.coalesce("last_task", blank).alias("Last Task"),
        F.coalesce("location", blank).alias("Last Location"),
        X.scan_label(F.col("last_scan"), F.lit(as_of)).alias("Last Scan Time"),
        F.when(F.coalesce("local_delivery", F.lit(False)), "Yes").otherwise("No").alias("Local Delivery"),
    )


def labelled(df: DataFrame, columns: Sequence[str], labels: Mapping[str, str]) -> DataFrame:
    """Chosen columns as texts under display labels, nulls blank."""
    return df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(labels.get(c, c)) for c in columns]
    )


def export_customers(book: DataFrame) -> DataFrame:
    columns = [c for c in V.CUSTOMER_LABELS if c in book.columns]
    return labelled(book, columns, V.CUSTOMER_LABELS)


def export_periods(matrix: DataFrame) -> DataFrame:
    """The period matrix as it is published, every column a text under its own name, nulls blank."""
    return labelled(matrix, matrix.columns, {})


HOLD_COLUMNS = [
    "case_number",
    "pan_number",
    "doctor_name",
    "practice_name",
    "patient_name",
    "create_date",
    "ship_date",
    "hold_date",
    "hold_status",
    "hold_reason",
    "follow_up_type",
    "follow_up_date",
]


def export_holds(holds: DataFrame) -> DataFrame:
    return labelled(holds, HOLD_COLUMNS, {})


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with a header in every part file; parts are written in parallel."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, emptyValue="")


def write_report(report: DataFrame, path: str, key: str = "section") -> None:
    """One folder per section."""
    report.write.mode("overwrite").partitionBy(key).csv(path, header=True, quoteAll=True)


def _json_fragment(value: Column) -> Column:
    """JSON text of one value, a blank text for null."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    inner = F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    return F.when(value.isNull(), F.lit('""')).otherwise(inner)


def to_records(df: DataFrame) -> DataFrame:
    """JSON record per row: nulls become blank texts, dates and times plain texts."""
    parts: list[Column] = []
    for f in df.schema:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            value = value.cast("string")
        parts.append(F.concat(F.lit(json.dumps(f.name) + ":"), _json_fragment(value)))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("record"))


def write_records(df: DataFrame, path: str) -> None:
    to_records(df).write.mode("overwrite").text(path)
