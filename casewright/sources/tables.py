"""Table scans and lookup files."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOOKUP_SCHEMAS = {
    "employees": T.StructType(
        [
            T.StructField("employee_id", T.IntegerType()),
            T.StructField("staff_name", T.StringType()),
            T.StructField("payroll_name", T.StringType()),
            T.StructField("team", T.StringType()),
            T.StructField("training_plan", T.IntegerType()),
        ]
    ),
    "tech_constants": T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("noon", T.StringType()),
            T.StructField("pm3", T.StringType()),
            T.StructField("shift_type", T.StringType()),
            T.StructField("design_type", T.StringType()),
        ]
    ),
    "teams": T.StructType([T.StructField("team", T.StringType())]),
    "revenue_goals": T.StructType(
        [
            T.StructField("year", T.IntegerType()),
            T.StructField("month", T.IntegerType()),
            T.StructField("revenue_goal", T.DoubleType()),
        ]
    ),
    "holidays": T.StructType(
        [T.StructField("date", T.DateType()), T.StructField("name", T.StringType())]
    ),
}


def read_table(
    spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None
) -> DataFrame:
    """Scan one parquet table; a missing or broken table raises instead of giving no rows.

    A known schema saves the job that reads the file footers.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def small_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A few literal rows, handed over as Arrow: a local relation whose true size Spark knows."""
    return spark.createDataFrame(pa.table(columns))


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Scan several tables and register each as a temporary view."""
    tables = {name: read_table(spark, folder, name) for name in names}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    properties: Mapping[str, str],
) -> DataFrame:
    """Parallel scan of a source database table, split on a key or date column."""
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=dict(properties),
    )


def run_sql(spark: SparkSession, text: str, **binds) -> DataFrame:
    """SQL text with named parameters, bound and never pasted into the text."""
    return spark.sql(text, args=binds)


def between_days(col: Column, first: date, last: date) -> Column:
    """Rows from ``first`` to ``last`` inclusive; compares the raw column so that it is pushed down."""
    return (col >= F.lit(first).cast("timestamp_ntz")) & (
        col < F.lit(last + timedelta(days=1)).cast("timestamp_ntz")
    )


def between_offsets(
    col: Column, as_of: date, low: int, high: int, *, low_open: bool = False, high_open: bool = False
) -> Column:
    """Rolling day window around ``as_of`` on a date column; each bound inclusive or open."""
    first = F.lit(as_of + timedelta(days=low))
    last = F.lit(as_of + timedelta(days=high))
    return (col > first if low_open else col >= first) & (col < last if high_open else col <= last)


def recent(df: DataFrame, col: str, days: int, as_of: date) -> DataFrame:
    """Rows of the last ``days`` days, live ones only when the table is soft-deleted."""
    rows = df.filter(F.col(col) >= F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz"))
    return rows.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in df.columns else rows


# Headers of the lookup files that differ from the column names, letter case and signs aside.
LOOKUP_HEADERS = {"3pm": "pm3"}


def read_lookup(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """CSV lookup read by header name; every row is kept, a value of another type is null.

    Headers match without regard to letter case and signs ("Staff Name" is ``staff_name``). Whole numbers may be
    written with a fraction of zero. A missing column raises; of holidays, rows without a valid date are skipped.
    """
    plain = lambda name: re.sub("[^a-z0-9]", "", name.lower())
    rows = spark.read.csv(path, header=True, inferSchema=False)
    names = {plain(LOOKUP_HEADERS.get(plain(name), name)): name for name in rows.columns}
    missing = [f.name for f in LOOKUP_SCHEMAS[kind] if plain(f.name) not in names]
    if missing:
        raise ValueError(f"{path}: missing columns: {', '.join(missing)}")

    def value(field: T.StructField) -> Column:
        text = F.col(f"`{names[plain(field.name)]}`")
        if isinstance(field.dataType, T.IntegerType):
            number = F.trim(text).try_cast("double")
            return F.when(number == F.floor(number), number.try_cast("int"))
        return text if isinstance(field.dataType, T.StringType) else F.trim(text).try_cast(field.dataType)

    typed = rows.select(*(value(f).alias(f.name) for f in LOOKUP_SCHEMAS[kind]))
    return typed.filter("date IS NOT NULL") if kind == "holidays" else typed


def tech_targets(constants: DataFrame) -> DataFrame:
    """Expected noon and 3 pm counts per technician; 'NA' becomes null."""
    return constants.select(
        F.trim("name").alias("name"),
        F.col("noon").try_cast("int").alias("noon_target"),
        F.col("pm3").try_cast("int").alias("pm3_target"),
        "shift_type",
        "design_type",
    )
