"""History and snapshot stores on parquet.

Two layouts. Partitioned stores replace whole partitions in place, which makes a write idempotent.
Versioned stores write each version to its own folder and move a pointer, so readers of the old
version are never disturbed and a failed write leaves no trace.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions import text as X
from casewright.sources.files import Folder

log = logging.getLogger(__name__)

DAILY_SCHEMA = T.StructType(
    [
        T.StructField("employee_id", T.LongType()),
        T.StructField("payroll_name", T.StringType()),
        T.StructField("staff_name", T.StringType()),
        T.StructField("team", T.StringType()),
        T.StructField("training_plan", T.IntegerType()),
        T.StructField("work_hours", T.DoubleType()),
        T.StructField("cases_worked_on", T.LongType()),
        T.StructField("tasks_completed", T.LongType()),
        T.StructField("tasks_duration_hours", T.DecimalType(38, 4)),
        T.StructField("efficiency", T.DecimalType(18, 2)),
        T.StructField("date", T.DateType()),
    ]
)
DAILY_COLUMNS = [f.name for f in DAILY_SCHEMA]
POINTER = "_current"
#: In front of a name: written but not published, which readers ignore; and a mark beside the first version.
DRAFT, FIRST = "_draft_", "_first_"


def read_history(spark: SparkSession, path: str, schema: T.StructType = DAILY_SCHEMA) -> DataFrame:
    """A partitioned store; no rows when it does not exist yet, an error when it is broken."""
    if not Folder(spark, path).exists():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def upsert_by_partition(df: DataFrame, path: str, key: str = "date", sort: Sequence[str] = ()) -> None:
    """Replace the partitions of ``key`` that occur in ``df``, keep the others.

    Small days share a task; a day with very many rows is split by its measured size and written by many. The input is
    computed once. Repeating the call gives the same store.
    """
    (
        df.hint("rebalance", F.col(key))
        .sortWithinPartitions(F.col(key).desc(), *sort)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )


def drop_partitions_before(spark: SparkSession, path: str, key: str, first: date) -> list[str]:
    """Delete partitions older than ``first``; returns their names."""
    folder = Folder(spark, path)
    old = [
        name
        for name in folder.children()
        if name.startswith(f"{key}=") and name[len(key) + 1 :] < first.isoformat()
    ]
    for name in old:
        folder.delete(name)
    return old


def upsert_snapshot(
    df: DataFrame, path: str, *, as_of: date, key: str = "data_date", sort: Sequence[str] = (), keep_days: int = 7
) -> None:
    """Snapshot rows by data date, days older than ``keep_days`` before ``as_of`` dropped."""
    first = as_of - timedelta(days=keep_days)
    upsert_by_partition(df.filter(F.col(key) >= F.lit(first)), path, key, sort)
    drop_partitions_before(df.sparkSession, path, key, first)


@dataclass(frozen=True)
class WriteReport:
    published: bool
    version: str
    rows: int
    previous_rows: int
    warning: str | None = None


def _pointer(spark: SparkSession, path: str) -> tuple[str, int] | None:
    folder = Folder(spark, path)
    if not folder.exists(POINTER):
        # A version gets its name only when it is about to be published; a first run that died leaves another name, or
        # its version marked as the first one.
        published = [name for name in folder.children() if name.startswith("v_")]
        if published and not (len(published) == 1 and folder.exists(f"{FIRST}{published[0]}")):
            raise FileNotFoundError(f"{path} holds versions but no pointer to the published one")
        return None
    version, rows = folder.read_text(POINTER).split()
    return version, int(rows)


def current_version(spark: SparkSession, path: str) -> str | None:
    known = _pointer(spark, path)
    return f"{path.rstrip('/')}/{known[0]}" if known else None


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The published version of a versioned store."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no published version in {path}")
    return spark.read.parquet(version)


def guarded_write(
    df: DataFrame, path: str, *, now: datetime, keep: int = 7, loss_warning: float = 0.5
) -> WriteReport:
    """Write a new version, check it, publish it, prune old ones.

    The rows are counted in the written files, so a retried task counts once. An empty result never
    replaces a filled one; a loss of more than half of the rows is published with a warning. ``df``
    may read the current version, since that stays until it is pruned.
    """
    spark = df.sparkSession
    folder = Folder(spark, path)
    version = f"v_{now:%Y%m%d_%H%M%S_%f}"
    known = _pointer(spark, path)
    previous = known[1] if known else 0
    draft = f"{DRAFT}{version}"
    if known and known[0] == version:
        raise FileExistsError(f"{path} has published {version} already")
    try:
        # Drafts of runs that died, and a version of a first run that nothing points to.
        for name in folder.children():
            if name.startswith(DRAFT) or (not known and name.startswith("v_")):
                folder.delete(name)
        df.write.mode("errorifexists").parquet(f"{folder.path}/{draft}")
        rows = spark.read.schema(df.schema).parquet(f"{folder.path}/{draft}").count()
    except BaseException:
        folder.delete(draft)
        raise
    if rows == 0 and previous > 0:
        folder.delete(draft)
        log.error("%s: empty result not published over %d rows", path, previous)
        return WriteReport(False, version, 0, previous, "empty result refused")
    warning = None
    if previous and rows < previous * loss_warning:
        warning = f"{rows} rows replace {previous}"
        log.warning("%s: %s", path, warning)
    if not known:
        folder.write_text(f"{FIRST}{version}", "")
    folder.rename(draft, version)
    folder.write_text(POINTER, f"{version} {rows}")
    for name in folder.children():
        if name.startswith(FIRST):
            folder.delete(name)
    # The published version stays whatever its name; of the others the newest names do.
    others = [name for name in folder.children() if name.startswith("v_") and name != version]
    for name in others[: len(others) - (keep - 1)] if len(others) >= keep else []:
        folder.delete(name)
    return WriteReport(True, version, rows, previous, warning)


REQUIRED_HISTORY = ["date", "employee_id", "staff_name", "team", "efficiency"]


def import_history(df: DataFrame, required: Sequence[str] = REQUIRED_HISTORY) -> DataFrame:
    """History rows from a spreadsheet export: dates from text or day numbers, clean ids and texts."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = F.trim(F.col("date").cast("string"))
    serial = text.try_cast("double").try_cast("int")
    day = F.when(serial.isNotNull(), X.excel_serial_date(serial)).otherwise(
        F.substring(text, 1, 10).try_cast("date")
    )
    out = df.withColumn("date", day).withColumn("employee_id", X.id_number(F.col("employee_id")))
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    for name in texts:
        if name not in ("date", "employee_id"):
            value = F.trim(name)
            out = out.withColumn(
                name, F.when(value.isNull() | (F.lower(value) == "nan"), F.lit("")).otherwise(value)
            )
    # The columns and types of the daily store, so that the rows can enter it; what is not a number is missing.
    return out.select(
        *(
            (F.col(f.name).try_cast(f.dataType) if f.name in out.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in DAILY_SCHEMA
        )
    )
