"""Mirrored copies of source tables: upsert by natural key, child replacement, audit.

Surrogate ids are hashes of the natural key, so any executor computes the same id again after a
failure and a re-run changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.functions.calendar import wall_clock
from casewright.operators.pick import latest_per_key
from casewright.sources.stores import WriteReport

STAMP = "updated_at"


def surrogate(*natural: Column) -> Column:
    """Deterministic surrogate id of a natural key; null for a null key."""
    present = F.lit(True)
    for column in natural:
        present = present & column.isNotNull()
    return F.when(present, F.xxhash64(*natural))


# -- column cleaning -------------------------------------------------------------------------------


def true_by_default(col: Column) -> Column:
    return F.coalesce(col.cast("boolean"), F.lit(True))


def short_state(col: Column) -> Column:
    """State code when it has at most two characters, else null."""
    return F.when(X.non_blank(col) & (F.length(F.trim(col)) <= 2), col)


def set_flag(col: Column) -> Column:
    """True when the text is not blank."""
    return X.non_blank(col.cast("string"))


@dataclass(frozen=True)
class Target:
    """How one source table is mirrored.

    ``columns`` maps mirror columns to source expressions. ``lookups`` maps a mirror column to
    (source key expression, parent table, parent natural key column, parent id column); a key the
    parent lacks becomes null.
    """

    key: str
    source_key: Column
    id_column: str
    columns: Mapping[str, Column] = field(default_factory=dict)
    lookups: Mapping[str, tuple[Column, str, str, str]] = field(default_factory=dict)


def statuses_target() -> Target:
    return Target(
        "status_name", X.blank_to_null(F.col("status")), "status_id", {"is_active": F.lit(True)}
    )


def departments_target() -> Target:
    return Target(
        "department_name",
        F.col("department_name"),
        "department_id",
        {
            "department_code": F.col("department_id").cast("string"),
            "is_active": true_by_default(F.col("active")),
        },
    )


def employees_target() -> Target:
    return Target(
        "employee_code",
        F.col("employee_id").cast("string"),
        "employee_id",
        {
            "first_name": F.coalesce("first_name", F.lit("")),
            "last_name": F.coalesce("last_name", F.lit("")),
            "role": F.col("position"),
            "is_active": true_by_default(F.col("active")),
            "hire_date": F.col("hire_date"),
        },
        {"department_id": (F.col("department"), "departments", "department_name", "department_id")},
    )


def customers_target() -> Target:
    return Target(
        "customer_code",
        F.col("customer_id").cast("string"),
        "customer_id",
        {
            "practice_name": F.coalesce("practice_name", F.lit("")),
            "address_line1": F.col("address1"),
            "address_line2": F.col("address2"),
            "city": F.col("city"),
            "state": short_state(F.col("state")),
            "zip": F.col("zip_code"),
            "phone": F.col("office_phone"),
            "email": F.col("email"),
            "is_active": true_by_default(F.col("active")),
        },
    )


def cases_target() -> Target:
    """Due date comes from the due date; the invoice date has its own column."""
    return Target(
        "case_number",
        F.col("case_number").cast("string"),
        "case_id",
        {
            "is_remake": set_flag(F.col("remake")),
            "remake_reason": F.col("remake_reason"),
            "pan_number": F.col("pan_number"),
            "due_date": F.to_date("due_date"),
            "received_date": F.to_date("date_in"),
            "invoice_date": F.to_date("invoice_date"),
            "ship_date": F.to_date("ship_date"),
            "invoice_amount": F.col("total_charge"),
            "notes": F.col("work_order_notes"),
        },
        {
            "customer_id": (F.col("customer_id").cast("string"), "customers", "customer_code", "customer_id"),
            "status_id": (F.trim("status"), "statuses", "status_name", "status_id"),
        },
    )


def mapped_rows(
    source: DataFrame,
    target: Target,
    parents: Mapping[str, DataFrame],
    newest: Sequence[Column] | None = None,
) -> DataFrame:
    """Source rows in mirror form: cleaned columns and resolved foreign keys.

    Repeated keys resolve by ``newest``. Without it they must not differ: ``one_per_key`` collapses exact copies and
    refuses the rest.
    """
    keys = [expr.alias(f"__fk_{name}") for name, (expr, *_) in target.lookups.items()]
    order = list(newest or [])
    rows = source.select(
        target.source_key.alias(target.key),
        *[expr.alias(name) for name, expr in target.columns.items()],
        *keys,
        *[expr.alias(f"__order_{k}") for k, expr in enumerate(order)],
    ).filter(F.col(target.key).isNotNull())
    if order:
        ranked = [F.col(f"__order_{k}").desc_nulls_last() for k in range(len(order))]
        rows = latest_per_key(rows, [target.key], ranked).drop(*[f"__order_{k}" for k in range(len(order))])
    for name, (_, parent, natural, surrogate_col) in target.lookups.items():
        side = parents[parent].select(
            F.col(natural).alias(f"__natural_{name}"), F.col(surrogate_col).alias(name)
        )
        rows = rows.join(side, F.col(f"__fk_{name}") == F.col(f"__natural_{name}"), "left").drop(
            f"__fk_{name}", f"__natural_{name}"
        )
    return rows


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row per key, in one shuffle; rows of a key that differ raise."""
    values = [c for c in rows.columns if c != key]
    content = F.xxhash64(*values)
    checked = F.when(
        F.min(content) != F.max(content), F.raise_error(F.concat(F.lit("repeated key "), F.first(F.col(key).cast("string"))))
    ).otherwise(F.lit(True))
    one = rows.groupBy(key).agg(*[F.first(v).alias(v) for v in values], checked.alias("__one"))
    return one.filter("__one").drop("__one")


def with_ids(rows: DataFrame, target: Target) -> DataFrame:
    """Mirror rows with their surrogate id, one per natural key."""
    return one_per_key(rows, target.key).withColumn(target.id_column, surrogate(F.col(target.key)))


def upsert(
    current: DataFrame | None,
    rows: DataFrame,
    target: Target,
    *,
    now: datetime,
    delete_missing: bool = False,
) -> DataFrame:
    """Mirror after inserting new keys and updating changed ones.

    Unchanged rows keep their stamp, so running it twice gives the same table. Keys that left the
    source stay unless ``delete_missing``. A key that occurs twice with different content raises.
    """
    values = [*target.columns, *target.lookups]
    new = one_per_key(rows.select(target.key, *values), target.key).withColumn("__new", F.lit(True))
    stamp = wall_clock(now)
    out = [target.id_column, target.key, *values, STAMP]
    if current is None:
        return new.filter("__new").select(
            surrogate(F.col(target.key)).alias(target.id_column), target.key, *values, stamp.alias(STAMP)
        )
    old = current.select(
        F.col(target.key), *[F.col(c).alias(f"__old_{c}") for c in (target.id_column, *values, STAMP)]
    )
    joined = old.join(new, target.key, "full_outer")
    if delete_missing:
        joined = joined.filter(F.col("__new"))
    present = F.coalesce("__new", F.lit(False))
    changed = F.lit(False)
    for value in values:
        changed = changed | ~F.col(value).eqNullSafe(F.col(f"__old_{value}"))
    is_insert = F.col(f"__old_{target.id_column}").isNull()
    columns = [
        F.coalesce(F.col(f"__old_{target.id_column}"), surrogate(F.col(target.key))).alias(target.id_column),
        F.col(target.key),
        *[F.when(present, F.col(v)).otherwise(F.col(f"__old_{v}")).alias(v) for v in values],
        F.when(present & (is_insert | changed), stamp).otherwise(F.col(f"__old_{STAMP}")).alias(STAMP),
    ]
    return joined.select(*columns).select(*out)


def tagged_children(source: DataFrame, parents: DataFrame, *, parent_key: str, parent_id: str, carry: Sequence[str] = ()) -> DataFrame:
    """Children with their parent's id, and columns of the parent to ``carry``; the id of an orphan is null."""
    ids = parents.select(parent_key, parent_id, *carry)
    return source.join(ids, parent_key, "left").drop(parent_key)


@dataclass(frozen=True)
class ChildResult:
    """New child table and the source rows whose parent is unknown."""

    table: DataFrame
    orphans: DataFrame


def replace_children(
    current: DataFrame | None,
    source: DataFrame,
    parents: DataFrame,
    *,
    parent_key: str,
    parent_id: str,
) -> ChildResult:
    """All children of the touched parents replaced by the source rows.

    ``source`` carries the parents' natural key; children of unknown parents are orphans and do not
    enter the table.
    """
    ids = parents.select(parent_key, parent_id)
    columns = [parent_id, *[c for c in source.columns if c != parent_key]]
    resolved = source.join(ids, parent_key, "inner").select(*columns)
    orphans = source.join(ids, parent_key, "left_anti")
    if current is None:
        return ChildResult(resolved, orphans)
    kept = current.join(resolved.select(parent_id), parent_id, "left_anti").select(*columns)
    return ChildResult(kept.unionByName(resolved), orphans)


def task_children(tasks: DataFrame, cases: DataFrame) -> DataFrame:
    """Tasks by case number with 'Unknown' for a missing name."""
    return tasks.join(cases.select("case_id", "case_number"), "case_id", "inner").select(
        "case_number",
        F.coalesce(X.blank_to_null(F.col("task")), F.lit("Unknown")).alias("task_name"),
        F.col("complete_date").alias("completed_at"),
    )


def history_children(history: DataFrame, employees: DataFrame) -> DataFrame:
    """History by case number with the action and the resolved employee."""
    side = employees.select(
        F.col("employee_code").alias("completed_by"), F.col("employee_id")
    )
    action = F.when(X.yes_no_flag(F.col("rejected")) == 1, "Rejected").otherwise("Completed")
    return history.join(side, "completed_by", "left").select(
        "case_number",
        "employee_id",
        F.col("task").alias("task_name"),
        action.alias("action"),
        F.col("complete_date").alias("action_at"),
    )


LOG_SCHEMA = (
    "sync_type string, status string, attempted long, succeeded long, failed long,"
    " error string, started_at timestamp, completed_at timestamp"
)


class SyncRun:
    """One table's run: counts rows while they are written and appends a log row.

    A failure is logged and swallowed, so that the other tables of the run still land.
    """

    def __init__(self, spark: SparkSession, sync_type: str, log_path: str):
        self.spark = spark
        self.sync_type = sync_type
        self.log_path = log_path
        self.observed = Observation(f"sync {sync_type}")
        self.failed = 0
        #: Source rows that entered the table; observed while writing unless given.
        self.rows: int | None = None
        #: What the guarded write said; a refused write is no success.
        self.report: WriteReport | None = None
        self.error: str | None = None

    def counted(self, df: DataFrame) -> DataFrame:
        return df.observe(self.observed, F.count(F.lit(1)).alias("rows"))

    def __enter__(self) -> SyncRun:
        self.started = datetime.now()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self.error = str(error) if error else None
        refused = self.report is not None and not self.report.published
        if error or refused:
            rows = 0
        else:
            rows = self.observed.get.get("rows", 0) if self.rows is None else self.rows
        status = "failed" if error else "refused" if refused else "completed"
        if refused:
            self.error = self.report.warning
        row = (
            self.sync_type,
            status,
            rows + self.failed,
            rows,
            self.failed,
            self.error,
            self.started,
            datetime.now(),
        )
        self.spark.createDataFrame([row], LOG_SCHEMA).write.mode("append").parquet(self.log_path)
        return kind is None or issubclass(kind, Exception)
