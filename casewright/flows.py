"""Whole jobs: timesheet upload into the daily store, nightly mirror of the source tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from casewright.functions.calendar import BusinessCalendar
from casewright.operators import dimension as D
from casewright.operators import efficiency as E
from casewright.operators import mirror as M
from casewright.sources import stores as S
from casewright.sources.keyed import KeyedStore, bucket_of, month_of
from casewright.sources.tables import between_days
from casewright.sources.timesheets import read_timesheets
from casewright.sources.working import working_table


def upload_timesheets(
    spark: SparkSession,
    paths: str | list[str],
    history: DataFrame,
    plan: DataFrame,
    employees: DataFrame,
    *,
    plan_order: Sequence[Column],
    daily_path: str,
    periods_path: str,
    calendar: BusinessCalendar,
    as_of: date,
    now: datetime,
) -> S.WriteReport:
    """Timesheet files to daily efficiency to the period matrix.

    A file stands in the store under its start day, with the tasks of all its days. The days of the files
    replace those of the store; the matrix is then computed from the stored days and published as a new version.
    """
    sheets = read_timesheets(spark, paths)
    hours = sheets.drop("end_date")
    span = sheets.agg(F.min("date").alias("first"), F.max("end_date").alias("last")).first()
    if span.first is None:
        raise ValueError("the timesheets hold no rows")
    worked = history.filter(between_days(F.col("complete_date"), span.first, span.last))
    covered = F.explode(F.sequence("date", F.greatest("date", "end_date"))).alias("day")
    days = sheets.select("date", "end_date").distinct().select("date", covered).distinct()
    tasks = E.tasks_of_days(worked, plan, plan_order, days)
    day = E.combine(E.with_employee(hours, employees), tasks)
    S.upsert_by_partition(_as_stored(day), daily_path, sort=["employee_id"])
    return publish_periods(spark, daily_path, periods_path, calendar, as_of=as_of, now=now)


def import_history(
    exported: DataFrame,
    *,
    daily_path: str,
    periods_path: str,
    calendar: BusinessCalendar,
    as_of: date,
    now: datetime,
) -> S.WriteReport:
    """A spreadsheet export of earlier days into the daily store, then the period matrix anew.

    Rows without a valid date are left out; the days of the export replace those of the store.
    """
    rows = S.import_history(exported).filter("date IS NOT NULL")
    S.upsert_by_partition(rows, daily_path, sort=["employee_id"])
    return publish_periods(exported.sparkSession, daily_path, periods_path, calendar, as_of=as_of, now=now)


def rename_teams(
    spark: SparkSession,
    mapping: Mapping[str, str],
    *,
    daily_path: str,
    periods_path: str,
    calendar: BusinessCalendar,
    as_of: date,
    now: datetime,
) -> S.WriteReport:
    """Team names changed in the daily store, then the period matrix anew."""
    rewrite_changed_days(spark, daily_path, lambda rows: D.rename_values(rows, "team", mapping), ["team"])
    return publish_periods(spark, daily_path, periods_path, calendar, as_of=as_of, now=now)


def reapply_employees(
    spark: SparkSession,
    employees: DataFrame,
    *,
    daily_path: str,
    periods_path: str,
    calendar: BusinessCalendar,
    as_of: date,
    now: datetime,
    columns: Sequence[str] = ("staff_name", "team", "training_plan"),
) -> S.WriteReport:
    """Today's names, teams and plans over the daily store, then the period matrix anew."""
    side = employees.withColumn("employee_id", F.col("employee_id").cast("bigint"))

    def reapplied(rows: DataFrame) -> DataFrame:
        return D.reapply_dimension(rows, side, key="employee_id", columns=columns)

    rewrite_changed_days(spark, daily_path, reapplied, list(columns))
    return publish_periods(spark, daily_path, periods_path, calendar, as_of=as_of, now=now)


def rewrite_changed_days(
    spark: SparkSession, daily_path: str, change: Callable[[DataFrame], DataFrame], columns: Sequence[str]
) -> list[date]:
    """``change`` applied to the days of the daily store in which it alters a row; their files alone are replaced.

    ``columns`` are those that it may alter. The days are found from the keys and these columns, no others are read.
    """
    before = [F.col(c).alias(f"__old_{c}") for c in columns]
    slim = change(S.read_history(spark, daily_path).select("date", "employee_id", *columns, *before))
    differs = ~F.lit(True)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__old_{c}"))
    days = sorted(r.date for r in slim.filter(differs).select("date").distinct().collect())
    if days:
        rows = change(S.read_history(spark, daily_path).filter(F.col("date").isin(days)))
        # Read in full before its partitions are replaced.
        S.upsert_by_partition(working_table(rows, "changed-days"), daily_path, sort=["employee_id"])
    return days


def _as_stored(day: DataFrame) -> DataFrame:
    return day.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.DAILY_SCHEMA])


def publish_periods(
    spark: SparkSession,
    daily_path: str,
    periods_path: str,
    calendar: BusinessCalendar,
    *,
    as_of: date,
    now: datetime,
) -> S.WriteReport:
    """Period matrix of everything stored; the newest stored day comes from the partition names."""
    days = [n.split("=", 1)[1] for n in S.Folder(spark, daily_path).children() if n.startswith("date=")]
    newest = date.fromisoformat(max(days)) if days else None
    matrix = E.efficiency_periods(
        S.read_history(spark, daily_path), calendar, as_of=as_of, newest=newest
    )
    return S.guarded_write(matrix, periods_path, now=now)


# Parents before children: a table may look up only tables that come before it.
SYNC_ORDER = ["statuses", "departments", "employees", "customers", "cases"]
CHILDREN = ["case_tasks", "case_task_history"]
TARGETS: dict[str, Callable[[], M.Target]] = {
    "statuses": M.statuses_target,
    "departments": M.departments_target,
    "employees": M.employees_target,
    "customers": M.customers_target,
    "cases": M.cases_target,
}


def mirror_part(name: str) -> Column:
    """Partition of a mirrored row: cases by the month they came in, customers dealt out, short lists whole."""
    if name == "cases":
        return month_of(F.col("received_date"))
    return bucket_of(F.col("customer_code")) if name == "customers" else F.lit("all")


def mirror_store(spark: SparkSession, root: str, name: str) -> KeyedStore:
    """The store of one mirrored table; children are merged by their parent."""
    key = TARGETS[name]().key if name in TARGETS else "case_id"
    return KeyedStore(spark, f"{root.rstrip('/')}/{name}", key)


def sync_mirror(
    spark: SparkSession,
    sources: Mapping[str, Callable[[], DataFrame]],
    root: str,
    *,
    as_of: date,
    now: datetime,
    days: int = 180,
    newest: Mapping[str, Sequence[Column]] | None = None,
) -> dict[str, M.SyncRun]:
    """Upsert every mirrored table in dependency order, then replace the children.

    Each table is its own job and publishes its own version; only partitions with a changed row are written, so a night
    without changes writes none. A table that fails is logged; the others still land, and its last good version stays.
    """
    log = f"{root.rstrip('/')}/sync_log"
    first = as_of - timedelta(days=days)
    runs: dict[str, M.SyncRun] = {}

    def store(name: str) -> KeyedStore:
        return mirror_store(spark, root, name)

    def recent_cases() -> DataFrame:
        cases = sources["cases"]()
        cases = cases.filter(between_days(F.col("date_in"), first, as_of))
        return cases.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in cases.columns else cases

    for name in SYNC_ORDER:
        with M.SyncRun(spark, name, log) as run:
            runs[name] = run
            source = recent_cases() if name == "cases" else sources[name]()
            if name != "cases" and "deleted" in source.columns:
                source = source.filter(~F.coalesce("deleted", F.lit(False)))
            target = TARGETS[name]()
            parents = {table: store(table).read() for _, table, _, _ in target.lookups.values()}
            rows = M.with_ids(M.mapped_rows(source, target, parents, (newest or {}).get(name)), target)
            run.report = store(name).merge(run.counted(rows), mirror_part(name), now=now, stamp=M.STAMP, unique=True)

    for name in CHILDREN:
        with M.SyncRun(spark, name, log) as run:
            runs[name] = run
            cases = recent_cases().select("case_id", "case_number")
            if name == "case_tasks":
                children = M.task_children(sources[name](), cases)
            else:
                rows = sources[name]().drop("case_number").join(cases, "case_id", "inner")
                children = M.history_children(rows, store("employees").read())
            parents = store("cases").read().withColumn("__month", mirror_part("cases"))
            tagged = M.tagged_children(children, parents, parent_key="case_number", parent_id="case_id", carry=["__month"])
            seen = Observation()
            orphan = F.col("case_id").isNull()
            # Written once: rows and orphans are counted on the way, the merge reads what was written.
            tagged = working_table(tagged.observe(seen, F.count_if(orphan).alias("orphans"), F.count("*").alias("all")), "children")
            run.failed = seen.get["orphans"]
            run.rows = seen.get["all"] - run.failed
            known = tagged.filter(~orphan)
            run.report = store(name).merge(known, F.col("__month"), now=now, drop=["__month"], written=True)
    return runs
