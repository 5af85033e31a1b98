"""Technician efficiency: task totals against work hours, per day and over 31 periods."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import vocabulary as V
from casewright.functions import text as X
from casewright.functions.calendar import BusinessCalendar, efficiency_period_list
from casewright.operators.joins import anti_null_safe, in_periods, lateral_first
from casewright.operators.pick import latest_per_key
from casewright.operators.tasks import explode_windows
from casewright.sources.tables import between_days
from casewright.sources.working import working_table

TASK_KEY = ["case_id", "task", "case_product_id"]
REJECT_KEY = ["case_number", "complete_date", "task", "completed_by"]


def _hours() -> Column:
    return F.coalesce(F.col("duration").try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))


def task_events(history: DataFrame, start: date, end: date) -> DataFrame:
    """History rows from ``start`` to ``end``, both included."""
    return history.filter(between_days(F.col("complete_date"), start, end))


def with_duration(
    history: DataFrame, plan: DataFrame, order: Sequence[Column], columns: Sequence[str] = ("duration",)
) -> DataFrame:
    """Planned duration of each history row, at most one per row.

    Only the plans of these rows' tasks are ranked.
    """
    wanted = plan.join(history.select(*TASK_KEY), TASK_KEY, "left_semi")
    return lateral_first(history, wanted, TASK_KEY, order, columns)


def plan_sums(plan: DataFrame) -> DataFrame:
    """All planned durations of a key as one row: their number and their sum.

    Joining this gives the totals of the fan-out join without producing its pairs.
    """
    return plan.groupBy(*TASK_KEY).agg(
        F.count("*").alias("copies"), F.sum(_hours()).alias("duration")
    )


def accepted_tasks(rows: DataFrame) -> DataFrame:
    """Rows that share no key with a rejected row; null keys match too."""
    flagged = rows.withColumn("is_rejected", X.yes_no_flag(F.col("rejected")))
    return anti_null_safe(flagged, flagged.filter("is_rejected = 1"), REJECT_KEY)


def employee_totals(rows: DataFrame, by: Sequence[str] = (), *, drop_rejected: bool = False) -> DataFrame:
    """Distinct cases, tasks and summed hours per employee; rows without employee dropped.

    An id that is no number is an employee of its own: ``employee_id`` is null then and ``employee_text`` the text.
    With ``drop_rejected`` every row that shares its key with a rejected row is left out (J09). The
    rows are reduced per key and then per case before the final grouping: the rejected test needs no
    self-join, the distinct count no second copy, and an employee with a large share of the tasks
    arrives already summed.
    """
    keys = [k for k in REJECT_KEY if k != "completed_by"] if drop_rejected else ["case_number"]
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    number = X.id_number(F.col("completed_by"))
    employee = ["employee_id", "employee_text"]
    text = F.when(number.isNull(), F.trim(F.col("completed_by").cast("string")))
    per_key = (
        rows.filter(F.col("completed_by").isNotNull())
        .withColumns({"employee_id": number, "employee_text": text})
        .groupBy(*by, *employee, *keys)
        .agg(
            F.sum(F.when(F.col("case_number").isNotNull(), copies).otherwise(0)).alias("tasks"),
            F.sum(_hours()).alias("hours"),
            F.max(X.yes_no_flag(F.col("rejected"))).alias("rejected"),
        )
    )
    if drop_rejected:
        per_key = (
            per_key.filter("rejected = 0")
            .groupBy(*by, *employee, "case_number")
            .agg(F.sum("tasks").alias("tasks"), F.sum("hours").alias("hours"))
        )
    return per_key.groupBy(*by, *employee).agg(
        F.count("case_number").alias("cases_worked_on"),
        F.sum("tasks").alias("tasks_completed"),
        F.sum("hours").alias("tasks_duration_hours"),
    )


def stage1(history: DataFrame, plan: DataFrame, order: Sequence[Column], start: date, end: date) -> DataFrame:
    """Task totals per employee of a date range, rejected tasks out."""
    rows = with_duration(task_events(history, start, end), plan, order)
    return employee_totals(rows, drop_rejected=True)


def daily_tasks(history: DataFrame, plan: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Task totals per employee and day over the whole history."""
    rows = with_duration(history, plan, order).withColumn("date", F.to_date("complete_date"))
    return employee_totals(rows, ["date"], drop_rejected=True).drop("employee_text")


def tasks_of_days(history: DataFrame, plan: DataFrame, order: Sequence[Column], days: DataFrame) -> DataFrame:
    """Task totals per employee and ``date``, each date standing for the days that ``days`` (date, day) gives it."""
    rows = with_duration(history, plan, order).withColumn("day", F.to_date("complete_date"))
    return employee_totals(rows.join(days, "day"), ["date"], drop_rejected=True).drop("employee_text")


def with_employee(hours: DataFrame, employees: DataFrame) -> DataFrame:
    """Timesheet rows with their employee; unmatched names get id and plan 0."""
    side = employees.select(
        F.col("payroll_name").alias("name"), "payroll_name", "employee_id", "staff_name", "team", "training_plan"
    )
    return hours.join(side, "name", "left").na.fill(0, ["employee_id", "training_plan"])


def unmatched_names(hours: DataFrame, employees: DataFrame) -> DataFrame:
    """Timesheet names without an employee, with their number of days."""
    side = employees.select(F.col("payroll_name").alias("name"))
    return hours.join(side, "name", "left_anti").groupBy("name").agg(F.count("*").alias("days"))


def combine(hours: DataFrame, tasks: DataFrame) -> DataFrame:
    """Work hours and task totals of the same employee and day with the efficiency.

    Efficiency is task hours over work hours in percent, rounded half to even at two digits and 0
    without work hours. It is a decimal, so later sums do not depend on their order.
    """
    keys = [k for k in ("date", "employee_id") if k in tasks.columns]
    tasks = tasks.withColumn("employee_id", F.col("employee_id").cast("bigint"))
    hours = hours.withColumn("employee_id", F.col("employee_id").cast("bigint"))
    ten_thousandths = (F.col("tasks_duration_hours") * 10000).cast("double")
    cents = F.rint(F.try_divide(ten_thousandths, F.col("work_hours"))).cast("decimal(18,0)")
    return hours.join(tasks, keys, "inner").withColumn(
        "efficiency", F.coalesce(cents / 100, F.lit(0)).cast("decimal(18,2)")
    )


CENTS = "__cents"


def _cents(daily: DataFrame) -> DataFrame:
    """Efficiency in whole hundredths, null where it is zero: sums are exact and cheap."""
    cents = (F.col("efficiency") * 100).cast("bigint")
    return daily.withColumn(CENTS, F.nullif(cents, F.lit(0).cast("bigint")))


def _mean(cents: Column) -> Column:
    return F.sum(cents) / F.lit(100.0) / F.nullif(F.count(cents), F.lit(0).cast("bigint"))


FIRST_TEAM, LAST_PLAN = "__first_team", "__last_plan"


def latest_attributes() -> tuple[Column, Column]:
    """Aggregates that ``with_latest_attributes`` reads: first non-null team by date and id, plan on the group's last day."""
    first_team = F.min(F.when(F.col("team").isNotNull(), F.struct("date", "employee_id", "team")))
    return first_team.alias(FIRST_TEAM), F.max(F.struct("date", "training_plan")).alias(LAST_PLAN)


def with_latest_attributes(groups: DataFrame, newest: date | None = None) -> DataFrame:
    """Team, and the plan of those whose last day is the newest of all, else 0.

    The newest day comes from the groups, not from a second pass over the rows; without ``newest`` the groups are written
    once for that, a job that runs at once.
    """
    if newest is None:
        groups = working_table(groups, "latest-attributes")
    day = groups.agg(F.max(f"{LAST_PLAN}.date")).scalar() if newest is None else F.lit(newest)
    plan = F.when(F.col(f"{LAST_PLAN}.date") == day, F.col(f"{LAST_PLAN}.training_plan"))
    return groups.withColumns(
        {FIRST_TEAM: F.col(f"{FIRST_TEAM}.team"), LAST_PLAN: F.coalesce(plan, F.lit(0))}
    ).withColumnsRenamed({FIRST_TEAM: "team", LAST_PLAN: "training_plan"})


def efficiency_periods(
    daily: DataFrame, calendar: BusinessCalendar, *, as_of: date, newest: date | None = None
) -> DataFrame:
    """Mean non-zero efficiency per employee over the 31 periods, as a fraction.

    Everything is one aggregate with one shuffle: every period is a conditional mean.
    """
    means = [
        (_mean(F.when(F.col("date").between(F.lit(lo), F.lit(hi)), F.col(CENTS))) * 0.01).alias(name)
        for name, lo, hi in efficiency_period_list(as_of, calendar)
    ]
    return with_latest_attributes(_cents(daily).groupBy("staff_name").agg(*latest_attributes(), *means), newest)


def drop_empty_periods(matrix: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Without the periods no employee has data for.

    The one operator that looks at data to choose its columns: a single-row aggregate.
    """
    filled = matrix.agg(*[F.count(p).alias(p) for p in periods]).first()
    return matrix.drop(*[p for p in periods if not filled[p]])


def period_efficiency(daily: DataFrame, calendar: BusinessCalendar, *, as_of: date) -> DataFrame:
    """The same means in long form through a range join with the periods."""
    periods = efficiency_period_list(as_of, calendar)
    rows = in_periods(_cents(daily.filter("efficiency <> 0")), "date", periods)
    return rows.groupBy("staff_name", "period").agg(
        F.count("*").alias("days"), _mean(F.col(CENTS)).alias("efficiency")
    )


def render_sentinel(matrix: DataFrame, cols: Sequence[str], sentinel: str = "x") -> DataFrame:
    """Display form of the matrix: two digits, a sentinel where there is no data."""
    for name in cols:
        shown = F.coalesce(X.half_even(F.col(name), 2).cast("string"), F.lit(sentinel))
        matrix = matrix.withColumn(name, shown)
    return matrix


def restore_sentinel(display: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numbers back from the display form, null for the sentinel."""
    for name in cols:
        display = display.withColumn(name, F.col(name).try_cast("double"))
    return display


def midday_snapshot(
    history: DataFrame,
    plan: DataFrame,
    employees: DataFrame,
    order: Sequence[Column],
    *,
    as_of: date,
    days: int = 8,
    windows: Sequence[tuple[str, int, int]] = V.SNAPSHOT_WINDOWS,
    fan_out: bool = False,
    only: DataFrame | None = None,
) -> DataFrame:
    """Cases, tasks and hours per employee, day and window, both ends inclusive.

    All days and windows at once, or ``only`` the days of a one-column frame (T03): rows of other days go before anything
    is joined or summed. History rows need a known employee and a planned task; one duration per row unless ``fan_out``.
    """
    first = as_of - timedelta(days=days)
    rows = history.filter(
        between_days(F.col("complete_date"), first, as_of)
        & (X.yes_no_flag(F.col("rejected")) == 0)
    )
    if only is not None:
        wanted = only.select(F.col(only.columns[0]).alias("__wanted"))
        rows = rows.join(wanted, F.to_date("complete_date") == F.col("__wanted"), "left_semi")
    plan = plan.join(rows.select(*TASK_KEY), TASK_KEY, "left_semi")
    if fan_out:
        planned = plan_sums(plan)
    else:
        planned = latest_per_key(plan, TASK_KEY, order).select(*TASK_KEY, "duration")
    rows = rows.join(planned, TASK_KEY, "inner").withColumn("data_date", F.to_date("complete_date"))
    rows = explode_windows(rows, "complete_date", windows, closed=True)
    totals = employee_totals(rows, ["data_date", "window"]).drop("employee_text")
    named = totals.join(
        employees.select(F.col("employee_id").cast("bigint").alias("employee_id"), "staff_name", "team"),
        "employee_id",
        "inner",
    )
    return (
        named.withColumn("team", F.coalesce("team", F.lit("Unknown")))
        .filter(F.col("team") != V.HIDDEN_TEAM)
        .select(
            "data_date",
            "window",
            "team",
            F.col("staff_name").alias("name"),
            "cases_worked_on",
            "tasks_completed",
            "tasks_duration_hours",
        )
    )


def missing_days(stored: DataFrame, col: str, *, as_of: date, days: int = 7) -> DataFrame:
    """Which of the last days before ``as_of`` have no row."""
    first = as_of - timedelta(days=days)
    spine = stored.sparkSession.range(days).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias(col)
    )
    present = stored.filter(F.col(col).between(F.lit(first), F.lit(as_of))).select(col)
    return spine.exceptAll(present.distinct())


def backfill(snapshot: DataFrame, missing: DataFrame) -> DataFrame:
    """Snapshot rows of the missing days of a snapshot that exists; ``midday_snapshot`` computes them alone."""
    return snapshot.join(missing.withColumnRenamed(missing.columns[0], "data_date"), "data_date", "left_semi")
