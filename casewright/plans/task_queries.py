"""Queries over task logs, check-ins and efficiency."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators import efficiency as E
from casewright.operators import tasks as T
from casewright.operators.joins import anti_null_safe
from casewright.plans.lab_views import AS_OF, CALENDAR, EVENT_DAY, EVENT_NOW, Lab
from casewright.plans.registry import query
from casewright.sources.working import working_table
from casewright.streaming import scans

FIRST, LAST = date(2024, 1, 8), date(2024, 1, 14)
AUDIT_TIE = ("line", "part_id", "source_id")


def plan_order() -> list[Column]:
    """Of several planned durations the newest counts."""
    return [F.col("planned_at").desc(), F.col("plan_id").desc()]


def checkin_rows(lab: Lab) -> DataFrame:
    return T.checkins(
        lab.audit_trail(), lab.cases(), lab.case_products(), lab.products(), as_of=AS_OF, tie=AUDIT_TIE
    )


def daily(lab: Lab) -> DataFrame:
    tasks = E.daily_tasks(lab.task_history(), lab.planned_tasks(), plan_order())
    return E.combine(E.with_employee(lab.timesheets(), lab.employees()), tasks)


@query
def airway_task_counts(lab: Lab) -> DataFrame:
    return T.task_counts(lab.task_history(), as_of=EVENT_DAY)


@query
def airway_task_leaders(lab: Lab) -> DataFrame:
    counts = T.task_counts(lab.task_history(), as_of=EVENT_DAY)
    return T.task_leaders(counts, lab.employees(), as_of=EVENT_DAY)


@query
def design_windows(lab: Lab) -> DataFrame:
    return T.design_windows(lab.task_history(), lab.employees(), as_of=EVENT_DAY)


@query
def checkin_windows(lab: Lab) -> DataFrame:
    return T.checkin_windows(checkin_rows(lab), as_of=AS_OF)


@query
def category_trends(lab: Lab) -> DataFrame:
    return T.category_trends(checkin_rows(lab), as_of=AS_OF)


@query
def cases_by_operator(lab: Lab) -> DataFrame:
    return T.cases_by_operator(
        lab.audit_trail(), lab.numbered_cases(), lab.case_products(), lab.products(), as_of=AS_OF
    )


@query
def stage1_tasks(lab: Lab) -> DataFrame:
    kiosk = F.when(F.col("event_id") % 31 == 0, "kiosk").when(F.col("event_id") % 31 == 1, F.lit(" web ")).otherwise(F.col("completed_by"))
    history = lab.task_history().withColumn("completed_by", kiosk)
    return E.stage1(history, lab.planned_tasks(), plan_order(), FIRST, LAST)


@query
def task_durations(lab: Lab) -> DataFrame:
    rows = E.task_events(lab.task_history(), FIRST, LAST)
    return E.with_duration(rows, lab.planned_tasks(), plan_order()).select(
        "event_id", "case_id", "task", "case_product_id", "duration"
    )


@query
def untouched_tasks(lab: Lab) -> DataFrame:
    """Tasks of employee and case pairs without any rejected task; cases on hold count as unknown."""
    case = F.when(F.col("case_id") % 9 != 0, F.col("case_id"))
    rows = lab.task_history().select(
        "event_id", case.alias("case_id"), "completed_by", F.to_date("complete_date").alias("day"), "rejected"
    )
    bad = rows.filter(F.col("rejected") == "Yes")
    return anti_null_safe(rows, bad, ["case_id", "completed_by", "day"]).drop("rejected")


@query
def midday_snapshot(lab: Lab) -> DataFrame:
    return E.midday_snapshot(
        lab.task_history(), lab.planned_tasks(), lab.employees(), plan_order(), as_of=EVENT_DAY
    )


@query
def midday_snapshot_fan_out(lab: Lab) -> DataFrame:
    return E.midday_snapshot(
        lab.task_history(),
        lab.planned_tasks(),
        lab.employees(),
        plan_order(),
        as_of=EVENT_DAY,
        fan_out=True,
    )


@query
def daily_efficiency(lab: Lab) -> DataFrame:
    return daily(lab).select(
        "date",
        "employee_id",
        "staff_name",
        "team",
        "training_plan",
        "work_hours",
        "cases_worked_on",
        "tasks_completed",
        "tasks_duration_hours",
        "efficiency",
    )


@query
def efficiency_periods(lab: Lab) -> DataFrame:
    return E.efficiency_periods(daily(lab), CALENDAR, as_of=EVENT_DAY)


@query
def period_efficiency(lab: Lab) -> DataFrame:
    return E.period_efficiency(daily(lab), CALENDAR, as_of=EVENT_DAY)


@query
def missing_days(lab: Lab) -> DataFrame:
    stored = lab.cases().filter("status = 'Cancelled'").select(F.to_date("date_in").alias("day"))
    return E.missing_days(stored, "day", as_of=AS_OF, days=60)


@query
def missing_snapshots(lab: Lab) -> DataFrame:
    """Snapshot rows of the days a store lacks; the store here holds every second day."""
    stored = lab.task_history().select(F.to_date("complete_date").alias("day")).filter(
        F.dayofmonth("day") % 2 == 0
    )
    missing = working_table(E.missing_days(stored, "day", as_of=EVENT_DAY), "missing-days")
    return E.midday_snapshot(
        lab.task_history(), lab.planned_tasks(), lab.employees(), plan_order(), as_of=EVENT_DAY, only=missing
    )


@query
def scan_alarms(lab: Lab) -> DataFrame:
    return scans.stale_cases(lab.task_history(), EVENT_NOW, hours=4)


@query
def hourly_tasks(lab: Lab) -> DataFrame:
    return scans.hourly_counts(lab.task_history())
