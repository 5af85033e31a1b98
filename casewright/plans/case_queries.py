"""Queries over open cases, workload and sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright import vocabulary as V
from casewright.functions import text as X
from casewright.operators import cases as C
from casewright.operators import customers as B
from casewright.operators import sales as S
from casewright.operators import workload as W
from casewright.operators.customers import filter_options
from casewright.plans.lab_views import AS_OF, CALENDAR, NOW, Lab
from casewright.plans.registry import query

# The report window is wider than the default six days so that small data fills it.
DAYS = 45
WINDOW = W.window_days(AS_OF, CALENDAR, DAYS)


def open_cases(lab: Lab) -> DataFrame:
    return C.open_case_list(
        lab.numbered_cases(),
        lab.case_tasks(),
        lab.locations(),
        lab.case_products(),
        lab.products(),
        as_of=AS_OF,
    )


def flagged_cases(lab: Lab, or_earlier: bool = False) -> DataFrame:
    return C.add_flags(open_cases(lab), AS_OF, CALENDAR, or_earlier=or_earlier)


def status_counts(lab: Lab) -> DataFrame:
    return W.workload_status(lab.cases(), CALENDAR, as_of=AS_OF, days=DAYS)


def detail(lab: Lab) -> DataFrame:
    return W.workload_detail(
        lab.numbered_cases(),
        lab.case_products(),
        lab.products(),
        lab.locations(),
        CALENDAR,
        as_of=AS_OF,
        days=DAYS,
    )


@query
def open_case_list(lab: Lab) -> DataFrame:
    return open_cases(lab)


@query
def open_case_list_by_dept(lab: Lab) -> DataFrame:
    return C.open_case_list_by_department(lab.numbered_cases(), lab.case_tasks(), lab.locations())


@query
def case_flags(lab: Lab) -> DataFrame:
    return flagged_cases(lab).select(
        "case_number", "pan_number", "ship_date", "is_rush", "leaves_today", "is_overdue"
    )


@query
def filter_cases(lab: Lab) -> DataFrame:
    found = C.filter_cases(flagged_cases(lab), flag="rush", search=" r1 ")
    return found.select("case_number", "pan_number", "ship_date", "category", "location")


@query
def case_badges(lab: Lab) -> DataFrame:
    return C.case_badges(
        flagged_cases(lab),
        {
            "all_cases": {},
            "rush": {"flag": "rush"},
            "overdue": {"flag": "overdue"},
            "nowhere": {"location": V.NO_LOCATION},
            "metal": {"category": "Metal"},
            "on_july_4": {"ship_day": "7/4"},
            "pattern": {"search": "^1.*7$", "regex": True},
        },
    )


@query
def case_filter_options(lab: Lab) -> DataFrame:
    rows = open_cases(lab).withColumn("ship_day", X.slash_day(F.col("ship_date")))
    return filter_options(rows, ["location", "category", "ship_day"])


def airway_rows(lab: Lab) -> DataFrame:
    stages = [stage for stages in V.STAGE_GROUPS.values() for stage in stages]
    return C.airway_workflow(
        lab.numbered_cases(),
        lab.case_tasks(),
        lab.locations(),
        lab.customers(),
        CALENDAR,
        stages=stages,
    )


@query
def airway_workflow(lab: Lab) -> DataFrame:
    return C.filter_airway(airway_rows(lab), ship_date="not a date")


@query
def airway_workflow_by_location(lab: Lab) -> DataFrame:
    return C.filter_airway(airway_rows(lab), location=next(iter(V.STAGE_GROUPS.values()))[0])


@query
def airway_workflow_by_day(lab: Lab) -> DataFrame:
    return C.filter_airway(airway_rows(lab), ship_date="1998-06-15")


@query
def location_summary(lab: Lab) -> DataFrame:
    return C.location_summary(open_cases(lab))


@query
def stage_summary(lab: Lab) -> DataFrame:
    rows = C.with_location(lab.cases(), lab.locations())
    rows = C.filter_airway(rows.withColumn("ship_date", F.to_date("ship_date")))
    return C.stage_summary(rows)


@query
def local_delivery(lab: Lab) -> DataFrame:
    rows = C.local_delivery(open_cases(lab))
    return rows.select(
        "case_number", "ship_date", (F.col("ship_date") == F.lit(AS_OF)).alias("ships_today")
    )


@query
def overdue_no_scan(lab: Lab) -> DataFrame:
    rows = C.overdue_no_scan(flagged_cases(lab, or_earlier=True), NOW)
    return rows.select("case_number", "ship_date", "location", "last_scan")


@query
def submitted_cases(lab: Lab) -> DataFrame:
    rows = C.submitted_cases(lab.cases(), lab.locations(), CALENDAR)
    return B.numbered(rows, [F.col("ship_date"), F.col("case_number")])


@query
def hold_list(lab: Lab) -> DataFrame:
    rows = C.hold_list(lab.cases(), lab.customers(), CALENDAR, as_of=AS_OF)
    typed = F.when(F.col("follow_up_type").isNull(), 1).otherwise(0)
    order = [F.col("type_rank"), F.col("follow_up_date").asc_nulls_last(), F.col("case_number")]
    return B.numbered(rows.withColumn("type_rank", typed), order)


@query
def hold_status_counts(lab: Lab) -> DataFrame:
    held = lab.cases().filter(F.col("status") == "On Hold")
    picked = C.filter_in(held, "hold_status", V.HOLD_STATUSES)
    return C.counts_by(picked, "hold_status")


@query
def workload_status(lab: Lab) -> DataFrame:
    return status_counts(lab)


@query
def workload_pivot(lab: Lab) -> DataFrame:
    return W.workload_pivot(detail(lab))


@query
def uncategorised_cases(lab: Lab) -> DataFrame:
    rows = W.without_products(lab.cases(), lab.case_products(), lab.products())
    return rows.select("case_number", "status", F.to_date("ship_date").alias("ship_date"))


@query
def workload_chart(lab: Lab) -> DataFrame:
    return W.workload_chart(status_counts(lab))


@query
def workload_pace(lab: Lab) -> DataFrame:
    return W.workload_pace(status_counts(lab))


@query
def category_pace(lab: Lab) -> DataFrame:
    return W.category_pace(W.workload_pivot(detail(lab)), WINDOW)


@query
def workload_matrix(lab: Lab) -> DataFrame:
    rows = W.business_window(detail(lab), "ship_date", WINDOW)
    return W.workload_matrix(W.workload_pivot(rows), WINDOW)


@query
def pivot_margins(lab: Lab) -> DataFrame:
    return W.pivot_margins(W.business_window(detail(lab), "ship_date", WINDOW), WINDOW)


@query
def workload_summary(lab: Lab) -> DataFrame:
    submitted = C.submitted_cases(lab.cases(), lab.locations(), CALENDAR)
    return W.workload_summary(status_counts(lab), submitted, open_cases(lab))


@query
def workload_by_category(lab: Lab) -> DataFrame:
    return W.workload_by_category(lab.cases(), lab.case_products(), lab.products())


@query
def gemba_grid(lab: Lab) -> DataFrame:
    return W.gemba_grid(open_cases(lab), V.MANUFACTURING_LOCATIONS, CALENDAR, as_of=AS_OF)


@query
def pace_cases(lab: Lab) -> DataFrame:
    return W.pace_cases(detail(lab), CALENDAR.next_day(AS_OF, 2))


@query
def daily_sales(lab: Lab) -> DataFrame:
    return S.daily_sales(lab.cases(), lab.case_products(), lab.products(), as_of=AS_OF)


@query
def monthly_sales(lab: Lab) -> DataFrame:
    return S.monthly_sales(lab.cases(), as_of=AS_OF)


@query
def revenue_by_day(lab: Lab) -> DataFrame:
    return S.revenue_by_day(lab.cases(), as_of=AS_OF)


@query
def monthly_trend(lab: Lab) -> DataFrame:
    return S.monthly_trend(S.monthly_sales(lab.cases(), as_of=AS_OF), as_of=AS_OF)


@query
def daily_trend(lab: Lab) -> DataFrame:
    return S.daily_trend(S.daily_invoices(lab.cases(), as_of=AS_OF), as_of=AS_OF)


@query
def sales_history(lab: Lab) -> DataFrame:
    daily = S.daily_sales(lab.cases(), lab.case_products(), lab.products(), as_of=AS_OF)
    return S.sales_history(daily, CALENDAR)


@query
def monthly_goals(lab: Lab) -> DataFrame:
    monthly = S.monthly_sales(lab.cases(), as_of=AS_OF)
    return S.monthly_goals(monthly, lab.goals(), as_of=AS_OF)


@query
def annual_goals(lab: Lab) -> DataFrame:
    return S.annual_goals(lab.cases(), lab.goals(), as_of=AS_OF)
