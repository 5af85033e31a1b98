"""Queries over remakes, receivables, customers, stores and mirrors."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import calendar as K
from casewright.operators import customers as B
from casewright.operators import dimension as D
from casewright.operators import edits as Z
from casewright.operators import mirror as M
from casewright.operators import receivables as A
from casewright.operators import remakes as R
from casewright.plans.lab_views import AS_OF, CALENDAR, Lab, money
from casewright.plans.registry import query
from casewright.plans.task_queries import daily
from casewright.sources.tables import between_days, recent

LINE_TIE = ("case_product_id", "product_id", "source_id", "line_date")
SHARE = "//store/files"


def remake_pairs(lab: Lab, columns: list[str] = R.PAIR_COLUMNS) -> DataFrame:
    return R.remake_pairs(lab.case_links(), lab.cases(), as_of=AS_OF, columns=columns)


def remake_ids(lab: Lab) -> DataFrame:
    return R.pair_ids(remake_pairs(lab, ["date_in"]))


def remake_rows(lab: Lab) -> DataFrame:
    return R.remakes(
        remake_pairs(lab),
        lab.cases(),
        lab.customers(),
        lab.case_products(),
        lab.products(),
        as_of=AS_OF,
        tie=[F.col(c).desc() for c in LINE_TIE],
    )


def accounts(lab: Lab) -> DataFrame:
    return A.past_due_accounts(lab.customers(), excluded_group="ASIA")


def sectioned(lab: Lab) -> DataFrame:
    owed = accounts(lab)
    return A.sections(owed, A.open_cases_of(lab.cases(), owed), named_group="AMERICA")


def book(lab: Lab) -> DataFrame:
    return B.customer_book(lab.customers(), lab.customer_dates(), lab.sales_summary())


@query
def remakes(lab: Lab) -> DataFrame:
    return remake_rows(lab)


@query
def remakes_meeting(lab: Lab) -> DataFrame:
    return R.meeting_view(remake_rows(lab), "Remake").select("main_case_id", "og_case_id", "remake")


@query
def practice_remake_rate(lab: Lab) -> DataFrame:
    return R.practice_remake_rate(lab.cases(), lab.customers(), as_of=AS_OF)


@query
def remake_tasks(lab: Lab) -> DataFrame:
    return R.tasks_of(lab.task_history(), remake_ids(lab))


@query
def remake_notes(lab: Lab) -> DataFrame:
    notes = R.notes_of(lab.call_notes(), lab.case_calls(), remake_ids(lab))
    return R.resolve_names(notes, lab.employees(), "user_id", "user_name")


@query
def case_details(lab: Lab) -> DataFrame:
    return R.case_details(lab.task_history(), remake_pairs(lab, ["date_in"]))


@query
def documents_exploded(lab: Lab) -> DataFrame:
    return R.documents_exploded(lab.case_documents(), share=SHARE)


@query
def preferences(lab: Lab) -> DataFrame:
    return R.preferences(lab.preferences())


@query
def past_due_accounts(lab: Lab) -> DataFrame:
    return accounts(lab)


@query
def open_cases_past_due(lab: Lab) -> DataFrame:
    return A.open_cases_of(lab.cases(), accounts(lab))


@query
def collections_sections(lab: Lab) -> DataFrame:
    return sectioned(lab).select("customer_id", "section", "open_cases", "on_hold", "total_past_due")


@query
def section_stats(lab: Lab) -> DataFrame:
    return A.section_stats(sectioned(lab))


@query
def collections_summary(lab: Lab) -> DataFrame:
    return A.report_summary(sectioned(lab))


@query
def cases_by_customer(lab: Lab) -> DataFrame:
    """The nested case lists of all pages, opened again."""
    pages = A.cases_by_customer(A.open_cases_of(lab.cases(), accounts(lab)), page_size=3)
    return pages.select("customer_id", "total", "pages", F.inline("cases"))


@query
def customers(lab: Lab) -> DataFrame:
    return book(lab)


@query
def filter_customers(lab: Lab) -> DataFrame:
    rows = B.filter_customers(
        book(lab), tab="active", filters={"type": "BUILDING", "city": None}, search=" cATalog 2 "
    )
    return rows.select("customer_id", "practice_name", "price_catalog")


@query
def customers_by_mail(lab: Lab) -> DataFrame:
    """A search that only an e-mail address can meet."""
    return B.filter_customers(book(lab), search="FRONT1").select("customer_id", "email")


@query
def customer_metrics(lab: Lab) -> DataFrame:
    return B.customer_metrics(book(lab), as_of=AS_OF)


@query
def filter_options(lab: Lab) -> DataFrame:
    return B.filter_options(book(lab))


@query
def natural_sort_page(lab: Lab) -> DataFrame:
    rows = book(lab).select("customer_id", "practice_name")
    order = [B.natural_key(F.col("practice_name")), B.natural_key(F.col("customer_id"))]
    # Page 2 of a hundred rows each, the feature itself.
    return B.with_total(B.page(rows, order, 2, 100, place="position"), rows)


@query
def mixed_sort_page(lab: Lab) -> DataFrame:
    key = F.col("customer_id").cast("bigint")
    text = (
        F.when(key % 3 == 0, F.col("date_of_first_case").cast("string"))
        .when(key % 3 == 1, F.concat(key.cast("string"), F.lit(" units")))
        .otherwise(F.col("practice_name"))
    )
    rows = book(lab).select("customer_id", text.alias("shown"))
    order = [*B.mixed_key(F.col("shown")), F.col("customer_id")]
    return B.numbered(rows, order)


@query
def business_calendar(lab: Lab) -> DataFrame:
    day = F.col("day")
    monday, friday = K.work_week(day)
    last_monday, last_friday = K.work_week(day, 1)
    month_first, month_last = K.month_back(day, 2)
    days = lab.table("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    shifts = {"previous": -1, "next_1": 1, "next_2": 2, "ago_5": -5, "ago_250": -250}
    return CALENDAR.shifted(days, day, shifts).select(
        "day",
        CALENDAR.is_business(day).alias("is_business"),
        *shifts,
        F.element_at(K.weekdays_back(day, 6), 6).alias("weekday_6"),
        monday.alias("week_monday"),
        friday.alias("week_friday"),
        last_monday.alias("last_monday"),
        last_friday.alias("last_friday"),
        month_first.alias("month_first"),
        month_last.alias("month_last"),
    )


@query
def holiday_rules(lab: Lab) -> DataFrame:
    """Ordered value lost to rule-based holidays, per holiday."""
    day = F.to_date("o_orderdate")
    rows = lab.table("orders").select(K.rule_holiday_name(day).alias("holiday"), "o_totalprice")
    return (
        rows.filter("holiday IS NOT NULL")
        .groupBy("holiday")
        .agg(F.count("*").alias("orders"), F.sum(money(F.col("o_totalprice"))).alias("amount"))
    )


FIRST_RUN, SECOND_RUN = datetime(1998, 5, 16, 2, 0), datetime(1998, 6, 15, 2, 0)


@query
def upsert_cases(lab: Lab) -> DataFrame:
    """Nightly upsert of the last 180 days over a mirror that is a month old and partly outdated."""
    cases = lab.cases().filter(F.col("date_in") <= F.lit(AS_OF).cast("timestamp_ntz"))
    customers_mirror = M.upsert(
        None,
        M.mapped_rows(lab.customers().filter("NOT deleted"), M.customers_target(), {}),
        M.customers_target(),
        now=FIRST_RUN,
    )
    statuses = M.upsert(
        None,
        M.mapped_rows(cases.filter("status <> 'Cancelled'"), M.statuses_target(), {}),
        M.statuses_target(),
        now=FIRST_RUN,
    )
    parents = {"customers": customers_mirror, "statuses": statuses}
    target = M.cases_target()
    charge = F.when(F.col("case_id") % 4 == 0, F.col("total_charge") + 1).otherwise(F.col("total_charge"))
    old = recent(cases, "date_in", 365, AS_OF).filter(
        F.col("date_in") < K.wall_clock(FIRST_RUN)
    ).withColumn("total_charge", charge.cast("decimal(18,2)"))
    current = M.upsert(None, M.mapped_rows(old, target, parents), target, now=FIRST_RUN)
    source = M.mapped_rows(recent(cases, "date_in", 180, AS_OF), target, parents)
    merged = M.upsert(current, source, target, now=SECOND_RUN)
    return merged.select(
        "case_number",
        *target.columns,
        F.col("customer_id").isNotNull().alias("has_customer"),
        F.col("status_id").isNotNull().alias("has_status"),
        M.STAMP,
    )


@query
def upsert_customers(lab: Lab) -> DataFrame:
    """Nightly upsert of customers with their contact data over a mirror that lacks some and has old numbers of others."""
    target, key = M.customers_target(), F.col("customer_id").cast("bigint")
    source = lab.customers().filter("NOT deleted")
    outdated = {
        "office_phone": F.when(key % 4 == 0, F.lit("555-0000")).otherwise(F.col("office_phone")),
        "address2": F.when(key % 7 != 0, F.col("address2")),
        "email": F.when(key % 10 == 3, F.lit(None)).otherwise(F.col("email")),
    }
    old = source.filter(key % 9 != 0).withColumns(outdated)
    current = M.upsert(None, M.mapped_rows(old, target, {}), target, now=FIRST_RUN)
    merged = M.upsert(current, M.mapped_rows(source, target, {}), target, now=SECOND_RUN)
    return merged.select("customer_code", *target.columns, M.STAMP)


@query
def replace_children(lab: Lab) -> DataFrame:
    """Tasks of the last 180 days' cases replaced; tasks of older cases stay, those of deleted cases are orphans."""
    cases = lab.cases().filter(F.col("date_in") <= F.lit(AS_OF).cast("timestamp_ntz"))
    fresh = cases.filter(between_days(F.col("date_in"), date(1997, 12, 17), AS_OF))
    tasks = lab.case_tasks()
    current = (
        M.task_children(tasks, cases)
        .withColumn("case_id", F.col("case_number").cast("bigint"))
        .select("case_id", F.lit("old").alias("task_name"), "completed_at")
    )
    parents = cases.filter("NOT deleted").select("case_number", "case_id")
    return M.replace_children(
        current, M.task_children(tasks, fresh), parents, parent_key="case_number", parent_id="case_id"
    ).table


@query
def orphan_children(lab: Lab) -> DataFrame:
    cases = lab.cases()
    parents = cases.filter("NOT deleted").select("case_number", "case_id")
    result = M.replace_children(
        None,
        M.task_children(lab.case_tasks(), cases),
        parents,
        parent_key="case_number",
        parent_id="case_id",
    )
    return result.orphans


@query
def history_children(lab: Lab) -> DataFrame:
    """Task history with actions, counted per action and whether the employee is known."""
    staff = lab.employees().filter("team IS NOT NULL").select(
        F.col("employee_id").cast("string").alias("employee_code"), "employee_id"
    )
    rows = M.history_children(lab.task_history(), staff)
    return rows.groupBy("action", F.col("employee_id").isNotNull().alias("known")).agg(
        F.count("*").alias("n"), F.max("action_at").alias("newest")
    )


@query
def apply_edits(lab: Lab) -> DataFrame:
    """Event log as a stream of partial edits over one note per customer."""
    state = lab.table("customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.lit("first call").alias("outcome"),
        F.col("c_mktsegment").alias("notes"),
        F.lit(False).alias("completed"),
        K.wall_clock(datetime(2023, 12, 31)).alias("last_updated"),
    )
    event = F.col("event_type")
    edits = lab.table("events").select(
        F.concat(F.lit(" "), (F.col("user_id") * 11).cast("string")).alias("customer_id"),
        F.when(event == "click", F.get_json_object("props", "$.k"))
        .when(event == "error", "")
        .alias("outcome"),
        F.when(event == "view", F.col("value").cast("string")).alias("notes"),
        F.when(event == "purchase", F.lit(True)).when(event == "signup", F.lit(False)).alias("completed"),
        F.col("ts").alias("last_updated"),
        F.col("event_id").alias("edit_id"),
    )
    return Z.apply_edits(
        state, edits, key="customer_id", defaults={"outcome": "", "notes": "", "completed": False}
    )


@query
def fold_duplicates(lab: Lab) -> DataFrame:
    """Longest text per document source and language, whole texts compared."""
    rows = lab.table("documents").select(
        F.concat_ws("/", "source", "lang").alias("shelf"),
        "text",
        (F.col("doc_id") % 10 == 3).alias("marked"),
        "doc_id",
    )
    return Z.fold_duplicates(rows, "shelf", texts=["text"], flags=["marked"], stamp="doc_id")


@query
def dataset_profile(lab: Lab) -> DataFrame:
    return D.profile(
        {
            "orders": (lab.table("orders"), "o_orderdate"),
            "lines": (lab.table("lineitem"), "l_shipdate"),
            "events": (lab.table("events"), "ts"),
            "customers": (lab.table("customer"), None),
            "documents": (lab.table("documents"), None),
        }
    )


@query
def rename_reapply(lab: Lab) -> DataFrame:
    """Team rename over the daily store, then the current employee list over it."""
    renamed = D.rename_values(daily(lab), "team", {"BUILDING": "Bricks", "MACHINERY": "Engines"})
    current = lab.employees().filter(F.col("employee_id") % 2 == 0).select(
        F.col("employee_id").cast("bigint").alias("employee_id"),
        F.concat(F.lit("New "), "staff_name").alias("staff_name"),
        F.when(F.col("employee_id") % 4 == 0, F.col("team")).alias("team"),
        F.lit(9).alias("training_plan"),
    )
    fixed = D.reapply_dimension(
        renamed, current, key="employee_id", columns=["staff_name", "team", "training_plan"]
    )
    fixed = D.repair_teams(fixed.fillna("0", ["team"]), ["Given11 Mid Family11", "Given33 Mid Family33"])
    return fixed.select("date", "employee_id", "staff_name", "team", "training_plan")
