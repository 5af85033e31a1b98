"""Hand-made tables for the edge cases of each operator family."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casewright import vocabulary as V
from casewright.functions.calendar import BusinessCalendar
from casewright.operators import cases as C
from casewright.operators import customers as B
from casewright.operators import dimension as D
from casewright.operators import efficiency as E
from casewright.operators import joins as J
from casewright.operators import pick as P
from casewright.operators import receivables as A
from casewright.operators import remakes as R
from casewright.operators import sales as S
from casewright.operators import tasks as T
from casewright.operators import workload as W

CALENDAR = BusinessCalendar(frozenset({date(2026, 7, 3)}))
MONDAY = date(2026, 7, 6)
AT = datetime


def test_priority_pick_gives_one_row_per_key(spark):
    rows = [(1, "Metal"), (1, "E² Expanders"), (1, "E-Expander Z"), (2, "Zeta"), (2, "Alpha"), (3, None)]
    df = spark.createDataFrame(rows, "case_id int, category string")
    got = {r.case_id: r.category for r in P.priority_pick(df, ["case_id"]).collect()}
    assert got == {1: "E² Expanders", 2: "Zeta", 3: None}


def test_latest_task_prefers_completed_and_breaks_ties(spark):
    rows = [
        (1, 1, "a", None),
        (1, 2, "b", AT(2026, 1, 1)),
        (1, 3, "c", AT(2026, 1, 1)),
        (2, 1, "open", None),
    ]
    df = spark.createDataFrame(rows, "case_id int, line int, task string, complete_date timestamp_ntz")
    df = df.withColumn("department", F.lit("d"))
    got = {r.case_id: r.last_task for r in C.latest_tasks(df, ["complete_date", "line"]).collect()}
    assert got == {1: "c", 2: "open"}


def flagged(spark, rows, **options):
    df = spark.createDataFrame(rows, "pan_number string, ship_date date")
    out = C.add_flags(df, MONDAY, CALENDAR, **options).collect()
    return [(r.is_rush, r.leaves_today, r.is_overdue) for r in out]


def test_flags_around_a_long_weekend(spark):
    rows = [
        ("100", date(2026, 7, 2)),  # previous business day: Friday is a holiday
        ("100", date(2026, 7, 1)),
        ("R1", MONDAY),
        ("100", MONDAY),
        (None, None),
    ]
    assert flagged(spark, rows) == [
        (False, False, True),
        (False, False, False),
        (True, True, True),
        (False, True, False),
        (False, False, False),
    ]
    assert flagged(spark, rows, or_earlier=True)[1] == (False, False, True)


def test_rush_dates_move_before_holidays(spark):
    rows = [("R1", MONDAY), ("1", MONDAY), ("r2", date(2026, 7, 8)), ("R3", None)]
    df = spark.createDataFrame(rows, "pan_number string, ship_date date")
    got = [r.ship_date for r in C.adjust_rush_dates(df, CALENDAR).collect()]
    assert got == [date(2026, 7, 2), MONDAY, date(2026, 7, 7), None]
    spanned = C.adjust_rush_dates(df, CALENDAR, span=(date(2026, 7, 1), date(2026, 7, 10)))
    assert [r.ship_date for r in spanned.collect()] == got


CASE_ROWS = [
    ("1001", "R1", date(2026, 7, 6), "Metal", "QC"),
    ("1002", "2001", date(2025, 7, 6), "MARPE", " "),
    ("1.03", None, date(2026, 7, 7), "Metal", None),
]


def test_case_filters(spark):
    df = spark.createDataFrame(
        CASE_ROWS, "case_number string, pan_number string, ship_date date, category string, location string"
    )
    df = C.add_flags(df, MONDAY, CALENDAR)

    def found(**filters):
        return sorted(r.case_number for r in C.filter_cases(df, **filters).collect())

    assert found(search=" r1") == ["1001"]
    assert found(search="1.0") == ["1.03"]
    assert found(search="1.0", regex=True) == ["1.03", "1001", "1002"]
    assert found(location=V.NO_LOCATION) == ["1.03", "1002"]
    assert found(location="QC", category="Metal") == ["1001"]
    assert found(ship_day="7/6") == ["1001", "1002"]
    assert found(ship_date=MONDAY) == ["1001"]
    assert found(flag="rush") == ["1001"]
    badge = C.case_badges(df, {"a": {}, "b": {"flag": "leaves_today"}}).first()
    assert (badge.a, badge.b) == (3, 1)


def test_location_summary_has_one_empty_bucket(spark):
    rows = [("QC", "Metal"), ("QC", "Clear"), (None, "Metal"), (" ", "Metal"), ("Attic", "Metal")]
    df = spark.createDataFrame(rows, "location string, category string")
    got = {(r.location, r.category): (r.n, r.location_rank, r.degrees) for r in C.location_summary(df).collect()}
    assert got[("QC", "Metal")] == (1, 18, 180.0)
    assert got[(V.NO_LOCATION, "Metal")] == (2, 24, 360.0)
    assert got[("Attic", "Metal")] == (1, 23, 360.0)
    cards = C.location_cards(C.location_summary(df)).collect()
    assert [c.location for c in cards] == ["QC", "Attic", V.NO_LOCATION]
    assert cards[0].categories == {"Clear": 1, "Metal": 1}


def test_planning_exclusion_keeps_null_locations(spark):
    rows = [("MARPE", "New Cases"), ("MARPE", None), ("Metal", "New Cases")]
    df = spark.createDataFrame(rows, "category string, location string")
    keep = C.exclude_pairs(F.col("category"), F.col("location"), "MARPE", V.PLANNING_LOCATIONS)
    assert df.filter(keep).count() == 2


def test_stages_without_cases_appear(spark):
    rows = [("Zoom Consult", date(2026, 1, d)) for d in range(1, 10)] + [("Zoom Consult", None)]
    df = spark.createDataFrame(rows, "location string, ship_date date")
    got = C.stage_summary(df).collect()
    consult = sorted((r for r in got if r.location == "Zoom Consult"), key=lambda r: r.date_rank)
    assert len(got) == 8 + 6
    assert [r.date_rank for r in consult] == [1, 2, 3, 4, 5, 6]
    assert (consult[0].total, consult[0].extra_dates) == (10, 3)


def test_no_scan_alarm(spark):
    now = AT(2026, 7, 6, 12)
    rows = [
        ("a", True, None, None),
        ("b", True, "QC", None),
        ("c", True, "Email Follow Up", None),
        ("d", True, "Oven", AT(2026, 7, 6, 8)),
        ("e", True, "Oven", AT(2026, 7, 6, 7, 59)),
        ("f", False, "Oven", None),
    ]
    df = spark.createDataFrame(rows, "id string, is_overdue boolean, location string, last_scan timestamp_ntz")
    assert sorted(r.id for r in C.overdue_no_scan(df, now).collect()) == ["a", "e"]


# -- workload --------------------------------------------------------------------------------------


def workload_tables(spark):
    cases = spark.createDataFrame(
        [
            (1, "1", "10", "In Production", AT(2026, 7, 6, 9)),
            (2, "2", "R2", "Invoiced", AT(2026, 7, 6)),
            (3, "3", "10", "In Production", AT(2026, 7, 7)),
            (4, "4", "10", "In Production", AT(2026, 7, 7)),
            (5, "5", "10", "In Production", AT(2026, 7, 1)),
            (6, "6", "10", "On Hold", AT(2026, 7, 7)),
            (7, "7", "R7", "In Production", AT(2026, 7, 9)),
            (8, "8", "10", "In Production", None),
        ],
        "case_id long, case_number string, pan_number string, status string, ship_date timestamp_ntz",
    )
    cases = cases.select(
        "*",
        F.col("ship_date").alias("due_date"),
        F.lit(False).alias("local_delivery"),
        F.lit(1).alias("last_location_id"),
    )
    lines = [(1, 1), (1, 2), (2, 3), (4, 4), (4, 5), (7, 2), (7, 99)]
    products = [(1, "Metal"), (2, "Hybrid"), (3, ""), (4, "Airway"), (5, None)]
    return (
        cases,
        spark.createDataFrame(lines, "case_id long, product_id long"),
        spark.createDataFrame(products, "product_id long, category string"),
        spark.createDataFrame([(1, "QC")], "id int, description string"),
    )


def test_workload_detail(spark):
    args = workload_tables(spark)
    got = {r.case_id: (r.category, r.ship_date, r.orig_ship_date) for r in W.workload_detail(*args, CALENDAR, as_of=MONDAY).collect()}
    assert got == {
        1: ("Hybrid", MONDAY, MONDAY),
        2: ("Other", date(2026, 7, 2), MONDAY),
        3: ("Other", date(2026, 7, 7), date(2026, 7, 7)),
        7: ("Hybrid", date(2026, 7, 8), date(2026, 7, 9)),
    }
    wide = W.workload_detail(*args, CALENDAR, as_of=MONDAY, include_uncategorised=True)
    assert sorted(r.case_id for r in wide.collect()) == [1, 2, 3, 4, 7]
    bare = W.without_products(*args[:3]).select("case_id").collect()
    assert sorted(r.case_id for r in bare) == [3, 5, 6, 8]


def test_pace_adds_up(spark):
    cases = workload_tables(spark)[0]
    counts = W.workload_status(cases, CALENDAR, as_of=MONDAY)
    rows = W.workload_pace(counts).collect()
    assert all(r.total == r.invoiced + r.in_production for r in rows)
    first = rows[0]
    assert (first.ship_date, first.invoiced, first.pct, first.tier, first.label) == (
        date(2026, 7, 2),
        1,
        100.0,
        "green",
        "Thu Jul 02",
    )


def test_margins(spark):
    rows = [("Metal", date(2026, 7, 6))] * 2 + [("Clear", date(2026, 7, 7))]
    df = spark.createDataFrame(rows, "category string, ship_date date")
    got = {r.category: (r.day_00, r.day_01, r.total) for r in W.pivot_margins(df, [date(2026, 7, 6), date(2026, 7, 7)]).collect()}
    assert got == {"Metal": (2, 0, 2), "Clear": (0, 1, 1), "TOTAL": (2, 1, 3)}


# -- sales -----------------------------------------------------------------------------------------


def test_monthly_trend_spans_calendar_months(spark):
    rows = [(2026, 1, 300), (2026, 3, 600), (2026, 4, 90)]
    monthly = spark.createDataFrame(rows, "sales_year int, sales_month int, subtotal int")
    monthly = monthly.withColumn("subtotal", F.col("subtotal").cast("decimal(38,2)"))
    got = {r.label: r.trend for r in S.monthly_trend(monthly, as_of=date(2026, 4, 10), months=4).collect()}
    # February has no sales and counts as zero; April is partial and shows January to March.
    assert got == {"Jan '26": None, "Feb '26": 100.0, "Mar '26": 300.0, "Apr '26": 300.0}


def test_daily_trend_by_brute_force(spark):
    from datetime import timedelta

    as_of = date(2026, 7, 5)  # a Sunday
    facts = {as_of - timedelta(days=k): 10 * k + 1 for k in range(0, 40, 3)}
    df = spark.createDataFrame(list(facts.items()), "sales_date date, subtotal int")
    for day in (as_of, as_of + timedelta(days=1)):
        got = {r.sales_date: r.trend for r in S.daily_trend(df, as_of=day, days=30).collect()}
        first = day - timedelta(days=29)
        span = [first + timedelta(days=k) for k in range(30)]
        for d in span:
            last = d if d < day else d - timedelta(days=1)
            values = [facts.get(x, 0) for x in span if x <= last and x.weekday() < 5][-5:]
            assert got[d] == (sum(values) / 5 if len(values) == 5 else None), d


def test_sales_history_skips_holidays_and_weekends(spark):
    rows = [(date(2026, 7, d), "I", 1, 5) for d in range(1, 8)] + [(date(2026, 7, 6), "S", 9, 9)]
    df = spark.createDataFrame(rows, "sales_date date, type string, n long, subtotal int")
    got = [(r.sales_date.day, r.n) for r in S.sales_history(df, CALENDAR, days=3).collect()]
    assert got == [(2, 1), (6, 1), (7, 1)]


# -- task logs and efficiency ----------------------------------------------------------------------

HISTORY = "case_id long, case_number string, task string, case_product_id int, completed_by string, complete_date timestamp_ntz, rejected string"


def test_rejected_rows_take_their_twins_along(spark):
    at = AT(2026, 1, 5, 9)
    rows = [
        (1, "1", "t", 1, "7", at, "No"),
        (1, "1", "t", 1, "7", at, "Yes"),
        (2, "2", "t", 1, "7.0", at, "No"),
        (3, "3", "t", 1, None, at, "No"),
        (3, "3", "t", 1, None, at, "Yes"),
        (None, None, "t", 1, "7", at, "No"),
        (4, "4", "t", 2, "12", at, None),
    ]
    history = spark.createDataFrame(rows, HISTORY)
    left = E.accepted_tasks(history).collect()
    assert sorted(str(r.case_id) for r in left) == ["2", "4", "None"]
    plan = spark.createDataFrame(
        [(2, "t", 1, "1.5", 1), (2, "t", 1, "2.25", 2), (4, "t", 2, "bad", 1)],
        "case_id long, task string, case_product_id int, duration string, plan_id int",
    )
    order = [F.col("plan_id").desc()]
    got = {
        r.employee_id: (r.cases_worked_on, r.tasks_completed, r.tasks_duration_hours)
        for r in E.stage1(history, plan, order, date(2026, 1, 5), date(2026, 1, 5)).collect()
    }
    # The row without a case adds no case and no task.
    assert got == {7: (1, 1, Decimal("2.2500")), 12: (1, 1, Decimal("0.0000"))}


def test_null_safe_anti_join(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (None, None)], "a int, b int")
    bad = spark.createDataFrame([(1, None), (5, 5)], "a int, b int")
    assert sorted(map(tuple, J.anti_null_safe(df, bad, ["a", "b"]).collect()), key=str) == [(1, 2), (None, None)]


def test_fan_out_totals_equal_the_pairs(spark):
    at = AT(2026, 1, 5, 9)
    history = spark.createDataFrame([(1, "1", "t", 1, "7", at, "No"), (1, "1", "t", 1, "7", AT(2026, 1, 5, 15), "No")], HISTORY)
    plan = spark.createDataFrame(
        [(1, "t", 1, "1.0", 1), (1, "t", 1, "2.0", 2)],
        "case_id long, task string, case_product_id int, duration string, plan_id int",
    )
    staff = spark.createDataFrame([(7, "Ann Lee", None)], "employee_id int, staff_name string, team string")
    order = [F.col("plan_id").asc()]

    def run(**options):
        rows = E.midday_snapshot(history, plan, staff, order, as_of=date(2026, 1, 5), **options).collect()
        return {r.window: (r.team, r.cases_worked_on, r.tasks_completed, float(r.tasks_duration_hours)) for r in rows}

    # 15:00 sharp still belongs to the closed 3pm window.
    assert run() == {"noon": ("Unknown", 1, 1, 1.0), "3pm": ("Unknown", 1, 2, 2.0)}
    assert run(fan_out=True) == {"noon": ("Unknown", 1, 2, 3.0), "3pm": ("Unknown", 1, 4, 6.0)}


DAILY = "date date, employee_id long, staff_name string, team string, training_plan int, efficiency string"


def test_period_matrix(spark):
    rows = [
        (date(2026, 7, 2), 1, "Ann", None, 1, "50.00"),
        (date(2026, 7, 1), 1, "Ann", "A", 1, "0.00"),
        (date(2026, 6, 30), 1, "Ann", "A", 1, "75.00"),
        (date(2026, 7, 2), 2, "Bob", "B", 2, "0.00"),
        (date(2020, 1, 1), 3, "Cy", "C", 3, "10.00"),
    ]
    daily = spark.createDataFrame(rows, DAILY).withColumn("efficiency", F.col("efficiency").cast("decimal(18,2)"))
    matrix = E.efficiency_periods(daily, CALENDAR, as_of=MONDAY)
    got = {r.staff_name: r for r in matrix.collect()}
    assert got["Ann"].days_ago_1 == 0.5 and got["Ann"].days_ago_2 is None
    assert got["Ann"].last_week == 0.625 and got["Ann"].months_ago_1 == 0.75
    assert (got["Ann"].team, got["Ann"].training_plan) == ("A", 1)
    assert got["Bob"].days_ago_1 is None and got["Cy"].training_plan == 0 and got["Cy"].week_0 is None
    names = [c for c in matrix.columns if c not in ("staff_name", "team", "training_plan")]
    assert len(names) == 31 and matrix.columns[:3] == ["staff_name", "team", "training_plan"]
    told = E.efficiency_periods(daily, CALENDAR, as_of=MONDAY, newest=date(2026, 7, 2))
    assert sorted(map(str, told.collect())) == sorted(map(str, matrix.collect()))
    kept = E.drop_empty_periods(matrix, names).columns
    assert "days_ago_1" in kept and "days_ago_2" not in kept
    shown = E.render_sentinel(matrix.select("staff_name", "days_ago_1"), ["days_ago_1"])
    assert {r.staff_name: r.days_ago_1 for r in shown.collect()} == {"Ann": "0.5", "Bob": "x", "Cy": "x"}
    back = E.restore_sentinel(shown, ["days_ago_1"])
    assert {r.staff_name: r.days_ago_1 for r in back.collect()} == {"Ann": 0.5, "Bob": None, "Cy": None}
    long = {(r.staff_name, r.period): r.efficiency for r in E.period_efficiency(daily, CALENDAR, as_of=MONDAY).collect()}
    for name in ("days_ago_1", "last_week", "months_ago_1"):
        assert long[("Ann", name)] / 100 == getattr(got["Ann"], name)


def test_combine_and_unmatched_names(spark):
    hours = spark.createDataFrame(
        [(date(2026, 1, 5), "a", 8.0), (date(2026, 1, 5), "b", 0.0), (date(2026, 1, 5), "ghost", 4.0)],
        "date date, name string, work_hours double",
    )
    staff = spark.createDataFrame(
        [("a", 1, "Ann", "T", 2), ("b", 2, "Bob", None, 0)],
        "payroll_name string, employee_id int, staff_name string, team string, training_plan int",
    )
    tasks = spark.createDataFrame([(1, "1.0001"), (2, "3")], "employee_id long, h string").select(
        "employee_id", F.col("h").cast("decimal(38,4)").alias("tasks_duration_hours")
    )
    joined = E.with_employee(hours, staff)
    assert {(r.name, r.employee_id, r.training_plan) for r in joined.collect()} == {("a", 1, 2), ("b", 2, 0), ("ghost", 0, 0)}
    got = {r.staff_name: r.efficiency for r in E.combine(joined, tasks).collect()}
    assert got == {"Ann": Decimal("12.50"), "Bob": Decimal("0.00")}
    assert [tuple(r) for r in E.unmatched_names(hours, staff).collect()] == [("ghost", 1)]


def test_windows_exclude_their_upper_bound(spark):
    rows = [(AT(2026, 1, 5, h, m),) for h, m in ((2, 59), (3, 0), (11, 59), (12, 0), (15, 0), (23, 59))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = T.explode_windows(df, "ts", V.DESIGN_WINDOWS).groupBy("window").count().collect()
    assert {r.window: r["count"] for r in got} == {"noon": 2, "pm3": 3, "pm11": 2, "allday": 5}


def test_employee_lists_sort_by_count(spark):
    df = spark.createDataFrame([("d", "b", 2), ("d", "a", 2), ("d", "c", 9)], "day string, emp_name string, n long")
    row = T.employee_lists(df, ["day"]).first()
    assert [(e.name, e.n) for e in row.by_employee] == [("c", 9), ("a", 2), ("b", 2)]


def test_unknown_ids_keep_their_text(spark):
    staff = spark.createDataFrame([(12, "Ann Mary Lee")], "employee_id int, staff_name string")
    df = spark.createDataFrame([("12.0",), ("99",), ("walk-in",), (None,)], "id string")
    assert [r.emp_name for r in T.employee_name(df, staff, "id").collect()] == ["Ann L.", "ID:99", "walk-in", ""]
    names = R.resolve_names(df, staff, "id", "who").collect()
    assert [r.who for r in names] == ["Ann Mary Lee", "99", "walk-in", ""]


# -- remakes ---------------------------------------------------------------------------------------


def test_split_names_and_paths(spark):
    rows = [
        ("a b.stl", 1, ["a b.stl"]),
        ("upper 1.stl lower.jpeg x.png", 3, ["upper 1.stl", "lower.jpeg", "x.png"]),
        ("plan  notes  sketch", 3, ["plan", "notes", "sketch"]),
        ("one.pdf two.pdf", 3, ["one.pdf two.pdf"]),
        (None, 2, [""]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "n string, c int")
    assert [r[0] for r in df.select(R.split_names(F.col("n"), F.col("c"))).collect()] == [r[2] for r in rows]
    paths = [
        ("CaseDocuments", "\\Feb\\24\\x.pdf", "n", "CaseDocuments/Feb/24/x.pdf"),
        ("Digital Impression", "\\1\\Up\\", "n.stl", "DigitalImpressions/1/Up/n.stl"),
        ("Design", "\\\\Host\\Share\\designs\\9\\", "n", "designs/9/n"),
        ("Odd", "a/b", "n", "Odd/a/b"),
    ]
    df = spark.createDataFrame(paths, "r string, p string, n string, want string")
    out = df.select(R.document_path(F.col("r"), F.col("p"), F.col("n"), share="//host/share").alias("got"), "want")
    assert all(r.got == r.want for r in out.collect())


def test_either_end_and_meeting_view(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3), (1, 2), (None, None)], "a int, b int")
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    got = J.semi_either(df, "a", "b", ids, "id").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 2), (1, None), (None, 2)]
    kinds = spark.createDataFrame([("x",), (None,), ("y",)], "remake string")
    assert R.meeting_view(kinds, "x").count() == 2


# -- receivables -----------------------------------------------------------------------------------


def accounts_table(spark):
    rows = [
        ("1", "499.99", "0", "G", False),
        ("2", "250", "250", None, False),
        ("3", None, "10", "Named", False),
        ("4", "900", None, "Named", False),
        ("5", "1", "1", "Out", False),
        ("6", "0", None, None, False),
        ("7", "9", "9", None, True),
    ]
    df = spark.createDataFrame(rows, "customer_id string, p90 string, p91 string, dental_group string, deleted boolean")
    money = "decimal(12,2)"
    zero = F.lit("0").cast(money)
    return df.select(
        "customer_id",
        "dental_group",
        "deleted",
        F.lit("lab").alias("lab_name"),
        F.lit("p").alias("practice_name"),
        F.lit(None).cast("string").alias("first_name"),
        F.lit("L").alias("last_name"),
        F.lit("s").alias("sales_person"),
        F.lit("1").alias("office_phone"),
        F.lit("e").alias("bill_email"),
        F.lit(None).cast("date").alias("last_payment_date"),
        zero.alias("past_due_30"),
        F.lit(None).cast(money).alias("past_due_60"),
        F.col("p90").cast(money).alias("past_due_90"),
        F.col("p91").cast(money).alias("past_due_over_90"),
        zero.alias("current_balance"),
        zero.alias("total_balance"),
        zero.alias("unapplied_payments"),
        F.lit(None).cast(money).alias("unapplied_credits"),
        zero.alias("this_period_charges"),
        zero.alias("last_payment_amount"),
        F.lit(False).alias("is_on_cod"),
        F.lit(True).alias("on_credit_hold"),
        F.lit(True).alias("in_collection"),
    )


def test_sections_and_stats(spark):
    accounts = A.past_due_accounts(accounts_table(spark), excluded_group="Out")
    cases = spark.createDataFrame(
        [("1", 1, "In Production"), ("1", 2, "On Hold"), ("4", 3, "In Production"), ("9", 4, "On Hold")],
        "customer_id string, case_id long, status string",
    )
    rows = A.sections(accounts, cases, named_group="Named")
    got = {r.customer_id: (r.section, r.open_cases, r.on_hold, r.account_flag) for r in rows.collect()}
    assert got == {
        "1": (A.SMALL, 1, 1, "Credit Hold"),
        "2": (A.GENERAL, 0, 0, "Credit Hold"),
        "3": (A.NAMED, 0, 0, "Credit Hold"),
        "4": (A.NAMED, 1, 0, "Credit Hold"),
    }
    stats = {r.section: r for r in A.section_stats(rows).collect()}
    parts = [v for k, v in stats.items() if k != "overall"]
    assert stats["overall"].n == sum(p.n for p in parts) == 4
    assert stats["overall"].total_past_due == sum(p.total_past_due for p in parts) == Decimal("1909.99")
    summary = A.report_summary(rows).first()
    assert (summary.accounts, summary.open_cases) == (4, 2)


def test_pages_hold_every_case_once(spark):
    rows = [("big", k) for k in range(1000)] + [("small", 5000)]
    df = spark.createDataFrame(rows, "customer_id string, case_id long")
    pages = A.cases_by_customer(df, page_size=50).collect()
    seen = sorted(c.case_id for p in pages for c in p.cases)
    assert seen == sorted(k for _, k in rows)
    assert max(len(p.cases) for p in pages) < 120 and {p.pages for p in pages} == {20, 1}


# -- customers -------------------------------------------------------------------------------------


def test_natural_and_mixed_order(spark):
    names = ["A10", "a2", "A02b", "", None, "7", "B1"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(B.natural_key(F.col("n")), "n").collect()]
    assert got == [None, "", "7", "a2", "A02b", "A10", "B1"]
    mixed = ["10 units", "9", "2026-01-02", "2025-12-31", "word", "-3", ".5x"]
    df = spark.createDataFrame([(n,) for n in mixed], "n string")
    got = [r.n for r in df.orderBy(*B.mixed_key(F.col("n"))).collect()]
    assert got == ["2025-12-31", "2026-01-02", "-3", ".5x", "9", "10 units", "word"]


def test_tabs_search_and_pages(spark):
    rows = [("1", True, False, "Ann 50%"), ("2", True, True, None), ("3", False, True, "bob"), ("4", None, False, "ANN")]
    df = spark.createDataFrame(rows, "customer_id string, active boolean, prospect boolean, name string")

    def ids(rows):
        return [r.customer_id for r in rows.orderBy("customer_id").collect()]

    assert ids(B.filter_customers(df, tab="active")) == ["1"]
    assert ids(B.filter_customers(df, tab="prospects")) == ["3"]
    assert ids(B.filter_customers(df, search=" ann ")) == ["1", "4"]
    assert ids(B.filter_customers(df, search="50%")) == ["1"]
    assert ids(B.filter_customers(df, filters={"name": "bob", "customer_id": ""})) == ["3"]
    second = B.with_total(B.page(df, [F.col("customer_id")], number=2, size=3), df).collect()
    assert [(r.customer_id, r.total) for r in second] == [("4", 4)]
    assert ids(B.page_after(df, "customer_id", "2", size=1)) == ["3"]
    options = {(r.column, r.value) for r in B.filter_options(df, ["name"]).collect()}
    assert options == {("name", "Ann 50%"), ("name", "bob"), ("name", "ANN")}


# -- dimension -------------------------------------------------------------------------------------


def test_dimension_reapply(spark):
    history = spark.createDataFrame([(1, "old", "t"), (2, "keep", "u")], "id int, staff_name string, team string")
    dim = spark.createDataFrame([(1, "new", None)], "id int, staff_name string, team string")
    got = D.reapply_dimension(history, dim, key="id", columns=["staff_name", "team"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "new", "t"), (2, "keep", "u")]
    with pytest.raises(PySparkException, match="repeated key 1"):
        D.reapply_dimension(history, dim.union(dim), key="id", columns=["staff_name"]).collect()
    fixed = D.repair_teams(
        spark.createDataFrame([("0", "Ann"), ("0", "Bob"), ("A", "Ann")], "team string, staff_name string"), ["Ann"]
    )
    assert [r.team for r in fixed.collect()] == [V.HIDDEN_TEAM, "0", "A"]


def test_missing_days_and_backfill(spark):
    stored = spark.createDataFrame([(date(2026, 7, d),) for d in (1, 3, 3, 5)], "day date")
    missing = E.missing_days(stored, "day", as_of=date(2026, 7, 6), days=6)
    assert {r.day for r in missing.collect()} == {date(2026, 6, 30), date(2026, 7, 2), date(2026, 7, 4)}
    snapshot = spark.createDataFrame([(date(2026, 7, 2), 1), (date(2026, 7, 3), 2)], "data_date date, n int")
    assert [r.n for r in E.backfill(snapshot, missing).collect()] == [1]
