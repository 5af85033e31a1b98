"""Shapes the physical plans must and must not have."""

import re

import pytest

from casewright import plans
from casewright.operators import efficiency
from casewright.plans.lab_views import CALENDAR, EVENT_DAY, Lab
from casewright.plans.task_queries import daily

FOLDER = "/root/testdata/sf0.001"
QUERIES = plans.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def big_tables(spark):
    """Plans as for tables that are too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# Windows without partition may only see a series of fixed length, or one page.
SINGLE_TASK_WINDOWS = {"monthly_trend", "daily_trend", "natural_sort_page"}
FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BroadcastHashJoin",
    "PythonUDF",
    "ArrowEvalPython",
    "MapInPandas",
)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_joins_no_python_no_global_windows(big_tables, name):
    text = plan(QUERIES[name](big_tables, FOLDER))
    for bad in FORBIDDEN:
        assert bad not in text, bad
    windows = re.findall(r"windowspecdefinition\(\S+ (?:ASC|DESC)", text)
    assert not windows or name in SINGLE_TASK_WINDOWS


@pytest.mark.parametrize("name", ["task_durations", "midday_snapshot"])
def test_only_wanted_rows_are_ranked(big_tables, name):
    text = plan(QUERIES[name](big_tables, FOLDER))
    window = text.index("row_number()")
    assert "LeftSemi" in text[window:]


@pytest.mark.parametrize("name", ["checkin_windows"])
def test_rankings_are_cut_before_the_shuffle(big_tables, name):
    text = plan(QUERIES[name](big_tables, FOLDER))
    assert re.search(r"WindowGroupLimit.*Partial", text)


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("airway_task_counts", "GreaterThanOrEqual(ts"),
        ("design_windows", "GreaterThanOrEqual(ts"),
        ("daily_sales", "GreaterThanOrEqual(o_orderdate"),
        ("stage1_tasks", "LessThan(ts"),
        ("upsert_cases", "GreaterThanOrEqual(o_orderdate"),
    ],
)
def test_date_filters_reach_the_scan(spark, name, pushed):
    text = plan(QUERIES[name](spark, FOLDER))
    formatted = QUERIES[name](spark, FOLDER)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert pushed in formatted, text


def test_scans_read_only_needed_columns(spark):
    text = plan(QUERIES["workload_status"](spark, FOLDER))
    columns = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert all("l_extendedprice" not in c and "o_totalprice" not in c for c in columns)


def test_period_matrix_shuffles_its_employees_once(big_tables):
    text = plan(QUERIES["efficiency_periods"](big_tables, FOLDER))
    main = text.split("Subquery")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(staff_name", main)) <= 1


def test_period_matrix_reads_the_store_once(big_tables):
    rows = daily(Lab(big_tables, FOLDER))
    told = efficiency.efficiency_periods(rows, CALENDAR, as_of=EVENT_DAY, newest=EVENT_DAY)
    assert len(re.findall(r"Exchange hashpartitioning\(staff_name", plan(told))) <= 1
    # Without the newest day, what is read again is the written matrix, not the events.
    text = plan(QUERIES["efficiency_periods"](big_tables, FOLDER))
    assert "events.parquet" not in text and "Exchange hashpartitioning" not in text


# The airway list also joins customers, three joins by themselves in the lab view, and the table of business days.
@pytest.mark.parametrize("name, most", [("open_case_list", 7), ("open_case_list_by_dept", 7), ("airway_workflow", 13)])
def test_facts_of_case_numbers_are_read_once(big_tables, name, most):
    """The wanted cases are written first; then tasks and lines are read once each and meet in one aggregate by number."""
    text = plan(QUERIES[name](big_tables, FOLDER))
    assert len(re.findall(r"lineitem\.parquet", text)) <= 2 and "orders.parquet" not in text
    assert len(re.findall(r"Exchange ", text)) <= most
    assert "partial_max(done" in text and "Window" not in text


def test_operator_counts_read_few_facts(big_tables):
    text = plan(QUERIES["cases_by_operator"](big_tables, FOLDER))
    assert len(re.findall(r"lineitem\.parquet", text)) <= 2 and len(re.findall(r"orders\.parquet", text)) <= 1
