"""Who did which task in which part of the day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright import vocabulary as V
from casewright.functions import text as X
from casewright.functions.calendar import last_weekdays
from casewright.operators.joins import day_spine, densify
from casewright.operators.pick import best_category, case_number, latest_per_key, of_cases, priority_pick, product_categories
from casewright.sources.tables import between_days
from casewright.sources.working import working_table


def employee_name(
    df: DataFrame, employees: DataFrame, id_col: str, *, fallback: str = "ID:", name: str = "emp_name"
) -> DataFrame:
    """Short employee name of an id; unknown ids become ``fallback`` + id, other texts stay."""
    known = employees.select(
        F.col("employee_id").cast("bigint").alias("__emp"),
        X.short_name(F.col("staff_name")).alias("__short"),
    )
    number = X.id_number(F.col(id_col))
    unknown = F.when(number.isNotNull(), F.concat(F.lit(fallback), F.trim(id_col))).otherwise(
        F.coalesce(F.trim(id_col), F.lit(""))
    )
    return (
        df.join(known, number == F.col("__emp"), "left")
        .withColumn(name, F.coalesce("__short", unknown))
        .drop("__emp", "__short")
    )


def with_totals(
    df: DataFrame, keys: Sequence[str], member: str, measures: Mapping[str, Column]
) -> DataFrame:
    """Measures per group and member plus one ``is_total`` row per group, from one aggregate.

    A total as a window over the group would bring all members of a group into one task.
    """
    rows = df.groupingSets([[*keys, member], list(keys)], *keys, member).agg(
        *[measure.alias(name) for name, measure in measures.items()],
        (F.grouping(member) == 1).alias("is_total"),
    )
    return rows


def named_rows(rows: DataFrame, employees: DataFrame) -> DataFrame:
    """Employee names on member rows; total rows have none."""
    named = employee_name(rows, employees, "completed_by")
    return named.withColumn("emp_name", F.when(~F.col("is_total"), F.col("emp_name")))


def task_counts(
    history: DataFrame, *, as_of: date, tasks: Sequence[str] = V.AIRWAY_TASKS, days: int = 7
) -> DataFrame:
    """Distinct cases per employee and day, one column per task.

    Duplicates are removed once on the full key, so the distinct counts share one shuffle and no
    row is multiplied per task.
    """
    rows = history.filter(
        F.col("task").isin(list(tasks))
        & between_days(F.col("complete_date"), as_of - timedelta(days=days), as_of)
    ).select("completed_by", F.to_date("complete_date").alias("day"), "task", "case_number")
    counts = [F.count_if(F.col("task") == task).alias(f"task_{k}") for k, task in enumerate(tasks, 1)]
    return rows.distinct().groupBy("completed_by", "day").agg(*counts)


def task_leaders(
    counts: DataFrame, employees: DataFrame, *, as_of: date, tasks: Sequence[str] = V.AIRWAY_TASKS, n_days: int = 6
) -> DataFrame:
    """Per weekday and task: each employee's count and place, largest first, and the totals as rows of their own.

    A place's window spans the staff of one day and task.
    """
    recent = counts.filter(F.col("day").isin(last_weekdays(as_of, n_days)))
    names = {f"task_{k}": task for k, task in enumerate(tasks, 1)}
    long = recent.unpivot(["completed_by", "day"], list(names), "slot", "n").filter("n > 0")
    rows = with_totals(long, ["day", "slot"], "completed_by", {"n": F.sum("n")})
    order = Window.partitionBy("day", "slot", "is_total").orderBy(F.col("n").desc(), "completed_by")
    return named_rows(rows, employees).withColumn("place", F.row_number().over(order).cast("bigint")).select(
        "day",
        X.weekday_slash(F.col("day")).alias("label"),
        X.map_values(F.col("slot"), names).alias("task"),
        "completed_by",
        "emp_name",
        "is_total",
        "n",
        "place",
    )


def in_window(ts: Column, first_hour: int, last_hour: int, *, closed: bool = False) -> Column:
    """Time of day within a window; the upper bound is exclusive unless ``closed``."""
    midnight = F.to_date(ts).cast("timestamp_ntz")
    end = midnight + F.expr(f"INTERVAL {last_hour} HOURS")
    upper = ts <= end if closed else ts < end
    return (ts >= midnight + F.expr(f"INTERVAL {first_hour} HOURS")) & upper


def explode_windows(
    df: DataFrame, ts: str, windows: Sequence[tuple[str, int, int]], *, closed: bool = False
) -> DataFrame:
    """One row per time-of-day window that holds the row."""
    hits = [
        F.when(in_window(F.col(ts), lo, hi, closed=closed), F.lit(name)) for name, lo, hi in windows
    ]
    return df.withColumn("window", F.explode(F.array_compact(F.array(*hits))))


def design_windows(
    history: DataFrame,
    employees: DataFrame,
    *,
    as_of: date,
    tasks: Sequence[str] = V.DESIGN_TASKS,
    windows: Sequence[tuple[str, int, int]] = V.DESIGN_WINDOWS,
    n_days: int = 6,
) -> DataFrame:
    """Tasks per weekday, window, task and employee.

    ``n`` counts distinct cases of the employee, ``raw`` all rows. The row ``is_total`` of a window
    sums both over all employees.
    """
    days = last_weekdays(as_of, n_days)
    rows = history.filter(
        F.col("task").isin(list(tasks)) & between_days(F.col("complete_date"), days[-1], days[0])
    )
    day = F.to_date("complete_date")
    rows = rows.withColumn("day", day).filter(F.col("day").isin(days))
    rows = explode_windows(rows, "complete_date", windows)
    per_case = rows.groupBy("day", "window", "task", "completed_by", "case_number").agg(
        F.count("*").alias("raw")
    )
    counts = with_totals(
        per_case,
        ["day", "window", "task"],
        "completed_by",
        {"n": F.count("*"), "raw": F.sum("raw")},
    )
    return named_rows(counts, employees).select(
        "day",
        X.weekday_slash(F.col("day")).alias("label"),
        "window",
        "task",
        "completed_by",
        "emp_name",
        "is_total",
        "n",
        "raw",
    )


def employee_lists(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nested form: per group an array of (name, count), largest first, ties by name.

    The input is aggregated, so an array holds at most one entry per employee.
    """
    entries = F.collect_list(F.struct((-F.col("n")).alias("order"), F.col("emp_name").alias("name"), "n"))
    by_count = F.transform(F.array_sort(entries), lambda e: F.struct(e["name"].alias("name"), e["n"].alias("n")))
    members = counts.filter(~F.col("is_total")) if "is_total" in counts.columns else counts
    return members.groupBy(*keys).agg(by_count.alias("by_employee"))


def checkins(
    audit: DataFrame,
    cases: DataFrame,
    case_products: DataFrame,
    products: DataFrame,
    *,
    as_of: date,
    days: int = 45,
    types: Sequence[str] = ("New Case", "Accept Remote Case"),
    machines: Sequence[str] = ("Web", "NULL"),
    tie: Sequence[str] = (),
) -> DataFrame:
    """Latest check-in of each case by a person, with the case's category."""
    events = audit.filter(
        between_days(F.col("create_date"), as_of - timedelta(days=days), as_of)
        & F.col("type").isin(list(types))
        & F.col("created_by").isNotNull()
        & ~F.col("created_by").isin(list(machines))
    )
    order = [F.col(c).desc_nulls_last() for c in ("create_date", *tie)]
    latest = latest_per_key(events, ["case_id"], order).select("case_id", "created_by", "create_date")
    lines = of_cases(case_products, latest)
    categories = priority_pick(
        product_categories(lines, products.filter("category IS NOT NULL")), ["case_id"]
    )
    return (
        latest.join(cases.select("case_id", "case_number"), "case_id", "inner")
        .join(categories, "case_id", "left")
        .select(
            X.short_name(F.col("created_by")).alias("emp_name"),
            "create_date",
            F.to_date("create_date").alias("day"),
            "case_number",
            X.normalise_category(F.col("category"), V.WORKLOAD_ALIASES).alias("category"),
        )
    )


def checkin_windows(
    rows: DataFrame,
    *,
    as_of: date,
    windows: Sequence[tuple[str, int, int]] = V.CHECKIN_WINDOWS,
    n_days: int = 6,
) -> DataFrame:
    """Check-ins per weekday, window and employee and, as rows of their own, the totals."""
    recent = rows.filter(F.col("day").isin(last_weekdays(as_of, n_days)))
    rows = explode_windows(recent, "create_date", windows)
    counts = with_totals(rows, ["day", "window"], "emp_name", {"n": F.count("*")})
    return counts.withColumn("label", X.weekday_slash(F.col("day")))


def category_trends(
    rows: DataFrame,
    *,
    as_of: date,
    n_days: int = 30,
    order: Sequence[str] = V.CHECKIN_CATEGORY_ORDER,
) -> DataFrame:
    """Check-ins per category over the last weekdays before ``as_of``, zero-filled, with the mean."""
    days = last_weekdays(as_of - timedelta(days=1), n_days)
    recent = rows.filter(F.col("day").isin(days))
    counts = recent.groupBy("category", "day").agg(F.count("*").alias("n"))
    dense = densify(day_spine(counts, ["category"], days, "day"), counts, ["category", "day"], {"n": 0})
    total = F.sum("n").over(Window.partitionBy("category"))
    return (
        dense.withColumn("mean", X.half_even(total.cast("double") / n_days, 0))
        .withColumn("category_rank", X.list_rank(F.col("category"), order))
        .withColumn("n", F.col("n").cast("bigint"))
    )


def cases_by_operator(
    audit: DataFrame,
    cases: DataFrame,
    case_products: DataFrame,
    products: DataFrame,
    *,
    as_of: date,
    days: int = 30,
    types: Sequence[str] = ("Accept Remote Case",),
    priority: Sequence[str] = V.CATEGORY_PRIORITY,
    aliases: Mapping[str, str] = V.WORKLOAD_ALIASES,
) -> DataFrame:
    """Accepted cases per user, day and category.

    Audit events of unknown cases stay with a null category. A case counts in the best category of all shipped cases with
    its number and ship date. The accepted cases are written once, so a job runs.
    """
    recent = between_days(F.col("create_date"), as_of - timedelta(days=days), as_of)
    events = audit.filter(F.col("type").isin(list(types)) & recent).select(
        "case_id", "created_by", F.to_date("create_date").alias("day")
    )
    counted = events.groupBy("case_id", "created_by", "day").agg(F.count("*").alias("events"))
    keys = ["number", "shipped"]
    is_shipped = F.col("status").isin("In Production", "Invoiced")
    shipped = F.when(is_shipped, F.to_date("ship_date")).alias("shipped")
    numbered = cases.select("case_id", case_number().alias("number"), shipped, F.lit(1).alias("known"))
    accepted = working_table(counted.join(numbered, "case_id", "left"), "accepted")
    wanted = accepted.filter("shipped IS NOT NULL").select(*keys).distinct()
    owners = numbered.drop("known").join(wanted, keys, "left_semi")
    lines = case_products.select("case_id", "product_id").join(owners, "case_id", "inner")
    best = (
        lines.join(products.select("product_id", "category"), "product_id", "inner")
        .groupBy(*keys)
        .agg(best_category(F.col("category"), priority).alias("category"))
    )
    label = F.when(F.col("shipped").isNotNull(), X.normalise_category(F.col("category"), aliases))
    return (
        accepted.join(best, keys, "left")
        .groupBy("created_by", "day", label.alias("category"))
        .agg(F.coalesce(F.sum(F.col("known") * F.col("events")), F.lit(0).cast("bigint")).alias("n"))
    )
