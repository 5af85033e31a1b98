"""Workload and invoicing pace per ship date and category."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import vocabulary as V
from casewright.functions import text as X
from casewright.functions.calendar import BusinessCalendar
from casewright.operators.cases import adjust_rush_dates, count_in, with_location
from casewright.operators.joins import day_spine, densify
from casewright.operators.pick import of_cases, product_categories
from casewright.sources.tables import between_days, small_table
from casewright.sources.working import working_table

STATUSES = ("In Production", "Invoiced")
TOTAL = "TOTAL"


def window_days(as_of: date, calendar: BusinessCalendar, days: int = 6) -> list[date]:
    """Dates from the previous business day to ``days`` calendar days after it."""
    first = calendar.previous_day(as_of)
    return [first + timedelta(days=n) for n in range(days + 1)]


def business_window(df: DataFrame, col: str, days: Sequence[date]) -> DataFrame:
    return df.filter(F.col(col).between(F.lit(days[0]), F.lit(days[-1])))


def _span(days: Sequence[date], calendar: BusinessCalendar) -> tuple[date, date]:
    """Raw ship dates that can fall into the window once rush dates are pulled back."""
    return days[0], days[-1] + timedelta(days=calendar.longest_closure + 1)


def _source_window(cases: DataFrame, days: Sequence[date], calendar: BusinessCalendar) -> DataFrame:
    """Cases of the window, cut on the raw ship date so that the filter reaches the scan."""
    first, last = _span(days, calendar)
    return cases.filter(
        F.col("status").isin(*STATUSES) & between_days(F.col("ship_date"), first, last)
    )


def workload_status(
    cases: DataFrame, calendar: BusinessCalendar, *, as_of: date, days: int = 6
) -> DataFrame:
    """Case count by status and rush-adjusted ship date."""
    window = window_days(as_of, calendar, days)
    rows = _source_window(cases, window, calendar).select(
        "status", "pan_number", F.to_date("ship_date").alias("ship_date")
    )
    rows = adjust_rush_dates(rows, calendar, span=_span(window, calendar))
    rows = business_window(rows, "ship_date", window)
    return rows.groupBy("status", "ship_date").agg(F.count("*").alias("n"))


def workload_detail(
    cases: DataFrame,
    case_products: DataFrame,
    products: DataFrame,
    locations: DataFrame,
    calendar: BusinessCalendar,
    *,
    as_of: date,
    days: int = 6,
    priority: Sequence[str] = V.WORKLOAD_PRIORITY,
    aliases: Mapping[str, str] = V.WORKLOAD_ALIASES,
    excluded_category: str = "Airway",
    include_uncategorised: bool = False,
) -> DataFrame:
    """One row per case number and ship date in the window, with the priority category (W04, U01, A02 detail).

    Of cases that share number and date the one that owns the best line is shown, of several the largest id. A case
    without any product counts as Other, on its own. One that owns only excluded or uncategorised products is left out,
    unless ``include_uncategorised`` is set. All follows from two aggregates: per case, and per number and date.
    """
    window = window_days(as_of, calendar, days)
    category = F.col("category")
    eligible = category.isNotNull() & (category != excluded_category)
    best = F.struct((-X.priority_rank(category, priority)).alias("rank"), category.alias("category"))
    shown = _source_window(cases, window, calendar)
    owned = (
        product_categories(of_cases(case_products, shown), products)
        .groupBy("case_id")
        .agg(F.max(F.when(eligible, best)).alias("best"), F.lit(True).alias("owns"))
    )
    rows = shown.join(owned, "case_id", "left")
    if not include_uncategorised:
        rows = rows.filter(F.col("best").isNotNull() | F.col("owns").isNull())
    carried = ["pan_number", "status", "local_delivery", "last_location_id", "due_date"]
    top = F.max(F.struct("best", "case_id", *carried)).alias("top")
    # Cases without products, or without a number, are groups of their own.
    alone = F.when(F.col("owns").isNull() | F.col("case_number").isNull(), F.col("case_id"))
    rows = rows.groupBy("case_number", F.to_date("ship_date").alias("ship_date"), alone.alias("alone")).agg(top)
    rows = with_location(rows.select("case_number", "ship_date", "top.*"), locations).select(
        "case_id",
        "case_number",
        "pan_number",
        "status",
        "local_delivery",
        "location",
        "ship_date",
        F.col("ship_date").alias("orig_ship_date"),
        F.to_date("due_date").alias("due_date"),
        F.col("best.category").alias("category"),
    )
    rows = adjust_rush_dates(rows, calendar, span=_span(window, calendar))
    rows = business_window(rows, "ship_date", window)
    return rows.withColumn("category", X.normalise_category(category, aliases))


def without_products(cases: DataFrame, case_products: DataFrame, products: DataFrame) -> DataFrame:
    """Cases that own no catalogued product."""
    owned = case_products.select("case_id", "product_id").join(
        products.select("product_id"), "product_id", "left_semi"
    )
    return cases.join(owned, "case_id", "left_anti")


def workload_pivot(detail: DataFrame, order: Sequence[str] = V.WORKLOAD_CATEGORY_ORDER) -> DataFrame:
    """Case count by category, status and ship date, newest date first."""
    return (
        detail.groupBy("category", "status", "ship_date")
        .agg(F.count("*").alias("n"))
        .withColumn("category_rank", X.list_rank(F.col("category"), order))
        .orderBy(F.col("ship_date").desc(), "category_rank", "category", "status")
    )


def pace_columns(df: DataFrame) -> DataFrame:
    """Invoiced share of the total, rounded half to even, and its tier."""
    total = F.col("invoiced") + F.col("in_production")
    pct = X.half_even(F.coalesce(F.try_divide(F.col("invoiced") * 100.0, total), F.lit(0.0)), 1)
    return (
        df.withColumn("total", total)
        .withColumn("pct", pct)
        .withColumn("tier", X.pace_tier(F.col("pct")))
        .withColumn("label", X.weekday_month_day(F.col("ship_date")))
    )


def _by_status(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Invoiced and in-production sums side by side."""
    zero = F.lit(0).cast("bigint")

    def total(status: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status") == status, F.col(measure))), zero)

    return df.groupBy(*keys).agg(
        total("Invoiced").alias("invoiced"), total("In Production").alias("in_production")
    )


def workload_chart(status_counts: DataFrame) -> DataFrame:
    """Stacked series per date."""
    return _by_status(status_counts, ["ship_date"], "n").withColumn(
        "label", X.weekday_month_day(F.col("ship_date"))
    )


def workload_pace(status_counts: DataFrame, first_dates: int = 6) -> DataFrame:
    """Pace of the first dates."""
    pace = pace_columns(_by_status(status_counts, ["ship_date"], "n"))
    return pace.orderBy("ship_date").limit(first_dates)


def category_pace(
    pivot: DataFrame,
    window: Sequence[date],
    first_dates: int = 6,
    order: Sequence[str] = V.WORKLOAD_CATEGORY_ORDER,
) -> DataFrame:
    """Pace of every category on each of the first dates, zero where it has no case."""
    zero = F.lit(0).cast("bigint")
    # One row per category and date, used three times: computed once, without its lineage from here on.
    measured = working_table(_by_status(pivot, ["category", "ship_date"], "n"), "pace")
    dates = measured.select("ship_date").distinct().orderBy("ship_date").limit(first_dates)
    grid = day_spine(measured, ["category"], window, "ship_date").join(dates, "ship_date", "left_semi")
    filled = densify(
        grid, measured, ["category", "ship_date"], {"invoiced": 0, "in_production": 0}
    )
    filled = filled.withColumn("invoiced", F.col("invoiced") + zero).withColumn(
        "in_production", F.col("in_production") + zero
    )
    return pace_columns(filled).withColumn("category_rank", X.list_rank(F.col("category"), order))


def workload_matrix(
    pivot: DataFrame, window: Sequence[date], order: Sequence[str] = V.WORKLOAD_CATEGORY_ORDER
) -> DataFrame:
    """In-production counts, one row per category and one column per window date, plus totals."""
    measures = [
        F.coalesce(
            F.sum(F.when(F.col("ship_date") == F.lit(day), F.col("n"))), F.lit(0).cast("bigint")
        ).alias(f"day_{k:02d}")
        for k, day in enumerate(window)
    ]
    rows = pivot.filter(F.col("status") == "In Production").rollup("category").agg(
        *measures, F.grouping_id().alias("level")
    )
    return (
        rows.withColumn("category", F.when(F.col("level") == 1, TOTAL).otherwise(F.col("category")))
        .withColumn(
            "category_rank",
            F.when(F.col("level") == 1, len(order) + 2)
            .otherwise(X.list_rank(F.col("category"), order))
            .cast("bigint"),
        )
        .drop("level")
    )


def pivot_margins(detail: DataFrame, window: Sequence[date]) -> DataFrame:
    """Category by date counts with row and column totals."""
    cells = detail.cube("category", "ship_date").agg(
        F.count("*").alias("n"),
        F.grouping("category").alias("all_categories"),
        F.grouping("ship_date").alias("all_dates"),
    )
    name = F.when(F.col("all_categories") == 1, TOTAL).otherwise(F.col("category"))
    column = F.when(F.col("all_dates") == 1, TOTAL).otherwise(F.col("ship_date").cast("string"))
    wanted = [d.isoformat() for d in window] + [TOTAL]
    table = (
        cells.select(name.alias("category"), column.alias("column"), "n")
        .groupBy("category")
        .pivot("column", wanted)
        .agg(F.sum("n"))
        .na.fill(0)
    )
    names = [f"day_{k:02d}" for k in range(len(window))] + ["total"]
    return table.select("category", *[F.col(f"`{w}`").alias(n) for w, n in zip(wanted, names)])


def workload_summary(
    status_counts: DataFrame, submitted: DataFrame, located: DataFrame
) -> DataFrame:
    """Tiles: totals, overall pace, submitted count, counts of three location groups."""
    parts = [
        _by_status(status_counts, [], "n"),
        submitted.agg(F.count("*").alias("submitted")),
        located.agg(
            count_in(F.col("location"), V.DESIGN_LOCATIONS).alias("design"),
            count_in(F.col("location"), V.MANUFACTURING_LOCATIONS).alias("manufacturing"),
            count_in(F.col("location"), V.FLOOR_LOCATIONS).alias("production_floor"),
        ),
    ]
    names = [name for part in parts for name in part.columns]
    # Three rows of one part each, folded into one row.
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    row = stacked.agg(*[F.max(name).alias(name) for name in names])
    total = F.col("invoiced") + F.col("in_production")
    pct = F.coalesce(F.try_divide(F.col("invoiced") * 100.0, total), F.lit(0.0))
    return row.withColumn("pace_pct", X.half_even(pct, 0))


def workload_by_category(
    cases: DataFrame, case_products: DataFrame, products: DataFrame, status: str = "In Production"
) -> DataFrame:
    """Distinct cases by category and ship date; a case counts once in each category it owns."""
    open_cases = cases.filter((F.col("status") == status) & F.col("ship_date").isNotNull()).select(
        "case_id", "case_number", F.to_date("ship_date").alias("ship_date")
    )
    named = products.filter("category IS NOT NULL").select("product_id", "category")
    return (
        open_cases.join(case_products.select("case_id", "product_id"), "case_id", "inner")
        .join(named, "product_id", "inner")
        .groupBy("category", "ship_date")
        .agg(F.count_distinct("case_number").alias("n"))
    )


def gemba_grid(
    df: DataFrame,
    locations: Sequence[str],
    calendar: BusinessCalendar,
    *,
    as_of: date,
    categories: Sequence[str] = V.WORKLOAD_CATEGORY_ORDER,
) -> DataFrame:
    """Per location and date (previous, this and the next two business days): cases by category and rush."""
    days = [
        calendar.previous_day(as_of),
        as_of,
        calendar.next_day(as_of, 1),
        calendar.next_day(as_of, 2),
    ]
    cells = [(loc, day, k) for loc in locations for k, day in enumerate(days)]
    spine = small_table(
        df.sparkSession,
        location=[loc for loc, _, _ in cells],
        ship_date=[day for _, day, _ in cells],
        day_rank=[k for _, _, k in cells],
    )
    measures = [F.count("*").alias("total"), F.count_if(X.is_rush(F.col("pan_number"))).alias("rush")]
    names = ["total", "rush"]
    for k, category in enumerate(categories, 1):
        names.append(f"category_{k}")
        measures.append(F.count_if(F.col("category") == category).alias(names[-1]))
    wanted = df.filter(F.col("location").isin(list(locations)) & F.col("ship_date").isin(days))
    counts = wanted.groupBy("location", "ship_date").agg(*measures)
    return densify(spine, counts, ["location", "ship_date"], dict.fromkeys(names, 0))


def pace_cases(detail: DataFrame, day: date, category: str | None = None) -> DataFrame:
    """In-production cases behind one pace tile, with their original ship date."""
    rows = detail.filter((F.col("status") == "In Production") & (F.col("ship_date") == F.lit(day)))
    if category:
        rows = rows.filter(F.col("category") == category)
    return rows.orderBy("ship_date", "category", "case_number")
