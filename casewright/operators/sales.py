"""Revenue per day, month and year, with trends and goals.

Every window below runs over a series whose length is bounded by the report (days or months of the
window), optionally per ``partition_cols``; the facts are aggregated before.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.functions.calendar import BusinessCalendar
from casewright.operators.pick import of_cases
from casewright.sources.tables import between_days

UNPRODUCED = ("Cancelled", "Submitted", "Sent for TryIn")
MONEY = "decimal(38,2)"


def _invoiced(cases: DataFrame) -> DataFrame:
    """Live, regular, non-adjustment cases."""
    return cases.filter(
        ~F.coalesce("deleted", F.lit(False))
        & (F.col("type") == "D")
        & ~F.coalesce("is_adjustment", F.lit(False))
    )


def _amount() -> Column:
    return F.col("taxable_amount") + F.col("non_taxable_amount")


def daily_invoices(cases: DataFrame, *, as_of: date, days: int = 35) -> DataFrame:
    """Invoices per day and lab."""
    none = F.lit(0).cast(MONEY)
    rows = _invoiced(cases).filter(
        between_days(F.col("invoice_date"), as_of - timedelta(days=days), as_of)
    )
    return rows.groupBy(F.to_date("invoice_date").alias("sales_date"), "lab_name").agg(
        F.lit("I").alias("type"),
        F.count("case_id").alias("n"),
        F.sum(_amount()).cast(MONEY).alias("subtotal"),
        F.sum("sales_discount").cast(MONEY).alias("discount"),
        F.sum("remake_discount").cast(MONEY).alias("remake_discount"),
        F.sum("total_tax").cast(MONEY).alias("tax"),
        F.max(none).alias("new_units"),
        F.max(none).alias("remake_units"),
    )


def daily_production(
    cases: DataFrame, case_products: DataFrame, products: DataFrame, *, as_of: date, days: int = 35
) -> DataFrame:
    """Received production per day and lab, new work and remakes apart.

    The product lines are summed per case before they meet the cases, so a case with very many
    lines reaches the join as one row.
    """
    is_new = F.coalesce(F.trim("remake"), F.lit("")) == ""
    units = F.col("quantity") * F.col("unit_value")
    zero = F.lit(0)
    received = cases.filter(
        (F.col("type") == "D")
        & ~F.coalesce("deleted", F.lit(False))
        & ~F.col("status").isin(*UNPRODUCED)
        & between_days(F.col("date_in"), as_of - timedelta(days=days), as_of)
    ).select("case_id", "lab_name", F.to_date("date_in").alias("sales_date"))
    per_case = (
        of_cases(case_products, received)
        .join(products.select("product_id", "unit_value"), "product_id", "left")
        .groupBy("case_id")
        .agg(
            F.sum(F.when(is_new, F.col("extended_amount")).otherwise(zero)).alias("subtotal"),
            F.sum("sales_discount").alias("discount"),
            F.sum("remake_discount").alias("line_remake_discount"),
            F.sum(F.when(is_new, units).otherwise(zero)).alias("new_units"),
            F.sum(F.when(~is_new, units).otherwise(zero)).alias("remake_units"),
        )
    )
    return (
        received.join(per_case, "case_id", "inner")
        .groupBy("sales_date", "lab_name")
        .agg(
            F.lit("S").alias("type"),
            F.count("case_id").alias("n"),
            F.sum("subtotal").cast(MONEY).alias("subtotal"),
            F.sum("discount").cast(MONEY).alias("discount"),
            F.sum("line_remake_discount").cast(MONEY).alias("remake_discount"),
            F.max(F.lit(0).cast(MONEY)).alias("tax"),
            F.sum("new_units").cast(MONEY).alias("new_units"),
            F.sum("remake_units").cast(MONEY).alias("remake_units"),
        )
    )


def daily_sales(
    cases: DataFrame, case_products: DataFrame, products: DataFrame, *, as_of: date, days: int = 35
) -> DataFrame:
    """Invoice and production rows of the last days in one table."""
    return (
        daily_invoices(cases, as_of=as_of, days=days)
        .unionByName(daily_production(cases, case_products, products, as_of=as_of, days=days))
        .orderBy(F.col("sales_date").desc(), "type", "lab_name")
    )


def months_back(as_of: date, months: int) -> date:
    index = as_of.year * 12 + as_of.month - 1 - months
    return date(index // 12, index % 12 + 1, 1)


def monthly_sales(cases: DataFrame, *, as_of: date, months: int = 19) -> DataFrame:
    """Invoice count and revenue per month, the current month and ``months`` before it."""
    last = months_back(as_of, -1) - timedelta(days=1)
    rows = _invoiced(cases).filter(between_days(F.col("invoice_date"), months_back(as_of, months), last))
    return rows.groupBy(
        F.year("invoice_date").alias("sales_year"), F.month("invoice_date").alias("sales_month")
    ).agg(F.count("case_id").alias("n"), F.sum(_amount()).cast(MONEY).alias("subtotal"))


def revenue_by_day(cases: DataFrame, *, as_of: date, days: int = 365) -> DataFrame:
    """Revenue per invoice day, cancelled and unproduced cases excluded (A10)."""
    rows = cases.filter(
        ~F.col("status").isin(*UNPRODUCED)
        & ~F.coalesce("deleted", F.lit(False))
        & (F.col("type") == "D")
        & between_days(F.col("invoice_date"), as_of - timedelta(days=days), as_of)
    )
    return rows.groupBy(F.to_date("invoice_date").alias("invoice_date")).agg(
        F.sum(_amount()).cast(MONEY).alias("revenue")
    )


def moving_avg(
    df: DataFrame, order: str, value: str, n: int, partition_cols: Sequence[str] = (), *, before: bool = False
) -> Column:
    """Mean of the last n rows, null until there are n; ``before`` leaves the current row out."""
    window = Window.partitionBy(*partition_cols).orderBy(order)
    frame = window.rowsBetween(-n, -1) if before else window.rowsBetween(1 - n, 0)
    total = F.sum(F.col(value)).over(frame).cast("double")
    return F.when(F.count(F.col(value)).over(frame) == n, total / n)


def monthly_trend(
    monthly: DataFrame, *, as_of: date, months: int = 18, partition_cols: Sequence[str] = ()
) -> DataFrame:
    """Last months with a 3-month average.

    Months without sales count as zero, so the average spans calendar months. The current, partial
    month shows the mean of the three complete months before it.
    """
    current = months_back(as_of, 0)
    first = months_back(as_of, months)
    spine = F.explode(
        F.sequence(F.lit(first), F.lit(current), F.expr("INTERVAL 1 MONTH"))
    ).alias("month")
    keys = monthly.select(*partition_cols).distinct() if partition_cols else monthly.sparkSession.range(1)
    facts = monthly.select(
        *partition_cols, F.make_date("sales_year", "sales_month", F.lit(1)).alias("month"), "subtotal"
    )
    series = (
        keys.select(*partition_cols, spine)
        .join(facts, [*partition_cols, "month"], "left")
        .withColumn("subtotal", F.coalesce("subtotal", F.lit(0).cast(MONEY)))
    )
    is_current = F.col("month") == F.lit(current)
    trailing = moving_avg(series, "month", "subtotal", 3, partition_cols)
    complete = moving_avg(series, "month", "subtotal", 3, partition_cols, before=True)
    return (
        series.withColumn("trend", F.when(is_current, complete).otherwise(trailing))
        .withColumn("is_current", is_current)
        .withColumn("label", X.month_apostrophe_year(F.col("month")))
        .filter(F.col("month") > F.lit(first))
    )


def daily_trend(invoices: DataFrame, *, as_of: date, days: int = 30, weekdays: int = 5) -> DataFrame:
    """Dense daily series with the mean of the last weekdays' values.

    Weekend rows carry the mean of the weekdays before them. Today's partial value is left out of
    its own mean.
    """
    first = as_of - timedelta(days=days - 1)
    facts = invoices.groupBy("sales_date").agg(F.sum("subtotal").cast(MONEY).alias("subtotal"))
    spine = invoices.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(as_of), F.expr("INTERVAL 1 DAY"))).alias("sales_date")
    )
    dense = spine.join(facts, "sales_date", "left").withColumn(
        "subtotal", F.coalesce("subtotal", F.lit(0).cast(MONEY))
    )
    is_weekday = F.weekday("sales_date") < 5
    dense = dense.withColumn("is_weekday", is_weekday)
    own = moving_avg(dense, "sales_date", "subtotal", weekdays, ["is_weekday"])
    before = moving_avg(dense, "sales_date", "subtotal", weekdays, ["is_weekday"], before=True)
    today = F.col("sales_date") == F.lit(as_of)
    carried = F.last("weekday_trend", ignorenulls=True).over(
        Window.orderBy("sales_date").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        dense.withColumn("own", F.when(F.col("is_weekday"), own))
        .withColumn("before", F.when(F.col("is_weekday"), before))
        .withColumn(
            "weekday_trend", F.when(today & F.col("is_weekday"), F.col("before")).otherwise(F.col("own"))
        )
        .withColumn("trend", carried)
        .select(
            "sales_date",
            "subtotal",
            "trend",
            today.alias("is_today"),
            X.day_month_year(F.col("sales_date")).alias("label"),
        )
    )


def sales_history(
    daily: DataFrame, calendar: BusinessCalendar, *, days: int = 5
) -> DataFrame:
    """Invoices of the last business days that have any, summed over labs, oldest first."""
    return (
        daily.filter(F.col("type") == "I")
        .groupBy("sales_date")
        .agg(F.sum("n").alias("n"), F.sum("subtotal").cast(MONEY).alias("subtotal"))
        .filter(calendar.is_business(F.col("sales_date")))
        .orderBy(F.col("sales_date").desc())
        .limit(days)
        .withColumn("label", X.weekday_month_day(F.col("sales_date")))
        .orderBy("sales_date")
    )


def _against_goal(df: DataFrame) -> DataFrame:
    ratio = F.col("actual").cast("double") / F.col("goal").cast("double") * 100
    return df.withColumn("pct", F.when(F.col("goal") > 0, ratio)).withColumn(
        "goal_band", X.goal_band(F.col("pct"))
    )


def monthly_goals(monthly: DataFrame, goals: DataFrame, *, as_of: date) -> DataFrame:
    """Twelve months of the current year against their goals; future months stay empty."""
    spine = monthly.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    actual = monthly.filter(F.col("sales_year") == as_of.year).select(
        F.col("sales_month").alias("month"), F.col("subtotal").alias("actual")
    )
    goal = goals.filter(F.col("year") == as_of.year).select("month", F.col("revenue_goal").alias("goal"))
    row = spine.join(actual, "month", "left").join(goal, "month", "left")
    reached = F.when(F.col("month") <= as_of.month, F.col("actual"))
    return _against_goal(
        row.withColumn("actual", reached).withColumn("goal", F.coalesce("goal", F.lit(0).cast(MONEY)))
    )


def annual_goals(cases: DataFrame, goals: DataFrame, *, as_of: date, years: int = 5) -> DataFrame:
    """Revenue of the last years against the sum of their monthly goals."""
    first = as_of.year - years + 1
    zero = F.lit(0).cast(MONEY)
    rows = _invoiced(cases).filter(
        between_days(F.col("invoice_date"), date(first, 1, 1), date(as_of.year, 12, 31))
    )
    actual = rows.groupBy(F.year("invoice_date").alias("year")).agg(
        F.sum(_amount()).cast(MONEY).alias("actual")
    )
    goal = goals.groupBy("year").agg(F.sum("revenue_goal").cast(MONEY).alias("goal"))
    spine = cases.sparkSession.range(first, as_of.year + 1).select(F.col("id").cast("int").alias("year"))
    label = F.when(F.col("year") == as_of.year, F.concat(F.col("year").cast("string"), F.lit(" (YTD)")))
    return _against_goal(
        spine.join(actual, "year", "left")
        .join(goal, "year", "left")
        .withColumn("actual", F.coalesce("actual", zero))
        .withColumn("goal", F.coalesce("goal", zero))
        .withColumn("label", F.coalesce(label, F.col("year").cast("string")))
    )
