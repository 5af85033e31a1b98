"""Past-due accounts, their open cases and report sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators.joins import attach_counts

BUCKETS = ["past_due_30", "past_due_60", "past_due_90", "past_due_over_90"]
MONEY = "decimal(18,2)"
GENERAL, SMALL, NAMED = "general", "small", "named group"
REPORT_COLUMNS = [
    "practice_name",
    "dental_group",
    "full_name",
    "sales_person",
    "office_phone",
    "bill_email",
    "last_payment_date",
    "last_payment_amount",
    "current_balance",
    "past_due_60",
    "past_due_90",
    "past_due_over_90",
    "total_past_due",
    "total_balance",
    "account_flag",
    "open_cases",
]


def _money(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast(MONEY)


def past_due_accounts(
    customers: DataFrame, *, excluded_group: str | None = None, lab: str | None = None
) -> DataFrame:
    """Live accounts with a balance past 90 days; each missing bucket counts as zero."""
    rows = customers.filter(~F.coalesce("deleted", F.lit(False)))
    for name in BUCKETS:
        rows = rows.withColumn(name, _money(name))
    rows = rows.filter(F.col("past_due_90") + F.col("past_due_over_90") > 0)
    if excluded_group:
        rows = rows.filter(F.coalesce("dental_group", F.lit("")) != excluded_group)
    if lab:
        rows = rows.filter(F.col("lab_name") == lab)
    total = sum((F.col(b) for b in BUCKETS[1:]), F.col(BUCKETS[0]))
    return rows.select(
        "lab_name",
        "customer_id",
        "practice_name",
        "dental_group",
        X.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        "sales_person",
        "office_phone",
        "bill_email",
        F.to_date("last_payment_date").alias("last_payment_date"),
        _money("last_payment_amount").alias("last_payment_amount"),
        (_money("unapplied_payments") + _money("unapplied_credits")).cast(MONEY).alias("unapplied"),
        _money("this_period_charges").alias("this_period"),
        _money("current_balance").alias("current_balance"),
        *BUCKETS,
        total.cast(MONEY).alias("total_past_due"),
        _money("total_balance").alias("total_balance"),
        X.account_flag(
            F.col("is_on_cod"), F.col("on_credit_hold"), F.col("in_collection")
        ).alias("account_flag"),
    )


def open_cases_of(cases: DataFrame, accounts: DataFrame, *, lab: str | None = None) -> DataFrame:
    """Open and held cases of the given accounts."""
    rows = cases.filter(
        F.col("status").isin("In Production", "On Hold") & ~F.coalesce("deleted", F.lit(False))
    )
    if lab:
        rows = rows.filter(F.col("lab_name") == lab)
    return rows.join(accounts.select("customer_id"), "customer_id", "left_semi").select(
        "customer_id",
        "case_id",
        "case_number",
        "patient_first",
        "patient_last",
        "status",
        F.to_date("due_date").alias("due_date"),
        F.to_date("date_in").alias("date_entered"),
    )


def sections(
    accounts: DataFrame, open_cases: DataFrame, *, named_group: str, large: int = 500
) -> DataFrame:
    """Accounts with open and held case counts and their report section."""
    over = F.col("past_due_90") + F.col("past_due_over_90")
    section = (
        F.when(F.coalesce("dental_group", F.lit("")) == named_group, F.lit(NAMED))
        .when(over >= large, F.lit(GENERAL))
        .otherwise(F.lit(SMALL))
    )
    rows = attach_counts(
        accounts, open_cases.filter(F.col("status") == "In Production"), "customer_id", "open_cases"
    )
    rows = attach_counts(rows, open_cases.filter(F.col("status") == "On Hold"), "customer_id", "on_hold")
    return rows.withColumn("section", section)


def section_stats(sectioned: DataFrame) -> DataFrame:
    """Count and sums per section and overall."""
    sums = [F.sum(c).alias(c) for c in (*BUCKETS, "total_past_due", "total_balance")]
    rows = sectioned.rollup("section").agg(
        F.count("*").alias("n"), *sums, F.grouping_id().alias("level")
    )
    return (
        rows.withColumn("section", F.when(F.col("level") == 1, "overall").otherwise(F.col("section")))
        .withColumn("total_text", X.compact_currency(F.col("total_past_due")))
        .drop("level")
    )


def cases_by_customer(open_cases: DataFrame, page_size: int = 200) -> DataFrame:
    """Cases nested per customer in pages of about ``page_size``.

    The number of pages follows from the customer's case count, and the case id decides the page,
    so a customer with very many cases spreads over many small arrays instead of one large one.
    """
    counts = open_cases.groupBy("customer_id").agg(F.count("*").alias("total"))
    pages = F.ceil(F.col("total") / page_size).cast("bigint")
    entry = F.struct(*[c for c in open_cases.columns if c != "customer_id"])
    return (
        open_cases.join(counts, "customer_id")
        .withColumn("pages", pages)
        .withColumn("page", F.pmod(F.xxhash64("case_id"), F.col("pages")))
        .groupBy("customer_id", "total", "pages", "page")
        .agg(F.sort_array(F.collect_list(entry)).alias("cases"))
    )


def report(sectioned: DataFrame, columns: Sequence[str] = REPORT_COLUMNS) -> DataFrame:
    """Report rows in column order, one section each, largest debt first."""
    return sectioned.select("section", *columns).orderBy(
        "section", F.col("total_past_due").desc(), "practice_name"
    )


def report_summary(sectioned: DataFrame) -> DataFrame:
    """One row: accounts, open cases, 90-day and over-90 totals."""
    return sectioned.agg(
        F.count("*").alias("accounts"),
        F.coalesce(F.sum("open_cases"), F.lit(0).cast("bigint")).alias("open_cases"),
        F.sum("past_due_90").alias("past_due_90"),
        F.sum("past_due_over_90").alias("past_due_over_90"),
    )
