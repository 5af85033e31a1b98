"""Where every open case is, and which are rush or overdue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright import vocabulary as V
from casewright.functions import text as X
from casewright.functions.calendar import BusinessCalendar, wall_clock
from casewright.functions.followup import follow_up_date
from casewright.operators.joins import lookup
from casewright.operators.pick import best_category, case_number, latest_per_key, tagged_facts, with_category
from casewright.sources.tables import small_table
from casewright.sources.working import working_table

TASK_ORDER = ["complete_date", "case_product_id", "part_id", "source_id"]


def newest_first(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def latest_tasks(case_tasks: DataFrame, tie: Sequence[str] = TASK_ORDER) -> DataFrame:
    """Newest completed task of each case; open tasks count only when nothing is completed."""
    return latest_per_key(case_tasks, ["case_id"], newest_first(tie)).select(
        "case_id",
        F.col("task").alias("last_task"),
        F.col("complete_date").alias("last_scan"),
        "department",
    )


def with_location(cases: DataFrame, locations: DataFrame) -> DataFrame:
    return lookup(cases, locations, "last_location_id", "id", {"description": "location"})


CASE_COLUMNS = ["case_id", "case_number", "pan_number", "ship_date", "due_date", "status", "location", "local_delivery"]


def with_numbers_of(
    cases: DataFrame, wanted: Column, purpose: str, locations: DataFrame, columns: Sequence[str] = CASE_COLUMNS
) -> DataFrame:
    """All ``cases`` that share their number with a ``wanted`` one, with their location; written once, so a job runs."""
    located = with_location(cases, locations).withColumn("number", case_number())
    rows = located.join(located.filter(wanted).select("number").distinct(), "number", "left_semi")
    return working_table(rows.select("number", *columns), purpose)


def latest_case(picked: DataFrame, cases: DataFrame) -> DataFrame:
    """The case that holds the latest task of its number, with the task's name, time and department."""
    side = picked.withColumn("__case", F.col("done.o1"))
    return (
        cases.join(side, "number", "inner")
        .filter(F.col("case_id") == F.col("__case"))
        .withColumns({"last_task": F.col("done.task"), "last_scan": F.col("done.scan"), "department": F.col("done.department")})
        .drop("done", "__case")
    )


def exclude_pairs(
    category: Column, location: Column, excluded: str, locations: Sequence[str]
) -> Column:
    """Keep-condition: not (category is the excluded one and the location is listed)."""
    listed = F.coalesce(location.isin(list(locations)), F.lit(False))
    return ~((category == excluded) & listed)


def open_case_list(
    cases: DataFrame,
    case_tasks: DataFrame,
    locations: DataFrame,
    case_products: DataFrame,
    products: DataFrame,
    *,
    as_of: date,
    lookback_days: int = 6,
    status: str = "In Production",
    priority: Sequence[str] = V.CATEGORY_PRIORITY,
    aliases: Mapping[str, str] = V.CATEGORY_ALIASES,
    location_aliases: Mapping[str, str] = V.LOCATION_ALIASES,
    planning: Sequence[str] = V.PLANNING_LOCATIONS,
    task_tie: Sequence[str] = TASK_ORDER,
) -> DataFrame:
    """One row per open case number: the case with the latest task, and the best category of all its cases.

    Cases that share a number are one. Ship dates stay unadjusted here. A ship date counts as recent from
    ``lookback_days - 1`` days before ``as_of`` on, and is looked at after the case was picked (P12). The open cases of
    numbers with a recent one are written once; tasks and product lines then meet in one aggregate by number.
    """
    first = F.lit(as_of - timedelta(days=lookback_days - 1)).cast("timestamp_ntz")
    recent = F.col("ship_date") >= first
    shown = with_numbers_of(cases.filter(F.col("status") == status), recent, "open-cases", locations)
    facts = tagged_facts(case_tasks, case_products, task_tie).join(shown.select("case_id", "number"), "case_id", "inner")
    picked = (
        with_category(facts, products)
        .groupBy("number")
        .agg(F.max("done").alias("done"), best_category(F.col("category"), priority).alias("category"))
    )
    category = X.normalise_category(F.col("category"), aliases)
    return (
        latest_case(picked, shown)
        .filter(recent)
        .withColumn("category", category)
        .filter(exclude_pairs(F.col("category"), F.col("location"), "MARPE", planning))
        .select(
            "case_id",
            "case_number",
            "pan_number",
            F.to_date("ship_date").alias("ship_date"),
            F.to_date("due_date").alias("due_date"),
            "status",
            "category",
            X.location_label(F.col("location"), location_aliases).alias("location"),
            "last_task",
            "last_scan",
            "local_delivery",
        )
    )


def open_case_list_by_department(
    cases: DataFrame,
    case_tasks: DataFrame,
    locations: DataFrame,
    *,
    status: str = "In Production",
    task_tie: Sequence[str] = TASK_ORDER,
) -> DataFrame:
    """As ``open_case_list`` without its date limit, with the department of the last task as category."""
    located = with_location(cases.filter(F.col("status") == status), locations)
    shown = working_table(located.select(case_number().alias("number"), *CASE_COLUMNS), "open-cases")
    facts = tagged_facts(case_tasks, None, task_tie).join(shown.select("case_id", "number"), "case_id", "inner")
    picked = facts.groupBy("number").agg(F.max("done").alias("done"))
    return (
        latest_case(picked, shown)
        .select(
            "case_id",
            "case_number",
            "pan_number",
            F.to_date("ship_date").alias("ship_date"),
            "status",
            F.col("department").alias("category"),
            "location",
            "last_task",
            "last_scan",
            "local_delivery",
        )
    )


def adjust_rush_dates(
    df: DataFrame,
    calendar: BusinessCalendar,
    ship: str = "ship_date",
    pan: str = "pan_number",
    span: tuple[date, date] | None = None,
) -> DataFrame:
    """Rush cases ship on the previous business day; the others keep their date.

    ``span`` states that all dates lie in a short range, which allows the cheaper lookup.
    """
    day, rush = F.col(ship), X.is_rush(F.col(pan))
    if span:
        return df.withColumn(ship, F.when(rush, calendar.previous_within(day, *span)).otherwise(day))
    earlier = calendar.shifted(df, day, {"__earlier": -1})
    return earlier.withColumn(ship, F.when(rush, F.col("__earlier")).otherwise(day)).drop("__earlier")


def add_flags(
    df: DataFrame, as_of: date, calendar: BusinessCalendar, *, or_earlier: bool = False
) -> DataFrame:
    """Rush, leaves-today and overdue flags.

    Overdue is a ship date on exactly the previous business day, or a rush case shipping today.
    ``or_earlier`` counts every earlier ship date as well.
    """
    ship = F.col("ship_date")
    previous = F.lit(calendar.previous_day(as_of))
    late = ship < F.lit(as_of) if or_earlier else ship == previous
    today = F.coalesce(ship == F.lit(as_of), F.lit(False))
    rush = X.is_rush(F.col("pan_number"))
    return (
        df.withColumn("is_rush", rush)
        .withColumn("leaves_today", today)
        .withColumn("is_overdue", F.coalesce(late, F.lit(False)) | (rush & today))
    )


FLAGS = {"rush": "is_rush", "overdue": "is_overdue", "leaves_today": "leaves_today"}


def case_condition(
    *,
    flag: str | None = None,
    search: str | None = None,
    location: str | None = None,
    category: str | None = None,
    ship_day: str | None = None,
    ship_date: date | None = None,
    regex: bool = False,
) -> Column:
    """All the given case filters as one predicate (P10).

    The search is a literal, case-insensitive part of the case or pan number unless ``regex`` is
    set. ``ship_day`` is a month/day text and ignores the year; ``ship_date`` is exact.
    """
    keep = F.lit(True)
    if flag:
        keep = keep & F.col(FLAGS[flag])
    if search and search.strip():
        wanted = search.strip().upper()
        hits = [F.upper(F.col(c)) for c in ("case_number", "pan_number")]
        hits = [h.rlike(wanted) if regex else h.contains(wanted) for h in hits]
        in_case, in_pan = (F.coalesce(hit, F.lit(False)) for hit in hits)
        keep = keep & (in_case | in_pan)
    if location == V.NO_LOCATION:
        keep = keep & ~X.non_blank(F.col("location"))
    elif location:
        keep = keep & F.coalesce(F.col("location") == location, F.lit(False))
    if category:
        keep = keep & F.coalesce(F.col("category") == category, F.lit(False))
    if ship_day:
        keep = keep & F.coalesce(X.slash_day(F.col("ship_date")) == ship_day, F.lit(False))
    if ship_date:
        keep = keep & F.coalesce(F.col("ship_date") == F.lit(ship_date), F.lit(False))
    return keep


def filter_cases(flagged: DataFrame, **filters) -> DataFrame:
    return flagged.filter(case_condition(**filters))


def case_badges(flagged: DataFrame, badges: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Case count for each named set of filters, in one pass."""
    counts = [F.count_if(case_condition(**filters)).alias(name) for name, filters in badges.items()]
    return flagged.agg(*counts)


def airway_workflow(
    cases: DataFrame,
    case_tasks: DataFrame,
    locations: DataFrame,
    customers: DataFrame,
    calendar: BusinessCalendar,
    *,
    stages: Sequence[str],
    task_tie: Sequence[str] = TASK_ORDER,
) -> DataFrame:
    """Case numbers in the planning stages with their latest task.

    The case of a number is the one with the latest task of all that share it, open or not; location and status only
    filter afterwards. A case without any task comes last.
    """
    columns = [*CASE_COLUMNS, "customer_id", "doctor_name", "create_date"]
    in_stage = F.col("location").isin(list(stages))
    shown = with_numbers_of(cases, in_stage, "airway-cases", locations, columns)
    tasks = tagged_facts(case_tasks, None, task_tie)
    kind = tasks.schema["done"].dataType
    # A case without tasks is a row with nothing but its id.
    bare = F.struct(*[F.col("case_id").cast(f.dataType) if f.name == "o1" else F.lit(None).cast(f.dataType) for f in kind])
    own = shown.select("number", bare.cast(kind).alias("done"))
    facts = tasks.join(shown.select("case_id", "number"), "case_id", "inner").select("number", "done")
    picked = facts.unionByName(own).groupBy("number").agg(F.max("done").alias("done"))
    named = latest_case(picked, shown).filter(in_stage)
    rows = named.join(customers.select("customer_id", "practice_name"), "customer_id", "left").select(
        "customer_id",
        "doctor_name",
        "practice_name",
        "location",
        F.to_date("ship_date").alias("ship_date"),
        "case_number",
        "pan_number",
        F.to_date("create_date").alias("create_date"),
        "status",
        "last_task",
        "last_scan",
    )
    return adjust_rush_dates(rows, calendar)


def filter_airway(
    df: DataFrame,
    *,
    statuses: Sequence[str] = ("In Production", "On Hold"),
    location: str | None = None,
    ship_date: str | None = None,
) -> DataFrame:
    """Airway list by status, location and ISO ship date; a text that is no date filters nothing (P20)."""
    df = df.filter(F.col("status").isin(list(statuses)))
    if location:
        df = df.filter(F.col("location") == location)
    if ship_date:
        try:
            df = df.filter(F.col("ship_date") == F.lit(date.fromisoformat(ship_date)))
        except ValueError:
            pass
    return df


def location_bucket(location: Column) -> Column:
    """Null and blank locations in one bucket."""
    return F.when(X.non_blank(location), location).otherwise(F.lit(V.NO_LOCATION))


def location_summary(df: DataFrame, order: Sequence[str] = V.LOCATION_ORDER) -> DataFrame:
    """Cases per location and category with total, display rank, share and load tier.

    The window runs over aggregated counts only: one row per location and category.
    """
    counts = df.groupBy(location_bucket(F.col("location")).alias("location"), "category").agg(
        F.count("*").alias("n")
    )
    total = F.sum("n").over(Window.partitionBy("location"))
    rank = F.when(F.col("location") == V.NO_LOCATION, len(order) + 2).otherwise(
        X.list_rank(F.col("location"), order)
    )
    return (
        counts.withColumn("location_total", total)
        .withColumn("location_rank", rank.cast("bigint"))
        .withColumn("degrees", F.col("n") * 360.0 / F.col("location_total"))
        .withColumn("load_tier", X.load_tier(F.col("location_total")))
    )


def location_cards(summary: DataFrame) -> DataFrame:
    """Nested form of ``location_summary``: one row per location with a category -> count map."""
    entries = F.sort_array(F.collect_list(F.struct("category", "n")))
    return (
        summary.groupBy("location", "location_rank", "location_total", "load_tier")
        .agg(F.map_from_entries(entries).alias("categories"))
        .orderBy("location_rank", "location")
    )


def stage_summary(
    df: DataFrame, groups: Mapping[str, Sequence[str]] = V.STAGE_GROUPS, first_dates: int = 6
) -> DataFrame:
    """Per planning stage: total, its first ship dates with counts, number of further dates.

    Every stage appears, also without cases (one row with null date).
    """
    pairs = [(group, stage) for group, stages in groups.items() for stage in stages]
    spine = small_table(
        df.sparkSession, stage_group=[g for g, _ in pairs], location=[stage for _, stage in pairs]
    )
    wanted = df.filter(F.col("location").isin([stage for _, stage in pairs]))
    by_date = wanted.groupBy("location", "ship_date").agg(F.count("*").alias("n"))
    # One row per stage and date is left here, so a stage's window spans the calendar at most.
    stage = Window.partitionBy("location")
    position = F.row_number().over(stage.orderBy(F.col("ship_date").asc_nulls_last()))
    dated = F.col("ship_date").isNotNull()
    zero = F.lit(0).cast("bigint")
    ranked = (
        by_date.withColumn("total", F.sum("n").over(stage))
        .withColumn("dates", F.count("ship_date").over(stage))
        .withColumn("position", position)
        .filter((F.col("position") <= first_dates) & (dated | (F.col("position") == 1)))
        .withColumn("date_rank", F.when(dated, F.col("position")).otherwise(0).cast("bigint"))
        .withColumn("n", F.when(dated, F.col("n")))
    )
    return spine.join(ranked, "location", "left").select(
        "stage_group",
        "location",
        F.coalesce("total", zero).alias("total"),
        F.greatest(F.coalesce("dates", zero) - first_dates, zero).alias("extra_dates"),
        F.coalesce("date_rank", zero).alias("date_rank"),
        "ship_date",
        F.coalesce("n", zero).alias("n"),
    )


def local_delivery(df: DataFrame, day: date | None = None) -> DataFrame:
    """Locally delivered cases, optionally of one ship day."""
    df = df.filter(F.coalesce("local_delivery", F.lit(False)))
    return df.filter(F.col("ship_date") == F.lit(day)) if day else df


def overdue_no_scan(
    flagged: DataFrame,
    now: datetime,
    *,
    hours: int = 4,
    planning: Sequence[str] = V.PLANNING_LOCATIONS,
    skip: Sequence[str] = ("QC",),
) -> DataFrame:
    """Overdue cases without a scan in the last hours, outside QC and planning."""
    limit = wall_clock(now - timedelta(hours=hours))
    listed = F.coalesce(F.col("location").isin(list(planning) + list(skip)), F.lit(False))
    return flagged.filter(
        F.col("is_overdue") & ~listed & F.coalesce(F.col("last_scan") < limit, F.lit(True))
    )


def submitted_cases(cases: DataFrame, locations: DataFrame, calendar: BusinessCalendar) -> DataFrame:
    """Live submitted cases by rush-adjusted ship date."""
    live = cases.filter((F.col("status") == "Submitted") & ~F.coalesce("deleted", F.lit(False)))
    rows = with_location(live, locations).select(
        "case_number",
        "pan_number",
        F.to_date("ship_date").alias("ship_date"),
        "status",
        "location",
    )
    return adjust_rush_dates(rows, calendar).orderBy("ship_date", "case_number")


def hold_list(
    cases: DataFrame,
    customers: DataFrame,
    calendar: BusinessCalendar,
    *,
    as_of: date,
    statuses: Sequence[str] = V.HOLD_STATUSES,
    pan_prefix: str = "7",
) -> DataFrame:
    """Cases on hold with marker type and mined follow-up date, typed and oldest first."""
    held = cases.filter(
        (F.col("status") == "On Hold")
        & F.trim("pan_number").like(f"{pan_prefix}%")
        & F.col("hold_status").isin(list(statuses))
    )
    rows = held.join(customers.select("customer_id", "practice_name"), "customer_id", "left").select(
        "case_number",
        "pan_number",
        "doctor_name",
        "practice_name",
        X.full_name(F.col("patient_first"), F.col("patient_last")).alias("patient_name"),
        F.to_date("create_date").alias("create_date"),
        F.to_date("ship_date").alias("ship_date"),
        F.to_date("hold_date").alias("hold_date"),
        "hold_status",
        "hold_reason",
        X.hold_marker(F.col("hold_reason")).alias("follow_up_type"),
        follow_up_date(F.col("hold_reason"), F.lit(as_of)).alias("follow_up_date"),
    )
    return adjust_rush_dates(rows, calendar).orderBy(
        F.col("follow_up_type").isNull(), F.col("follow_up_date").asc_nulls_last(), "case_number"
    )


def filter_in(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Multi-select filter; no selection keeps everything."""
    return df.filter(F.col(col).isin(list(values))) if values else df


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    """Row count per value."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def count_in(location: Column, wanted: Sequence[str]) -> Column:
    return F.count_if(F.coalesce(location.isin(list(wanted)), F.lit(False)))

