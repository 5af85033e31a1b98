"""Column functions over texts, flags, labels and numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright import vocabulary as V


def non_blank(col: Column) -> Column:
    """True when the text holds something besides blanks."""
    return F.coalesce(F.trim(col) != "", F.lit(False))


def blank_to_null(col: Column) -> Column:
    return F.when(non_blank(col), F.trim(col))


def is_rush(pan: Column) -> Column:
    """Rush pan: trimmed text starts with R and is shorter than four characters."""
    text = F.upper(F.trim(pan))
    return F.coalesce(text.startswith("R") & (F.length(text) < 4), F.lit(False))


def hold_marker(reason: Column, markers: Sequence[str] = V.HOLD_MARKERS) -> Column:
    """First of the bracketed markers found in the text."""
    found = F.lit(None).cast("string")
    for marker in reversed(markers):
        found = F.when(F.upper(reason).contains(f"({marker})"), F.lit(marker)).otherwise(found)
    return found


def account_flag(on_cod: Column, credit_hold: Column, in_collection: Column) -> Column:
    """Account state by precedence."""
    return (
        F.when(on_cod, F.lit("COD"))
        .when(credit_hold, F.lit("Credit Hold"))
        .when(in_collection, F.lit("In Collection"))
        .otherwise(F.lit(""))
    )


def map_values(col: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep the others."""
    if not mapping:
        return col
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)


def normalise_category(
    category: Column,
    aliases: Mapping[str, str] = V.CATEGORY_ALIASES,
    other: str = V.OTHER,
) -> Column:
    """Canonical category: trimmed, blank -> Other, every expander under one label."""
    text = F.coalesce(blank_to_null(category), F.lit(other))
    return F.when(F.lower(text).contains("expander"), F.lit(V.EXPANDERS)).otherwise(
        map_values(text, aliases)
    )


def location_label(location: Column, aliases: Mapping[str, str] = V.LOCATION_ALIASES) -> Column:
    return map_values(location, aliases)


def list_rank(col: Column, order: Sequence[str], unknown: int | None = None) -> Column:
    """1-based position in a display list; unlisted values follow the list."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), col)
    last = len(order) + 1 if unknown is None else unknown
    return F.coalesce(F.nullif(position, F.lit(0).cast("bigint")), F.lit(last).cast("bigint"))


def priority_rank(col: Column, priority: Sequence[str], unknown: int = 99) -> Column:
    """Rank of a value in a priority list whose entries may be LIKE patterns."""
    rank = F.lit(unknown)
    for position, entry in reversed(list(enumerate(priority, 1))):
        hit = col.like(entry) if "%" in entry else col == entry
        rank = F.when(hit, F.lit(position)).otherwise(rank)
    return rank


def short_name(name: Column, unknown: str = "Unknown") -> Column:
    """'First Middle Last' -> 'First L.'; one word stays; blank -> unknown."""
    words = F.split(F.trim(name), r"\s+")
    short = F.concat(
        F.element_at(words, 1), F.lit(" "), F.substring(F.element_at(words, -1), 1, 1), F.lit(".")
    )
    return (
        F.when(~non_blank(name), F.lit(unknown)).when(F.size(words) < 2, name).otherwise(short)
    )


def full_name(first: Column, last: Column) -> Column:
    """Joined name with missing parts as empty text."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def id_number(text: Column) -> Column:
    """Employee id as a whole number; accepts numeric text such as '12.0' (P22)."""
    return F.trim(text.cast("string")).try_cast("double").try_cast("bigint")


def yes_no_flag(col: Column) -> Column:
    """Yes/No, true/false and 0/1 texts -> 0/1, anything else -> 0."""
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text.isin("yes", "true", "1"), F.lit(1)).otherwise(F.lit(0))


def half_even(col: Column, digits: int) -> Column:
    """Round half to even."""
    return F.bround(col, digits)


def band(value: Column, tiers: Sequence[tuple[float, str]], last: str) -> Column:
    """First tier whose upper bound (inclusive) holds the value."""
    label = F.lit(last)
    for bound, name in reversed(tiers):
        label = F.when(value <= bound, F.lit(name)).otherwise(label)
    return label


def pace_tier(pct: Column) -> Column:
    return band(pct, V.PACE_TIERS, "green")


def goal_band(pct: Column) -> Column:
    """Five levels of goal attainment; null -> 'no data' (N05)."""
    label = F.lit("red")
    for bound, name in reversed(V.GOAL_BANDS):
        label = F.when(pct >= bound, F.lit(name)).otherwise(label)
    return F.when(pct.isNull(), F.lit("no data")).otherwise(label)


def load_tier(total: Column) -> Column:
    low, medium = (bound for bound, _ in V.LOAD_TIERS)
    return (
        F.when(total < low, F.lit("low"))
        .when(total < medium, F.lit("medium"))
        .otherwise(F.lit("high"))
    )


def compact_currency(amount: Column) -> Column:
    """$1.2M, $340K, $900."""
    value = amount.cast("decimal(38,2)")
    millions = F.round(value / F.lit(1_000_000), 1).cast("decimal(38,1)").cast("string")
    thousands = F.round(value / F.lit(1_000), 0).cast("decimal(38,0)").cast("string")
    units = F.format_number(F.round(value, 0), 0)
    return (
        F.when(value >= 1_000_000, F.concat(F.lit("$"), millions, F.lit("M")))
        .when(value >= 1_000, F.concat(F.lit("$"), thousands, F.lit("K")))
        .when(value.isNotNull(), F.concat(F.lit("$"), units))
        .otherwise(F.lit(""))
    )


# -- display formats (D12) ------------------------------------------------------------------------


def weekday_month_day(day: Column) -> Column:
    """Fri Nov 28"""
    return F.date_format(day, "EEE MMM dd")


def weekday_slash(day: Column) -> Column:
    """Mon 3/30"""
    return F.date_format(day, "EEE M/d")


def slash_day(day: Column) -> Column:
    """3/30"""
    return F.date_format(day, "M/d")


def day_month_year(day: Column) -> Column:
    """28 Nov 25"""
    return F.date_format(day, "dd MMM yy")


def month_apostrophe_year(day: Column) -> Column:
    """Nov '25"""
    return F.date_format(day, "MMM ''yy")


def clock_time(ts: Column) -> Column:
    """2:34 PM"""
    return F.date_format(ts, "h:mm a")


def scan_label(ts: Column, as_of: Column) -> Column:
    """Time alone for scans of the day, time and day otherwise, blank for none."""
    time = clock_time(ts)
    return (
        F.when(ts.isNull(), F.lit(""))
        .when(F.to_date(ts) == as_of, time)
        .otherwise(F.concat(time, F.lit(" "), slash_day(ts)))
    )


def excel_serial_date(serial: Column) -> Column:
    """Spreadsheet day number -> date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def json_text_list(text: Column) -> Column:
    """JSON array text -> array of strings; bad or missing text -> empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def text_list_json(values: Column) -> Column:
    return F.to_json(F.coalesce(values, F.array().cast("array<string>")))
