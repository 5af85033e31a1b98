"""Follow-up dates mined from hold texts (D09, D10), without a UDF.

Every marker followed by month/day counts. Each pair gets the year that puts it nearest to the
reference day, with a bonus for the past; the latest resolved date of the text wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers with optional brackets followed by m/d, in any letter case.
MARKER_DATE = r"(?i)\(?(AFU|ZFU|EFU)\)?\s*(\d{1,2})/(\d{1,2})"
# How far a candidate may lie ahead or behind, and the bonus for past days.
MAX_DAYS_AHEAD = 180
MAX_DAYS_BEHIND = 365
PAST_BONUS = 30


def resolve_year(month: Column, day: Column, reference: Column) -> Column:
    """Best date for a month/day pair given as texts; null when no candidate is valid."""

    def candidate(offset: Column) -> Column:
        year = (F.year(reference) + offset).cast("string")
        text = F.concat_ws(
            "-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")
        )
        found = text.try_cast("date")
        ahead = F.date_diff(found, reference)
        score = F.when(ahead <= 0, -ahead - PAST_BONUS).otherwise(ahead)
        usable = ahead.between(-MAX_DAYS_BEHIND, MAX_DAYS_AHEAD)
        # Struct order: lowest score first, then the earlier date.
        return F.when(usable, F.struct(score.alias("score"), found.alias("date")))

    offsets = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return F.array_min(F.transform(offsets, candidate))["date"]


def follow_up_date(text: Column, reference: Column) -> Column:
    """Latest resolved follow-up date of a text, null when it holds none."""
    months = F.regexp_extract_all(text, F.lit(MARKER_DATE), F.lit(2))
    days = F.regexp_extract_all(text, F.lit(MARKER_DATE), F.lit(3))
    return F.array_max(
        F.zip_with(months, days, lambda month, day: resolve_year(month, day, reference))
    )
