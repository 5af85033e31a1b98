from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from casewright import vocabulary as V
from casewright.functions import text as X
from casewright.functions.followup import follow_up_date, resolve_year


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", expr(F.col("v")).alias("x")).orderBy("k").collect()]


def test_rush(spark):
    values = ["R1", " r12 ", "R123", "R", None, "7001", ""]
    assert column(spark, values, "string", X.is_rush) == [True, True, False, True, False, False, False]


def test_hold_marker(spark):
    values = ["(AFU) 12/15", "zfu1/3", "x (ZFU) (AFU)", "(efu)", None, ""]
    assert column(spark, values, "string", X.hold_marker) == ["AFU", None, "AFU", "EFU", None, None]


def test_account_flag(spark):
    rows = [(True, True, True), (False, True, True), (False, False, True), (None, None, None)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean")
    flags = [r[0] for r in df.select(X.account_flag(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert flags == ["COD", "Credit Hold", "In Collection", ""]


def test_categories(spark):
    values = ["Airway", "Marpe", "Lab to lab", " ", None, "E-EXPANDER x", " Metal ", "Accessories"]
    got = column(spark, values, "string", X.normalise_category)
    assert got == ["MARPE", "MARPE", "Lab to Lab", "Other", "Other", V.EXPANDERS, "Metal", "Accessories"]
    workload = column(spark, values, "string", lambda c: X.normalise_category(c, V.WORKLOAD_ALIASES))
    assert workload[-1] == "Other"


def test_names(spark):
    values = ["John Q Smith", "Solo", "  ", None, " Ann  Lee "]
    got = column(spark, values, "string", X.short_name)
    assert got == ["John S.", "Solo", "Unknown", "Unknown", "Ann L."]
    df = spark.createDataFrame([(None, "B"), ("A", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(X.full_name(F.col("a"), F.col("b"))).collect()] == [" B", "A ", " "]


def test_numbers_and_flags(spark):
    assert column(spark, ["12", "12.0", " 7 ", "x", None], "string", X.id_number) == [12, 12, 7, None, None]
    assert column(spark, ["Yes", "no", "1", "true", None, "?"], "string", X.yes_no_flag) == [1, 0, 1, 1, 0, 0]
    assert column(spark, [0.5, 1.5, 2.5], "double", lambda c: X.half_even(c, 0)) == [0.0, 2.0, 2.0]
    got = column(spark, ["1250000", "340400", "900", "999.4", None], "string", lambda c: X.compact_currency(c.cast("decimal(18,2)")))
    assert got == ["$1.3M", "$340K", "$900", "$999", ""]


def test_bands(spark):
    assert column(spark, [25.0, 25.1, 75.0, 75.1], "double", X.pace_tier) == ["red", "orange", "yellow", "green"]
    got = column(spark, [110.0, 100.0, 90.0, 89.9, None], "double", X.goal_band)
    assert got == ["dark green", "green", "amber", "red", "no data"]
    assert column(spark, [14, 15, 49, 50], "int", X.load_tier) == ["low", "medium", "medium", "high"]


def test_formats(spark):
    day = [date(2026, 3, 30)]
    assert column(spark, day, "date", X.weekday_slash) == ["Mon 3/30"]
    assert column(spark, day, "date", X.weekday_month_day) == ["Mon Mar 30"]
    assert column(spark, day, "date", X.day_month_year) == ["30 Mar 26"]
    assert column(spark, day, "date", X.month_apostrophe_year) == ["Mar '26"]
    stamps = [datetime(2026, 3, 30, 14, 5), datetime(2026, 3, 29, 0, 30), None]
    got = column(spark, stamps, "timestamp_ntz", lambda c: X.scan_label(c, F.lit(date(2026, 3, 30))))
    assert got == ["2:05 PM", "12:30 AM 3/29", ""]
    assert column(spark, [45000], "int", X.excel_serial_date) == [date(2023, 3, 15)]


def test_json_lists(spark):
    values = ['["a","b"]', "broken", None, "[]"]
    assert column(spark, values, "string", X.json_text_list) == [["a", "b"], [], [], []]


def expected_date(month, day, reference):
    """Plain restatement of the year rule."""
    options = []
    for year in (reference.year - 1, reference.year, reference.year + 1):
        try:
            found = date(year, month, day)
        except ValueError:
            continue
        ahead = (found - reference).days
        if -365 <= ahead <= 180:
            options.append((-ahead - 30 if ahead <= 0 else ahead, found))
    return min(options)[1] if options else None


@pytest.mark.parametrize(
    "reference", [date(2026, 1, 1), date(2025, 12, 31), date(2024, 3, 1), date(2025, 3, 1), date(2024, 2, 29)]
)
def test_year_rule_over_every_day(spark, reference):
    pairs = [(str(m), str(d)) for m in range(0, 14) for d in range(0, 33)]
    df = spark.createDataFrame(pairs, "m string, d string")
    rows = df.select("m", "d", resolve_year(F.col("m"), F.col("d"), F.lit(reference)).alias("x")).collect()
    for r in rows:
        want = expected_date(int(r.m), int(r.d), reference) if int(r.m) and int(r.d) else None
        assert r.x == want, (r, want)
        assert r.x is None or timedelta(-365) <= r.x - reference <= timedelta(180)


def test_follow_up_texts(spark):
    reference = date(2026, 1, 10)
    cases = {
        "(AFU) 12/15 waiting": date(2025, 12, 15),
        "zfu1/3": date(2026, 1, 3),
        "(AFU) 2/30": None,
        "(AFU) 12/1 then (EFU)12/20": date(2025, 12, 20),
        "AFU 13/40, afu 1/7": date(2026, 1, 7),
        "call 1/7": None,
        "(AFU)": None,
        "": None,
        None: None,
        "x" * 5000 + " AFU 1/2": date(2026, 1, 2),
    }
    got = column(spark, list(cases), "string", lambda c: follow_up_date(c, F.lit(reference)))
    assert got == list(cases.values())
