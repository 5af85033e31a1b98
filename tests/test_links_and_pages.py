"""Link graphs read once, business days by number, pages by rank, rewrites of changed days, first runs that die."""

import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from casewright import flows
from casewright.functions.calendar import TABLE_FIRST, TABLE_LAST, BusinessCalendar
from casewright.operators import customers as B
from casewright.operators import efficiency as E
from casewright.operators import joins as J
from casewright.operators import remakes as R
from casewright.plans.lab_views import CALENDAR
from casewright.sources import exports as X
from casewright.sources import stores as S

DAY = date(2026, 7, 1)


# -- links -----------------------------------------------------------------------------------------


def test_either_end_keeps_every_row_once(spark):
    rows = [(1, 10, 20), (1, 10, 20), (2, 10, None), (3, None, 20), (4, 20, 20), (5, 30, 40), (6, None, None), (7, 40, 10)]
    df = spark.createDataFrame(rows, "call long, first long, second long")
    for ids in ([10], [20], [10, 20, 20], [None], []):
        wanted = sorted((r for r in rows if {r[1], r[2]} & set(ids) - {None}), key=str)
        got = J.semi_either(df, "first", "second", spark.createDataFrame([(i,) for i in ids], "id long"), "id")
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == wanted


def test_pairs_from_ends(spark):
    schema = "case_id long, date_in timestamp_ntz, status string, note string"
    at = datetime(2026, 6, 1)
    cases = spark.createDataFrame(
        [(1, at, "Open", None), (2, at, "Open", "two"), (3, at, "Cancelled", "x"), (4, datetime(2020, 1, 1), "Open", None), (5, at, None, "y")], schema
    )
    links = [(1, 2), (1, 2), (2, 1), (3, 1), (4, 1), (1, 4), (1, 99), (99, 1), (2, 2), (5, 1), (None, 1), (1, None), (1, 3)]
    notes = [(a, b, "a Remake Of b") for a, b in links] + [(1, 5, "Split From"), (1, 5, None)]
    pairs = R.remake_pairs(
        spark.createDataFrame(notes, "case_id long, link_case_id long, notes string"), cases, as_of=DAY, columns=["status", "note", "date_in"]
    )
    got = sorted(((r.main_case_id, r.og_case_id, r.main_note, r.og_note, r.og_status) for r in pairs.collect()), key=str)
    # A main case must be recent and not cancelled (5 has no status); a link that occurs twice gives its pair twice.
    wanted = [(1, 2, None, "two", "Open")] * 2 + [(2, 1, "two", None, "Open"), (1, 4, None, None, "Open"), (2, 2, "two", "two", "Open"), (1, 3, None, "x", "Cancelled")]
    assert got == sorted(wanted, key=str)
    assert sorted(r.case_id for r in R.pair_ids(pairs).collect()) == [1, 2, 3, 4]


# -- business days ---------------------------------------------------------------------------------


@pytest.mark.parametrize("calendar", [CALENDAR, BusinessCalendar()])
def test_shifts_equal_stepping_day_by_day(spark, calendar):
    rng = random.Random(1)
    days = [date(1998, 1, 1) + timedelta(days=rng.randrange(4000)) for _ in range(60)] + [date(1998, 6, 12), date(2024, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,), (date(1900, 1, 1),), (TABLE_FIRST,), (TABLE_LAST,)], "day date")
    shifts = {"back": -1, "on": 1, "five": 5, "far_back": -250, "far": 250}
    got = {r.day: r for r in calendar.shifted(df, F.col("day"), shifts).collect()}
    assert len(got) == len(set(days)) + 4
    for d in days:
        assert got[d].back == calendar.previous_day(d) and got[d].on == calendar.next_day(d)
        assert got[d].five == calendar.next_day(d, 5)
        assert (got[d].far_back, got[d].far) == (calendar.previous_day(d, 250), calendar.next_day(d, 250))
    assert tuple(got[None]) == (None,) * 6 and tuple(got[date(1900, 1, 1)])[1:] == (None,) * 5
    assert got[TABLE_FIRST].back is None and got[TABLE_LAST].on is None
    text = calendar.shifted(df, F.col("day"), {"far": 250})._jdf.queryExecution().executedPlan().toString()
    assert "sequence" not in text and "filter(" not in text


# -- pages -----------------------------------------------------------------------------------------


def test_digit_runs_of_any_length(spark):
    names = ["a2", "a10", "a" + "9" * 30, "a1" + "0" * 30, "A" + "0" * 40 + "3", "b1", "", None, "7", "007x", "a", "a2b10", "a2b9"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in df.orderBy(B.natural_key(F.col("name")), F.col("name")).collect()]
    assert got == [None, "", "7", "007x", "a", "a2", "a2b9", "a2b10", "A" + "0" * 40 + "3", "a10", "a" + "9" * 30, "a1" + "0" * 30, "b1"]


@pytest.mark.parametrize("shallow", [10_000, 40])
def test_pages_shallow_and_deep(spark, monkeypatch, shallow):
    monkeypatch.setattr(B, "SHALLOW", shallow)
    monkeypatch.setattr(B, "SPLITS", 8)
    rng = random.Random(2)
    rows = [(k, rng.choice(["x", "y", None, "zz"])) for k in range(1500)]
    df = spark.createDataFrame(rows, "id long, kind string").repartition(5)
    order = [F.col("kind"), F.col("id")]
    wanted = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    for number, size in ((1, 100), (2, 100), (9, 100), (15, 100), (16, 100), (40, 37), (99, 100)):
        got = B.page(df, order, number, size, place="position").collect()
        part = wanted[(number - 1) * size : number * size]
        assert [(r.id, r.kind) for r in got] == part and [r.position for r in got] == list(range(1, len(part) + 1))


def test_deep_pages_of_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(B, "SHALLOW", 10)
    df = spark.createDataFrame([(1,)] * 200 + [(2,)] * 5, "k int")
    assert [r.k for r in B.page(df, [F.col("k")], 20, 10).collect()] == [1] * 10
    assert [r.k for r in B.page(df, [F.col("k")], 21, 10).collect()] == [2] * 5
    assert B.page(df.limit(0), [F.col("k")], 5, 10).collect() == []


# -- stores ----------------------------------------------------------------------------------------


def file_times(path):
    out = {}
    for root, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                out.setdefault(os.path.basename(root), set()).add((name, os.stat(os.path.join(root, name)).st_mtime_ns))
    return out


def test_only_days_with_a_change_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "daily")
    rows = [(e, "T" if e < 3 else "U", DAY + timedelta(days=k)) for k in range(5) for e in (1, 3) if not (e == 1 and k > 1)]
    history = spark.createDataFrame(rows, "employee_id long, team string, date date")
    S.upsert_by_partition(S.import_history(history.withColumns({c: F.lit("7") for c in ("staff_name", "efficiency")}).withColumn("date", F.col("date").cast("string"))), path)
    options = {"daily_path": path, "periods_path": str(tmp_path / "periods"), "calendar": BusinessCalendar(), "as_of": DAY + timedelta(days=6)}
    before = file_times(path)
    assert len(before) == 5
    assert flows.rename_teams(spark, {"T": "V"}, now=datetime(2026, 7, 8), **options).published
    after = file_times(path)
    changed = {f"date={DAY + timedelta(days=k)}" for k in (0, 1)}
    assert {d for d in before if before[d] != after[d]} == changed
    assert {(r.team, r.date) for r in S.read_history(spark, path).filter("employee_id = 1").collect()} == {("V", DAY), ("V", DAY + timedelta(1))}
    assert S.read_history(spark, path).count() == len(rows)
    side = spark.createDataFrame([(1, "7", "W", None), (9, "n", "X", None)], "employee_id int, staff_name string, team string, training_plan int")
    assert flows.reapply_employees(spark, side, now=datetime(2026, 7, 9), **options).published
    again = file_times(path)
    assert {d for d in after if after[d] != again[d]} == changed
    assert flows.reapply_employees(spark, side, now=datetime(2026, 7, 10), **options).published
    assert file_times(path) == again


def test_a_hot_day_is_written_by_many_tasks_and_the_input_read_once(spark, tmp_path):
    path = str(tmp_path / "hot")
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(120_000).select(F.when(F.col("id") % 10 == 0, F.lit(DAY)).otherwise(F.lit(DAY + timedelta(1))).alias("date"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "512k", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.1"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        S.upsert_by_partition(rows.mapInArrow(tell, "date date, text string"), path, sort=["text"])
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert seen.value == 120_000
    files = file_times(path)
    assert len(files[f"date={DAY + timedelta(1)}"]) > 2
    assert spark.read.parquet(path).count() == 120_000


@pytest.mark.parametrize("step", ["rename", "write_text"])
def test_a_first_run_that_dies_is_repeated(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "v")
    from casewright.sources.files import Folder

    real = getattr(Folder, step)

    def dies(self, name, *rest):
        if step == "rename" or name == S.POINTER:
            raise KeyboardInterrupt
        return real(self, name, *rest)

    monkeypatch.setattr(Folder, step, dies)
    with pytest.raises(KeyboardInterrupt):
        S.guarded_write(spark.range(10), path, now=datetime(2026, 7, 1))
    monkeypatch.undo()
    assert S.current_version(spark, path) is None
    for k in (1, 2):
        assert S.guarded_write(spark.range(10 + k), path, now=datetime(2026, 7, k)).published
        assert S.read_current(spark, path).count() == 10 + k
    left = S.Folder(spark, path).children()
    assert not [n for n in left if n.startswith((S.DRAFT, S.FIRST))]
    S.Folder(spark, path).delete(S.POINTER)
    with pytest.raises(FileNotFoundError, match="no pointer"):
        S.current_version(spark, path)


def test_period_matrix_export(spark):
    matrix = spark.createDataFrame([("Ann", None, 0.75), (None, "T", None)], "staff_name string, team string, week_0 double")
    assert [tuple(r) for r in X.export_periods(matrix).collect()] == [("Ann", "", "0.75"), ("", "T", "")]
    assert X.export_periods(matrix).columns == matrix.columns


# -- employees whose id is a text ------------------------------------------------------------------


def test_text_ids_are_employees_of_their_own(spark):
    rows = [("web", "1"), ("web ", "1"), ("kiosk", "2"), ("7.0", "3"), ("7", "4"), (None, "5")]
    df = spark.createDataFrame(rows, "completed_by string, case_number string").withColumns({"rejected": F.lit("No"), "duration": F.lit("1")})
    got = {(r.employee_id, r.employee_text): (r.cases_worked_on, r.tasks_completed) for r in E.employee_totals(df).collect()}
    assert got == {(None, "web"): (1, 2), (None, "kiosk"): (1, 1), (7, None): (2, 2)}
