"""Stores, files, edits, mirrors and exports on temporary folders."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casewright.operators import edits as Z
from casewright.operators import mirror as M
from casewright.sources import exports as X
from casewright.sources import stores as S
from casewright.sources import tables as T
from casewright.sources import timesheets as TS

DAY = date(2026, 7, 1)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def daily(spark, entries):
    df = spark.createDataFrame(entries, "date date, employee_id long, efficiency string")
    out = df.withColumn("efficiency", F.col("efficiency").cast("decimal(18,2)"))
    for f in S.DAILY_SCHEMA:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out.select(*S.DAILY_COLUMNS)


def test_upsert_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "daily")
    assert S.read_history(spark, path).count() == 0
    first = daily(spark, [(DAY, 1, "1"), (DAY, 2, "2"), (DAY + timedelta(1), 1, "3")])
    S.upsert_by_partition(first, path, sort=["employee_id"])
    second = daily(spark, [(DAY, 1, "9")])
    for _ in range(2):
        S.upsert_by_partition(second, path, sort=["employee_id"])
        got = S.read_history(spark, path).select("date", "employee_id", F.col("efficiency").cast("int"))
        assert rows(got, "date", "employee_id") == [(DAY, 1, 9), (DAY + timedelta(1), 1, 3)]


def test_snapshot_retention(spark, tmp_path):
    path = str(tmp_path / "noon")
    for k in range(0, 12, 2):
        day = DAY + timedelta(days=k)
        df = spark.createDataFrame([(day, "t", k)], "data_date date, team string, n int")
        S.upsert_snapshot(df, path, as_of=day, sort=["team"])
    got = {r.n for r in spark.read.parquet(path).collect()}
    assert got == {4, 6, 8, 10}


def test_guarded_write(spark, tmp_path):
    path, now = str(tmp_path / "store"), datetime(2026, 7, 1)
    with pytest.raises(FileNotFoundError):
        S.read_current(spark, path)
    wide = spark.range(100)
    assert S.guarded_write(wide, path, now=now).rows == 100
    empty = S.guarded_write(spark.range(0), path, now=now + timedelta(1))
    assert not empty.published and S.read_current(spark, path).count() == 100
    small = S.guarded_write(spark.range(10), path, now=now + timedelta(2))
    assert small.published and small.warning == "10 rows replace 100"
    for k in range(3, 12):
        own = S.read_current(spark, path).select((F.col("id") + 1).alias("id"))
        S.guarded_write(own, path, now=now + timedelta(k), keep=7)
    assert S.read_current(spark, path).agg(F.min("id")).first()[0] == 9
    assert len([n for n in S.Folder(spark, path).children() if n.startswith("v_")]) == 7


def test_older_name_is_not_pruned(spark, tmp_path):
    path, now = str(tmp_path / "v"), datetime(2026, 7, 1)
    for k in range(7):
        S.guarded_write(spark.range(10 + k), path, now=now + timedelta(k))
    S.guarded_write(spark.range(99), path, now=now - timedelta(5))
    assert S.read_current(spark, path).count() == 99
    assert len([n for n in S.Folder(spark, path).children() if n.startswith("v_")]) == 7


def test_failed_write_leaves_nothing(spark, tmp_path):
    path, now = str(tmp_path / "v"), datetime(2026, 7, 1)
    S.guarded_write(spark.range(10), path, now=now)
    with pytest.raises(PySparkException):
        S.guarded_write(spark.range(5).select(F.raise_error(F.lit("cut off"))), path, now=now + timedelta(1))
    assert [n for n in S.Folder(spark, path).children() if n.startswith("v_")] == ["v_20260701_000000_000000"]
    assert S.read_current(spark, path).count() == 10


def test_lost_pointer_is_no_first_run(spark, tmp_path):
    path = str(tmp_path / "v")
    S.guarded_write(spark.range(10), path, now=datetime(2026, 7, 1))
    S.Folder(spark, path).delete(S.POINTER)
    with pytest.raises(FileNotFoundError, match="no pointer"):
        S.current_version(spark, path)
    with pytest.raises(FileNotFoundError, match="no pointer"):
        S.guarded_write(spark.range(3), path, now=datetime(2026, 7, 2))


def test_refused_and_interrupted_runs(spark, tmp_path):
    log = str(tmp_path / "log")
    with M.SyncRun(spark, "cases", log) as run:
        run.rows, run.report = 5, S.WriteReport(False, "v", 0, 10, "empty result refused")
    with pytest.raises(KeyboardInterrupt), M.SyncRun(spark, "tasks", log):
        raise KeyboardInterrupt
    got = spark.read.parquet(log).select("sync_type", "status", "succeeded", "error")
    assert rows(got, "sync_type") == [("cases", "refused", 0, "empty result refused"), ("tasks", "failed", 0, "")]


def test_timesheets(spark, tmp_path):
    head = "".join(f"line {k}\n" for k in range(8))
    (tmp_path / "hours-2026-07-01-to-2026-07-02.csv").write_text(
        head + 'Name,Rest break,Note,Total hours\r\n"Lee, Ann",0.5,"said ""hi""",8.25\r\n\r\nBob,,,x\r\n'
        "Cy,1,n,6\r\n,,,\r\nTotal,9,,99\r\n"
    )
    (tmp_path / "hours-2026-07-03-to-2026-07-03.csv").write_text(head + "Total hours,Name\n7,Ann\n")
    got = TS.read_timesheets(spark, str(tmp_path / "hours-*.csv"))
    assert rows(got, "date", "name") == [
        (DAY, date(2026, 7, 2), "Bob", 0.0),
        (DAY, date(2026, 7, 2), "Cy", 5.0),
        (DAY, date(2026, 7, 2), "Lee, Ann", 7.75),
        (date(2026, 7, 3), date(2026, 7, 3), "Ann", 7.0),
    ]
    (tmp_path / "undated.csv").write_text(head + "Name,Total hours\nx,1\n")
    with pytest.raises(PySparkException, match="no date range"):
        TS.read_timesheets(spark, str(tmp_path / "undated.csv")).collect()


@pytest.fixture
def small_blocks(spark):
    """Files read in blocks of 2 kB."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_of_a_file_are_numbered_by_block(small_blocks, tmp_path):
    written = {"a.csv": [f"row {k}" + " x" * (k % 7) for k in range(3_000)], "b.csv": ["", "y" * 9_000, "", "z"], "c.csv": ["one"]}
    for name, texts in written.items():
        (tmp_path / name).write_text("\r\n".join(texts) + "\n")
    (tmp_path / "empty.csv").write_text("")
    lines = TS.numbered_lines(small_blocks, str(tmp_path / "*.csv"))
    assert [(r.file, r.line, r.value) for r in lines.orderBy("file", "line").collect()] == [
        (name, k + 1, text) for name, texts in sorted(written.items()) for k, text in enumerate(texts)
    ]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and plan.count("windowspecdefinition(path") == 1
    blocks = small_blocks.read.text(str(tmp_path / "a.csv")).select("_metadata.file_block_start").distinct()
    assert blocks.count() > 10


def test_a_timesheet_of_many_blocks(small_blocks, tmp_path):
    head = "".join(f"line {k}\n" for k in range(8)) + "Name,Total hours,Rest break\n"
    body = "".join(f"n{k:04},{k % 10},0.5\n" for k in range(2_000))
    (tmp_path / "hours-2026-07-01-to-2026-07-01.csv").write_text(head + body + ",,\n" + body)
    got = rows(TS.read_timesheets(small_blocks, str(tmp_path / "*.csv")).select("name", "work_hours"), "name")
    assert got == [(f"n{k:04}", k % 10 - 0.5) for k in range(2_000)]


def test_lookups(spark, tmp_path):
    path = tmp_path / "tech.csv"
    path.write_text("Name,Noon,3PM,ShiftType,DesignType\nAnn,12,NA,Day,Regular\n")
    got = T.tech_targets(T.read_lookup(spark, str(path), "tech_constants"))
    assert rows(got, "name") == [("Ann", 12, None, "Day", "Regular")]
    goals = tmp_path / "goals.csv"
    goals.write_text("RevenueGoal,Year,Month\n500000,2026,1\n2,bad,2\n")
    assert rows(T.read_lookup(spark, str(goals), "revenue_goals"), "month") == [(2026, 1, 500000.0), (None, 2, 2.0)]


def test_lookup_rows_are_kept(spark, tmp_path):
    path = tmp_path / "staff.csv"
    path.write_text("EmployeeID,StaffName,PayrollName,Team,TrainingPlan\n7,A,a,T,1\n12.0,B,b,T,1.0\n13,C,c,T,\nx,D,d,T,2\n")
    got = rows(T.read_lookup(spark, str(path), "employees").select("employee_id", "staff_name", "training_plan"), "staff_name")
    assert got == [(7, "A", 1), (12, "B", 1), (13, "C", None), (None, "D", 2)]
    path.write_text("EmployeeID,StaffName\n7,A\n")
    with pytest.raises(ValueError, match="missing columns: payroll_name, team, training_plan"):
        T.read_lookup(spark, str(path), "employees")
    holidays = tmp_path / "holidays.csv"
    holidays.write_text("Date,Name\n2026-07-04,x\nsoon,y\n")
    assert rows(T.read_lookup(spark, str(holidays), "holidays"), "date") == [(date(2026, 7, 4), "x")]


def test_missing_table_raises(spark, tmp_path):
    with pytest.raises(PySparkException):
        T.read_table(spark, str(tmp_path), "cases")


def test_bound_sql_and_windows(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    assert T.run_sql(spark, "SELECT * FROM numbers WHERE id >= :low AND id < :high", low=3, high=5).count() == 2
    days = spark.createDataFrame([(DAY + timedelta(days=k),) for k in range(-10, 15)], "d date")
    assert days.filter(T.between_offsets(F.col("d"), DAY, -5, 11, low_open=True, high_open=True)).count() == 15
    assert days.filter(T.between_offsets(F.col("d"), DAY, -3, 10)).count() == 14


def test_import_history(spark):
    df = spark.createDataFrame(
        [("45000", "12.0", "Ann", "nan", "1"), ("2026-07-01 00:00:00", "7", "nan", " A ", "2")],
        "date string, employee_id string, staff_name string, team string, efficiency string",
    )
    got = S.import_history(df)
    assert got.schema == S.DAILY_SCHEMA
    assert rows(got.select("date", "employee_id", "staff_name", "team", "efficiency"), "date") == [
        (date(2023, 3, 15), 12, "Ann", "", 1),
        (DAY, 7, "", "A", 2),
    ]
    with pytest.raises(ValueError, match="missing columns: team"):
        S.import_history(df.drop("team"))


# -- edits -----------------------------------------------------------------------------------------


def test_fold_duplicates(spark):
    df = spark.createDataFrame(
        [(" 1 ", "short", True, "b"), ("1", "longer text", False, "a"), ("", "x", True, "z"), (None, "x", True, "z")],
        "key string, note string, done boolean, at string",
    )
    got = Z.fold_duplicates(df, "key", texts=["note"], flags=["done"], stamp="at")
    assert rows(got, "key") == [("1", "longer text", True, "b")]


def test_apply_edits(spark):
    t0, t1, t2 = (datetime(2026, 7, 1, h) for h in (1, 2, 3))
    kinds = "key string, note string, outcome string, last_updated timestamp_ntz"
    state = spark.createDataFrame([("1", "old", "yes", t0), ("2", "keep", "no", t0)], kinds)
    edits = spark.createDataFrame(
        [("1", "late", None, t2, 5), ("1", "early", "", t1, 4), (" 3", None, "new", t1, 6), ("", "x", "x", t1, 7)],
        kinds + ", edit_id int",
    )
    options = {"key": "key", "defaults": {"note": "", "outcome": ""}}
    once = Z.apply_edits(state, edits, **options)
    want = [("1", "late", "", t2), ("2", "keep", "no", t0), ("3", "", "new", t1)]
    assert rows(once, "key") == want
    assert rows(Z.apply_edits(once, edits, **options), "key") == want


def test_recipients(spark):
    df = spark.createDataFrame([("lab", '["a@x"]'), ("cs", "oops")], "department string, emails string")
    got = {r.department: r.emails for r in Z.recipients(df, ["cs", "lab", "shipping"], ["d@x"]).collect()}
    assert got == {"cs": [], "lab": ["a@x"], "shipping": ["d@x"]}


# -- mirrors ---------------------------------------------------------------------------------------

RUN1, RUN2 = datetime(2026, 7, 1, 2), datetime(2026, 7, 2, 2)
CUSTOMERS = "customer_id long, practice_name string, city string, state string, active boolean"


def customers(spark, entries):
    """Customers whose contact columns follow from their id."""
    number = F.col("customer_id").cast("string")
    contact = {"address1": F.concat(number, F.lit(" Main")), "address2": F.lit(None).cast("string"), "zip_code": F.lpad(number, 5, "0")}
    contact |= {"office_phone": F.concat(F.lit("555-"), number), "email": F.concat(number, F.lit("@x.example"))}
    return spark.createDataFrame(entries, CUSTOMERS).withColumns(contact)


def mirror_customers(spark, entries, current, now, **options):
    target = M.customers_target()
    source = M.mapped_rows(customers(spark, entries), target, {})
    return M.upsert(current, source, target, now=now, **options)


def test_upsert_is_idempotent(spark):
    entries = [(1, None, "X", "WA", None), (2, "P", "X", "Wash", False), (3, "Q", None, " ", True)]
    first = mirror_customers(spark, entries, None, RUN1)
    assert {(r.customer_code, r.practice_name, r.state, r.is_active) for r in first.collect()} == {
        ("1", "", "WA", True),
        ("2", "P", None, False),
        ("3", "Q", None, True),
    }
    contact = first.filter("customer_code = '2'").select("address_line1", "address_line2", "zip", "phone", "email").first()
    assert tuple(contact) == ("2 Main", None, "00002", "555-2", "2@x.example")
    again = mirror_customers(spark, entries, first, RUN2)
    assert rows(again, "customer_code") == rows(first, "customer_code")
    changed = mirror_customers(spark, [(1, "New", "X", "WA", None), (4, "R", "Y", None, True)], first, RUN2)
    assert {r.customer_code: r.updated_at for r in changed.collect()} == {"1": RUN2, "2": RUN1, "3": RUN1, "4": RUN2}
    ids = {r.customer_code: r.customer_id for r in first.collect()}
    assert all(ids.get(r.customer_code, r.customer_id) == r.customer_id for r in changed.collect())
    gone = mirror_customers(spark, [(1, "New", "X", "WA", None)], first, RUN2, delete_missing=True)
    assert [r.customer_code for r in gone.collect()] == ["1"]


def test_repeated_keys(spark):
    entries = [(1, "A", None, None, True), (1, "B", None, None, True)]
    with pytest.raises(PySparkException, match="repeated key 1"):
        mirror_customers(spark, entries, None, RUN1).collect()
    target = M.customers_target()
    source = M.mapped_rows(customers(spark, entries), target, {}, newest=[F.col("practice_name")])
    assert [r.practice_name for r in M.upsert(None, source, target, now=RUN1).collect()] == ["B"]


def test_unknown_foreign_keys_become_null(spark):
    departments = M.upsert(
        None,
        M.mapped_rows(
            spark.createDataFrame([(5, "Design", None)], "department_id int, department_name string, active boolean"),
            M.departments_target(),
            {},
        ),
        M.departments_target(),
        now=RUN1,
    )
    staff = spark.createDataFrame(
        [(1, "A", None, "Design", "tech", None, DAY), (2, None, "B", "Gone", None, False, None), (3, "C", "C", None, None, True, None)],
        "employee_id int, first_name string, last_name string, department string, position string, active boolean, hire_date date",
    )
    target = M.employees_target()
    got = M.upsert(None, M.mapped_rows(staff, target, {"departments": departments}), target, now=RUN1)
    assert {r.employee_code: r.department_id is not None for r in got.collect()} == {"1": True, "2": False, "3": False}


def test_children(spark):
    parents = spark.createDataFrame([("a", 1), ("b", 2)], "case_number string, case_id int")
    current = spark.createDataFrame([(1, "old"), (2, "old")], "case_id int, task_name string")
    source = spark.createDataFrame([("a", "new1"), ("a", "new2"), ("zz", "lost")], "case_number string, task_name string")
    options = {"parent_key": "case_number", "parent_id": "case_id"}
    once = M.replace_children(current, source, parents, **options)
    want = [(1, "new1"), (1, "new2"), (2, "old")]
    assert rows(once.table, "case_id", "task_name") == want
    assert once.orphans.count() == 1
    assert rows(M.replace_children(once.table, source, parents, **options).table, "case_id", "task_name") == want


def test_sync_log(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    with M.SyncRun(spark, "cases", log) as run:
        run.failed = 2
        run.counted(spark.range(5)).write.parquet(out)
    with M.SyncRun(spark, "tasks", log):
        raise RuntimeError("source is down")
    got = spark.read.parquet(log).select("sync_type", "status", "attempted", "succeeded", "failed", "error")
    assert rows(got, "sync_type") == [
        ("cases", "completed", 7, 5, 2, None),
        ("tasks", "failed", 0, 0, 0, "source is down"),
    ]


# -- exports ---------------------------------------------------------------------------------------


def test_case_export(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", None, DAY, "Metal", "t", None, datetime(2026, 7, 1, 14, 5), True), ("2", "R1", None, None, None, "QC", None, None)],
        "case_number string, pan_number string, ship_date date, category string, last_task string,"
        " location string, last_scan timestamp_ntz, local_delivery boolean",
    )
    out = X.export_cases(df, as_of=DAY)
    assert rows(out, "Case #") == [
        ("1", "", "7/1/2026", "Metal", "t", "", "2:05 PM", "Yes"),
        ("2", "R1", "", "", "", "QC", "", "No"),
    ]
    path = str(tmp_path / "csv")
    X.write_csv(out, path)
    assert spark.read.csv(path, header=True).count() == 2


def test_labels_and_records(spark):
    df = spark.createDataFrame(
        [(1, None, DAY, 'say ":null', None), (2, 1.5, None, None, [1])],
        "customer_id int, mtd_sales double, date_of_first_case date, city string, other array<int>",
    )
    got = X.export_customers(df)
    assert got.columns == ["ID", "City", "MTD Sales", "First Case"]
    assert rows(got, "ID") == [("1", 'say ":null', "", "2026-07-01"), ("2", "", "1.5", "")]
    import json

    records = [json.loads(r.record) for r in X.to_records(df).collect()]
    assert records[0] == {"customer_id": 1, "mtd_sales": "", "date_of_first_case": "2026-07-01", "city": 'say ":null', "other": ""}
    assert records[1] == {"customer_id": 2, "mtd_sales": 1.5, "date_of_first_case": "", "city": "", "other": [1]}
