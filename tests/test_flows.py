"""Whole jobs on temporary folders, run twice."""

from datetime import date, datetime

from pyspark.sql import functions as F

from casewright import flows
from casewright.functions.calendar import BusinessCalendar
from casewright.plans.lab_views import AS_OF, Lab
from casewright.sources import stores as S

FOLDER = "/root/testdata/sf0.001"


def test_upload_twice(spark, tmp_path):
    head = "".join("x\n" for _ in range(8)) + "Name,Total hours,Rest break\n"
    (tmp_path / "t-2026-07-01-to-2026-07-01.csv").write_text(head + "pay ann,8,0\nghost,8,0\n")
    (tmp_path / "t-2026-07-02-to-2026-07-02.csv").write_text(head + "pay ann,4.5,0.5\n")
    kinds = "case_id long, case_number string, task string, case_product_id int, completed_by string, complete_date timestamp_ntz, rejected string"
    history = spark.createDataFrame(
        [
            (1, "1", "t", 1, "7", datetime(2026, 7, 1, 9), "No"),
            (2, "2", "t", 1, "7", datetime(2026, 7, 2, 9), "No"),
            (2, "2", "t", 1, "7", datetime(2026, 7, 2, 9), "Yes"),
            (3, "3", "t", 1, "7", datetime(2026, 7, 2, 10), "No"),
        ],
        kinds,
    )
    plan = spark.createDataFrame(
        [(1, "t", 1, "2", 1), (3, "t", 1, "3", 1)],
        "case_id long, task string, case_product_id int, duration string, plan_id int",
    )
    staff = spark.createDataFrame(
        [("pay ann", 7, "Ann", "T", 1)],
        "payroll_name string, employee_id int, staff_name string, team string, training_plan int",
    )
    for k in range(2):
        report = flows.upload_timesheets(
            spark,
            str(tmp_path / "t-*.csv"),
            history,
            plan,
            staff,
            plan_order=[F.col("plan_id").desc()],
            daily_path=str(tmp_path / "daily"),
            periods_path=str(tmp_path / "periods"),
            calendar=BusinessCalendar(),
            as_of=date(2026, 7, 3),
            now=datetime(2026, 7, 3, 2 + k),
        )
        assert report.published and report.rows == 1
        stored = S.read_history(spark, str(tmp_path / "daily"))
        got = [(r.date.day, r.employee_id, float(r.efficiency)) for r in stored.orderBy("date").collect()]
        assert got == [(1, 7, 25.0), (2, 7, 75.0)]
        row = S.read_current(spark, str(tmp_path / "periods")).first()
        assert (row.days_ago_1, row.days_ago_2, row.week_0, row.training_plan) == (0.75, 0.25, 0.5, 1)


def test_file_of_several_days_import_and_renames(spark, tmp_path):
    head = "".join("x\n" for _ in range(8)) + "Name,Total hours,Rest break\n"
    (tmp_path / "t-2026-07-01-to-2026-07-02.csv").write_text(head + "pay ann,16,0\n")
    kinds = "case_id long, case_number string, task string, case_product_id int, completed_by string, complete_date timestamp_ntz, rejected string"
    history = spark.createDataFrame(
        [
            (1, "1", "t", 1, "7", datetime(2026, 7, 1, 9), "No"),
            (2, "2", "t", 1, "7", datetime(2026, 7, 2, 9), "No"),
            (3, "3", "t", 1, "7", datetime(2026, 7, 3, 9), "No"),
        ],
        kinds,
    )
    plan = spark.createDataFrame(
        [(k, "t", 1, "4", 1) for k in (1, 2, 3)],
        "case_id long, task string, case_product_id int, duration string, plan_id int",
    )
    staff = spark.createDataFrame(
        [("pay ann", 7, "Ann", "T", 1)],
        "payroll_name string, employee_id int, staff_name string, team string, training_plan int",
    )
    daily = str(tmp_path / "daily")
    options = {"daily_path": daily, "periods_path": str(tmp_path / "periods"), "calendar": BusinessCalendar(), "as_of": date(2026, 7, 3)}

    def stored():
        rows = S.read_history(spark, daily).orderBy("date").collect()
        return [(r.date.day, r.employee_id, r.team, float(r.tasks_duration_hours or 0), float(r.efficiency)) for r in rows]

    flows.upload_timesheets(
        spark, str(tmp_path / "t-*.csv"), history, plan, staff, plan_order=[F.col("plan_id").desc()], now=datetime(2026, 7, 3, 2), **options
    )
    assert stored() == [(1, 7, "T", 8.0, 50.0)]
    export = spark.createDataFrame(
        [("2026-06-30 00:00:00", "7.0", "Ann", "T", "80"), ("never", "7", "Ann", "T", "1")],
        "date string, employee_id string, staff_name string, team string, efficiency string",
    )
    assert flows.import_history(export, now=datetime(2026, 7, 3, 3), **options).published
    assert stored()[-1] == (30, 7, "T", 0.0, 80.0) or stored()[0] == (30, 7, "T", 0.0, 80.0)
    assert flows.rename_teams(spark, {"T": "U"}, now=datetime(2026, 7, 3, 4), **options).published
    assert {team for _, _, team, _, _ in stored()} == {"U"}
    moved = staff.withColumn("team", F.lit("V"))
    assert flows.reapply_employees(spark, moved, now=datetime(2026, 7, 3, 5), **options).published
    assert [team for _, _, team, _, _ in stored()] == ["V", "V"]
    assert S.read_current(spark, str(tmp_path / "periods")).first().team == "V"


def test_sync_twice(spark, tmp_path):
    lab = Lab(spark, FOLDER)
    staff = lab.employees().select(
        "employee_id",
        F.col("staff_name").alias("first_name"),
        F.lit(None).cast("string").alias("last_name"),
        F.col("team").alias("department"),
        F.lit("tech").alias("position"),
        F.lit(True).alias("active"),
        F.lit(None).cast("date").alias("hire_date"),
    )
    departments = spark.createDataFrame([(1, "BUILDING", True)], "department_id int, department_name string, active boolean")
    sources = {
        "statuses": lambda: lab.cases().select("status"),
        "departments": lambda: departments,
        "employees": lambda: staff,
        "customers": lab.customers,
        "cases": lab.cases,
        "case_tasks": lab.case_tasks,
        "case_task_history": lab.task_history,
    }
    root = str(tmp_path / "mirror")
    options = {"as_of": AS_OF}
    flows.sync_mirror(spark, sources, root, now=datetime(1998, 6, 15, 2), **options)

    def stored():
        return {n: sorted(map(str, flows.mirror_store(spark, root, n).read().collect())) for n in flows.SYNC_ORDER + flows.CHILDREN}

    before = stored()
    assert all(before[n] for n in ("statuses", "customers", "cases", "case_tasks"))
    folders = {n: flows.mirror_store(spark, root, n).files() for n in before}
    again = flows.sync_mirror(spark, sources, root, now=datetime(1998, 6, 16, 2), **options)
    # A night without changes writes no partition, and counts what it saw.
    assert {n: again[n].report.parts for n in before} == dict.fromkeys(before, ())
    assert {n: flows.mirror_store(spark, root, n).files() for n in before} == folders
    assert again["case_tasks"].rows == len(before["case_tasks"]) and again["case_tasks"].failed == 0
    assert before == stored()

    def down():
        raise RuntimeError("no connection")

    # One case turns out to have come in two months earlier: its own two months are written, and those of its tasks.
    recent = lab.cases().filter("date_in BETWEEN '1998-05-01' AND '1998-05-31' AND NOT deleted")
    late = recent.join(lab.case_tasks().select("case_id"), "case_id", "left_semi").agg(F.min("case_id")).first()[0]
    earlier = F.when(F.col("case_id") == late, F.col("date_in") - F.expr("INTERVAL 60 DAYS")).otherwise(F.col("date_in"))
    moved = {**sources, "departments": down, "cases": lambda: lab.cases().withColumn("date_in", earlier)}
    runs = flows.sync_mirror(spark, moved, root, now=datetime(1998, 6, 17, 2), **options)
    log = spark.read.parquet(f"{root}/sync_log")
    failed = log.filter("status = 'failed'").collect()
    assert [(r.sync_type, r.error) for r in failed] == [("departments", "no connection")]
    assert log.filter("status = 'completed'").count() == 20
    assert runs["cases"].report.moved == 1 and len(runs["cases"].report.parts) == 2
    assert runs["case_tasks"].report.parts == runs["cases"].report.parts
    assert runs["customers"].report.parts == ()
    now = stored()
    assert len(now["cases"]) == len(before["cases"]) and len(set(now["cases"]) - set(before["cases"])) == 1
    assert all(now[n] == before[n] for n in before if n != "cases")
