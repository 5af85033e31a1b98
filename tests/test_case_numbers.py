"""Cases that share a number are one row in the case lists."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from casewright.functions.calendar import BusinessCalendar
from casewright.operators import cases as C
from casewright.operators import tasks as T
from casewright.operators import workload as W

MONDAY = date(2026, 7, 6)
CALENDAR = BusinessCalendar()
CASES = "case_id long, case_number string, status string, ship_date timestamp_ntz, last_location_id int, pan_number string"
TASKS = "case_id long, task string, complete_date timestamp_ntz, case_product_id int, part_id int, source_id int, department string"


def at(day, hour=0):
    return datetime(2026, 7, day, hour)


def cases_of(spark, rows):
    df = spark.createDataFrame(rows, CASES)
    more = {"due_date": F.col("ship_date"), "create_date": F.col("ship_date"), "local_delivery": F.lit(False)}
    more |= {"customer_id": F.lit("c"), "doctor_name": F.concat(F.lit("Dr "), F.col("case_id").cast("string"))}
    return df.withColumns(more)


@pytest.fixture
def lab(spark):
    return {
        "case_tasks": spark.createDataFrame(
            [
                (1, "late", at(3, 9), 1, 1, 1, "d1"), (2, "early", at(2), 1, 1, 1, "d2"), (2, "open", None, 2, 1, 1, "d2"),
                (3, "same", at(3), 1, 1, 1, "d3"), (4, "same too", at(3), 1, 1, 1, "d4"), (5, "alone", None, 1, 1, 1, "d5"),
                (6, "alone too", at(1), 1, 1, 1, "d6"), (8, "old", at(5), 1, 1, 1, "d8"), (9, "new", at(4), 1, 1, 1, "d9"),
            ],
            TASKS,
        ),
        "locations": spark.createDataFrame([(1, "QC"), (2, "Design Cart")], "id int, description string"),
    }


ROWS = [
    (1, "A", "In Production", at(8), 1, "11"), (2, "A", "In Production", at(9), 2, "12"), (3, "B", "In Production", at(8), 1, "13"),
    (4, "B", "In Production", at(9), 2, "14"), (5, None, "In Production", at(8), 1, "15"), (6, None, "In Production", at(8), 2, "16"),
    (7, "C", "In Production", at(8), 1, "17"), (8, "D", "In Production", datetime(2026, 5, 1), 1, "18"), (9, "D", "In Production", at(8), 2, "19"),
]


def test_latest_task_and_best_category_of_a_number(spark, lab):
    lines = spark.createDataFrame([(1, 10), (2, 20), (2, 99), (3, 30), (9, 20)], "case_id long, product_id long")
    products = spark.createDataFrame([(10, "Metal"), (20, "Hybrid"), (30, None)], "product_id long, category string")
    got = C.open_case_list(cases_of(spark, ROWS), lab["case_tasks"], lab["locations"], lines, products, as_of=MONDAY)
    rows = {r.case_id: (r.case_number, r.pan_number, r.category, r.location, r.last_task, r.last_scan) for r in got.collect()}
    assert rows == {
        # The case with the newest task is shown; the category comes from the other case of the number.
        1: ("A", "11", "Hybrid", "QC", "late", at(3, 9)),
        # Of two tasks of one time the larger case id wins.
        4: ("B", "14", "Other", "Design Cart", "same too", at(3)),
        # Cases without a number stand alone; a case without tasks is left out.
        5: (None, "15", "Other", "QC", "alone", None),
        6: (None, "16", "Other", "Design Cart", "alone too", at(1)),
        # D is shown by case 8, which shipped too long ago: the date filters after the pick.
    }


def test_department_of_the_latest_task_of_a_number(spark, lab):
    got = C.open_case_list_by_department(cases_of(spark, ROWS), lab["case_tasks"], lab["locations"])
    assert {r.case_id: (r.category, r.last_task) for r in got.collect()} == {
        1: ("d1", "late"), 4: ("d4", "same too"), 5: ("d5", "alone"), 6: ("d6", "alone too"), 8: ("d8", "old"),
    }


def test_airway_looks_at_the_location_after_the_pick(spark, lab):
    rows = [*ROWS, (10, "E", "Cancelled", at(8), 2, "20"), (11, "E", "On Hold", at(8), 2, "21")]
    customers = spark.createDataFrame([("c", "Practice")], "customer_id string, practice_name string")
    got = C.airway_workflow(cases_of(spark, rows), lab["case_tasks"], lab["locations"], customers, CALENDAR, stages=["Design Cart"])
    assert {(r.case_number, r.doctor_name, r.last_task) for r in got.collect()} == {
        # Case 2 is in the stage, but case 1 of the same number has the newer task elsewhere.
        ("B", "Dr 4", "same too"), (None, "Dr 6", "alone too"), ("E", "Dr 11", None),
    }
    # Case 9 is in the stage as well, and case 8 of its number, elsewhere, has the newer task.
    assert "D" not in {r.case_number for r in got.collect()}


def test_workload_has_one_row_per_number_and_date(spark, lab):
    rows = [
        (1, "A", "In Production", at(7), 1, "11"), (2, "A", "Invoiced", at(7), 2, "12"), (3, "A", "In Production", at(8), 1, "13"),
        (4, "A", "In Production", at(7), 1, "14"), (5, "A", "In Production", at(7), 1, "15"), (6, None, "Invoiced", at(7), 1, "16"),
        (7, None, "Invoiced", at(7), 1, "17"), (8, "B", "Invoiced", at(7), 1, "18"), (9, "B", "Invoiced", at(7), 1, "19"),
    ]
    lines = [(1, 10), (2, 20), (3, 10), (5, 40), (6, 10), (7, 10), (8, 10), (9, 10)]
    products = spark.createDataFrame([(10, "Metal"), (20, "Hybrid"), (40, "Airway")], "product_id long, category string")
    args = (spark.createDataFrame(lines, "case_id long, product_id long"), products, lab["locations"], CALENDAR)
    got = W.workload_detail(cases_of(spark, rows), *args, as_of=MONDAY)
    assert {r.case_id: (r.category, r.status, r.location) for r in got.collect()} == {
        2: ("Hybrid", "Invoiced", "Design Cart"),  # the best line of the number on that day
        3: ("Metal", "In Production", "QC"),  # another day
        4: ("Other", "In Production", "QC"),  # no products: on its own
        6: ("Metal", "Invoiced", "QC"),  # no number: on their own
        7: ("Metal", "Invoiced", "QC"),
        9: ("Metal", "Invoiced", "QC"),  # equal lines: the larger id
    }


def test_accepted_cases_count_in_the_category_of_their_number(spark):
    rows = [(1, "A", "In Production", at(7), 1, "x"), (2, "A", "Invoiced", at(7), 1, "x"), (3, "A", "Invoiced", at(8), 1, "x"), (4, "A", "On Hold", at(7), 1, "x")]
    lines = spark.createDataFrame([(1, 10), (2, 20), (4, 30)], "case_id long, product_id long")
    products = spark.createDataFrame([(10, "Metal"), (20, "Hybrid"), (30, "Hybrid")], "product_id long, category string")
    audit = spark.createDataFrame(
        [(k, "u", "Accept Remote Case", at(5, 3)) for k in (1, 1, 3, 4, 77)] + [(2, "u", "Edited", at(5))],
        "case_id long, created_by string, type string, create_date timestamp_ntz",
    )
    got = T.cases_by_operator(audit, cases_of(spark, rows), lines, products, as_of=MONDAY)
    assert {(r.category, r.n) for r in got.collect()} == {("Hybrid", 2), ("Other", 1), (None, 1)}


def test_a_number_with_very_many_cases(spark, lab):
    many = spark.range(200_000).select(
        F.col("id").alias("case_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("case_number"),
        F.lit("In Production").alias("status"), F.lit(at(8)).alias("ship_date"), F.lit(1).alias("last_location_id"), F.lit("1").alias("pan_number"),
    ).withColumns({"due_date": F.col("ship_date"), "local_delivery": F.lit(False)})
    tasks = many.select(
        "case_id", F.lit("t").alias("task"), F.lit(at(1)).alias("complete_date"), *[F.lit(1).alias(c) for c in ("case_product_id", "part_id", "source_id")],
        F.lit("d").alias("department"),
    )
    lines = many.select("case_id", (F.col("case_id") % 2).alias("product_id"))
    products = spark.createDataFrame([(0, "Clear"), (1, "Metal")], "product_id long, category string")
    got = C.open_case_list(many, tasks, lab["locations"], lines, products, as_of=MONDAY)
    hot = got.filter("case_number = 'hot'").collect()
    assert [(r.case_id, r.category) for r in hot] == [(199_998, "Metal")]
    assert got.count() == 1 + 200_000 - len(range(0, 200_000, 3))
