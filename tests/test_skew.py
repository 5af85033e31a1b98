"""One key holds two thirds of the rows: results stay whole, and the hot key is cut before the shuffle."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casewright.operators import cases as C
from casewright.operators import edits as Z
from casewright.operators import efficiency as E
from casewright.operators import pick as P

ROWS = 300_000
START = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    n = F.col("id")
    hot = n % 3 != 0
    return spark.range(ROWS, numPartitions=8).select(
        n,
        F.when(hot, 0).otherwise(n % 1000 + 1).alias("case_id"),
        F.when(hot, "7").otherwise((n % 50 + 100).cast("string")).alias("completed_by"),
        (F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=n)).alias("complete_date"),
        F.concat(F.lit("t"), (n % 4).cast("string")).alias("task"),
        F.lit("d").alias("department"),
        (n % 3).alias("case_product_id"),
        F.lit("No").alias("rejected"),
    )


def shuffled_rows(spark, df) -> int:
    """Rows written to shuffles while the frame is computed."""
    context = spark.sparkContext._jsc.sc()
    gateway = spark.sparkContext._gateway

    def total() -> int:
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(
            None,
            False,
            False,
            gateway.new_array(gateway.jvm.double, 0),
            gateway.jvm.java.util.ArrayList(),
        )
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    df.collect()
    return total() - before


def test_latest_task_of_a_hot_case(spark, skewed):
    latest = C.latest_tasks(skewed, ["complete_date", "id"])
    got = {r.case_id: r.last_scan for r in latest.collect()}
    want = {r.case_id: r.m for r in skewed.groupBy("case_id").agg(F.max("complete_date").alias("m")).collect()}
    assert got == want
    # At most one row per case and input partition travels.
    assert shuffled_rows(spark, latest) <= 8 * len(want)


def test_priority_pick_of_a_hot_case(spark, skewed):
    picked = P.priority_pick(skewed.withColumnRenamed("task", "category"), ["case_id"], priority=["t2"])
    rows = {r.case_id: r.category for r in picked.collect()}
    assert rows[0] == "t2" and len(rows) == skewed.select("case_id").distinct().count()
    assert shuffled_rows(spark, picked) <= 8 * len(rows)


def test_totals_of_a_hot_employee(spark, skewed):
    rows = skewed.withColumn("case_number", F.col("case_id").cast("string")).withColumn("duration", F.lit("0.5"))
    totals = E.employee_totals(rows)
    got = {r.employee_id: (r.cases_worked_on, r.tasks_completed, float(r.tasks_duration_hours)) for r in totals.collect()}
    assert got[7] == (1, 200_000, 100_000.0)
    assert sum(t for _, t, _ in got.values()) == ROWS
    assert shuffled_rows(spark, totals) < ROWS / 10


def test_edits_of_a_hot_key(spark, skewed):
    edits = skewed.select(
        F.col("case_id").alias("key"), F.col("task").alias("note"), F.col("complete_date").alias("at"), "id"
    )
    folded = Z.latest_edits(edits, "key", ["note"], "at", "id")
    got = {r.key: r.note for r in folded.collect()}
    last = max(k for k in range(ROWS) if k % 3 != 0)
    assert got["0"] == f"t{last % 4}" and len(got) == 1 + skewed.filter("case_id <> 0").select("case_id").distinct().count()
    assert shuffled_rows(spark, folded) <= 8 * len(got)
