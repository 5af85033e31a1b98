"""Streams over finite input give the answer of their batch form, late and out-of-order rows included."""

import random
import threading
import time
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from casewright import vocabulary as V
from casewright.functions.calendar import BusinessCalendar
from casewright.operators.tasks import explode_windows
from casewright.sources.stores import Folder, read_current
from casewright.streaming import refresh, scans

KINDS = "case_number string, task string, completed_by string, complete_date timestamp_ntz, closed boolean"
START = datetime(2026, 7, 1, 6)


def write_batches(spark, folder, batches):
    """One file per batch, in order of arrival."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(f"{folder}/b{k:02d}")


def stream(spark, folder):
    return (
        spark.readStream.schema(KINDS)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(folder)
    )


def run_to_end(df, mode, path, name):
    query = (
        df.writeStream.outputMode(mode)
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return df.sparkSession.table(name)


def test_hourly_counts(spark, tmp_path):
    random.seed(7)
    rows = [
        (f"c{k % 5}", f"t{k % 2}", f"e{k % 3}", START + timedelta(minutes=random.randrange(600)), False)
        for k in range(300)
    ]
    random.shuffle(rows)
    # A last far event closes every hour before it.
    batches = [rows[:100], rows[100:200], rows[200:], [("end", "t", "e", START + timedelta(days=3), False)]]
    write_batches(spark, str(tmp_path / "in"), batches)
    out = run_to_end(
        scans.hourly_counts_stream(stream(spark, str(tmp_path / "in")), delay="12 hours"),
        "append",
        str(tmp_path / "cp"),
        "hourly",
    )
    batch = scans.hourly_counts(spark.createDataFrame(rows, KINDS))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
    windows = [("noon", 3, 12), ("pm3", 3, 15)]
    rolled = scans.roll_up_windows(out, windows)
    direct = (
        explode_windows(spark.createDataFrame(rows, KINDS), "complete_date", windows)
        .groupBy(F.to_date("complete_date").alias("day"), "window", "completed_by", "task")
        .agg(F.count("*").alias("n"))
    )
    assert sorted(map(tuple, rolled.collect())) == sorted(map(tuple, direct.collect()))


def test_scan_alarms(spark, tmp_path):
    def at(hours):
        return START + timedelta(hours=hours)

    batches = [
        [("a", "t", "e", at(0), False), ("b", "t", "e", at(0), False), ("c", "t", "e", at(0), False)],
        # 'a' is scanned again, 'c' is closed, a late scan of 'b' changes nothing.
        [("a", "t", "e", at(3), False), ("c", "t", "e", at(1), True), ("b", "t", "e", at(-0.5), False)],
        # A scan of 'c' that arrives after its closing starts no timer; the rest moves the watermark.
        [("x", "t", "e", at(3.5), False), ("c", "t", "e", at(0.9), False), ("c", "t", "e", at(2.9), False)],
        [("y", "t", "e", at(30), False)],
        [("z", "t", "e", at(31), False)],
    ]
    write_batches(spark, str(tmp_path / "in"), batches)
    out = run_to_end(
        scans.scan_alarm_stream(stream(spark, str(tmp_path / "in")), hours=4, delay="1 hour"),
        "append",
        str(tmp_path / "cp"),
        "alarms",
    )
    got = sorted((r.case_number, r.last_scan, r.alarm_at) for r in out.collect())
    assert got == [("a", at(3), at(7)), ("b", at(0), at(4)), ("x", at(3.5), at(7.5))]
    history = spark.createDataFrame([r for rows in batches for r in rows], KINDS)
    stale = scans.stale_cases(history, at(29), hours=4).collect()
    assert {(r.case_number, r.last_scan) for r in stale} == {(n, s) for n, s, _ in got}


def test_latest_scans_keep_open_cases_only(spark, tmp_path):
    hour = timedelta(hours=1)
    cases = [f"c{k}" for k in range(20)]
    batches = [
        [(c, "t", "e", START, False) for c in cases],
        [(c, "t", "e", START - hour, False) for c in cases],
        [(c, "t", "e", START + hour, k < 15) for k, c in enumerate(cases)],
        # Time goes on: what closed leaves the state, what is open stays.
        [("later", "t", "e", START + 40 * hour, False)],
        [("later", "t", "e", START + 41 * hour, False)],
    ]
    write_batches(spark, str(tmp_path / "in"), batches)
    folder = str(tmp_path / "cp")
    query = (
        scans.latest_scans_stream(stream(spark, str(tmp_path / "in")))
        .writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", folder).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    out = spark.table("latest").filter("case_number <> 'later'").collect()
    # Older scans gave no row.
    assert sorted((r.case_number, r.last_scan.replace(tzinfo=None), r.closed) for r in out) == sorted(
        [(c, START, False) for c in cases] + [(c, START + hour, k < 15) for k, c in enumerate(cases)]
    )
    rows = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(rows) > rows[-1]


def test_refresh_isolates_failures(spark, tmp_path):
    write_batches(spark, str(tmp_path / "in"), [[("a", "t", "e", START, False)]])
    root = str(tmp_path / "out")

    def broken():
        raise RuntimeError("no source")

    results = {"broken": broken, "good": lambda: spark.range(3)}
    writer = refresh.refresh_on_arrival(
        stream(spark, str(tmp_path / "in")), results, root, checkpoint=str(tmp_path / "cp")
    )
    query = writer.start()
    query.awaitTermination(240)
    assert query.exception() is None
    assert read_current(spark, f"{root}/good").count() == 3
    assert not Folder(spark, f"{root}/broken").exists()
    again = refresh.refresh_results({"good": lambda: spark.range(0)}, root, now=datetime(2030, 1, 1))
    assert not again["good"].published and read_current(spark, f"{root}/good").count() == 3


def test_results_side_by_side(spark, tmp_path):
    """Results overlap, a failing one fails alone, a hanging one is cancelled, and shared inputs are written once."""
    root, gate, seen = str(tmp_path / "out"), threading.Barrier(3, timeout=120), []

    def meets(tables):
        gate.wait()
        return tables["numbers"].select("n")

    def numbers():
        seen.append(1)
        return spark.range(50).withColumnRenamed("id", "n")

    def broken(tables):
        raise RuntimeError("no source")

    def hangs(tables):
        return spark.range(8, numPartitions=2).select(sleeping(F.col("id")))

    sleeping = F.udf(lambda k: (time.sleep(600), k)[1], "long")
    results = {"a": meets, "b": meets, "c": meets, "broken": broken, "hangs": hangs}
    start = time.monotonic()
    got = refresh.refresh_results(results, root, now=datetime(2026, 7, 1), workers=5, timeout=45, shared={"numbers": numbers})
    assert time.monotonic() - start < 200
    assert [got[n].rows for n in "abc"] == [50] * 3 and seen == [1]
    assert str(got["broken"]) == "no source" and isinstance(got["hangs"], Exception)
    assert read_current(spark, f"{root}/a").count() == 50 and not [n for n in Folder(spark, f"{root}/hangs").children() if n.startswith("v_")]
    assert spark.range(10).count() == 10


def test_snapshot_on_business_days_only(spark, tmp_path):
    write_batches(spark, str(tmp_path / "in"), [[("a", "t", "e", START, False)]])
    path = str(tmp_path / "noon")

    def build(day: date):
        return spark.createDataFrame([(day, "t", "n", 1)], "data_date date, team string, name string, n int")

    for k, clock in enumerate([datetime(2026, 7, 1, 12), datetime(2026, 7, 4, 12), datetime(2026, 7, 1, 15)]):
        writer = refresh.snapshot_on_arrival(
            stream(spark, str(tmp_path / "in")),
            build,
            path,
            BusinessCalendar(),
            clock=lambda clock=clock: clock,
            checkpoint=str(tmp_path / f"cp{k}"),
        )
        query = writer.start()
        query.awaitTermination(240)
        assert query.exception() is None
    assert [r.data_date for r in spark.read.parquet(path).collect()] == [date(2026, 7, 1)]
    assert V.SNAPSHOT_WINDOWS[0][0] == "noon"
