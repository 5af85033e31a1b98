"""Latest scan per case and task counts per hour: batch form and streaming form."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casewright.functions.calendar import wall_clock
from casewright.operators.tasks import explode_windows

ALARM_SCHEMA = "case_number string, last_scan timestamp, alarm_at timestamp"


def latest_scans(history: DataFrame) -> DataFrame:
    """Newest scan per case, reduced before the shuffle."""
    return history.groupBy("case_number").agg(F.max("complete_date").alias("last_scan"))


def stale_cases(history: DataFrame, now: datetime, *, hours: int = 4) -> DataFrame:
    """Open cases whose newest scan up to ``now`` is older than the given hours.

    A case with a row marked ``closed``, where the history has that column, is not open.
    """
    seen = history.filter(F.col("complete_date") <= wall_clock(now))
    closed = F.bool_or("closed") if "closed" in history.columns else F.lit(False)
    newest = seen.groupBy("case_number").agg(F.max("complete_date").alias("last_scan"), closed.alias("closed"))
    limit = wall_clock(now - timedelta(hours=hours))
    return newest.filter((F.col("last_scan") < limit) & ~F.coalesce("closed", F.lit(False))).select("case_number", "last_scan")


def hourly_counts(history: DataFrame) -> DataFrame:
    """Task rows per employee, task and hour."""
    midnight = F.to_date("complete_date").cast("timestamp_ntz")
    hour = midnight + F.make_dt_interval(hours=F.hour("complete_date"))
    return history.groupBy(hour.alias("hour"), "completed_by", "task").agg(F.count("*").alias("n"))


def roll_up_windows(hourly: DataFrame, windows: list[tuple[str, int, int]]) -> DataFrame:
    """Hourly counts summed to named time-of-day windows with whole-hour bounds."""
    rows = explode_windows(hourly, "hour", windows).withColumn("day", F.to_date("hour"))
    return rows.groupBy("day", "window", "completed_by", "task").agg(F.sum("n").alias("n"))


# -- streaming forms -------------------------------------------------------------------------------


def hourly_counts_stream(history: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """As ``hourly_counts`` over a stream; an hour is final once the watermark has passed it."""
    events = history.withColumn("complete_date", F.col("complete_date").cast("timestamp"))
    return (
        events.withWatermark("complete_date", delay)
        .groupBy(F.window("complete_date", "1 hour"), "completed_by", "task")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "completed_by", "task", "n")
    )


class ScanTimer(StatefulProcessor):
    """Newest scan of one case and an event-time timer ``hours`` after it.

    A late scan never moves the newest scan back. A closing status leaves a mark until the watermark has passed it,
    so that a scan which arrives after it starts no timer; then the case's state goes.
    """

    def __init__(self, hours: int):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ts timestamp, closed boolean")

    def _drop_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, closed = None, False
        for batch in rows:
            top = batch["complete_date"].max()
            latest = top if latest is None or top > latest else latest
            closed = closed or bool(batch["closed"].any())
        known, was_closed = self.newest.get() if self.newest.exists() else (None, False)
        closed = closed or was_closed
        if known is None or latest > pd.Timestamp(known) or closed != was_closed:
            newest = latest if known is None else max(latest, pd.Timestamp(known))
            self._drop_timers()
            self.newest.update((newest.to_pydatetime(), closed))
            due = newest if closed else newest + pd.Timedelta(hours=self.hours)
            self.handle.registerTimer(int(due.timestamp() * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, closed = self.newest.get()
        if closed:
            self.newest.clear()
            return
        newest = pd.Timestamp(newest)
        due = newest + pd.Timedelta(hours=self.hours)
        yield pd.DataFrame(
            {"case_number": [key[0]], "last_scan": [newest], "alarm_at": [due]}
        )

    def close(self) -> None:
        pass


def scan_alarm_stream(history: DataFrame, *, hours: int = 4, delay: str = "1 hour") -> DataFrame:
    """One alarm per case and silent stretch, once event time passes the newest scan by ``hours``.

    ``history`` needs case_number, complete_date and a boolean ``closed``. Needs the RocksDB state
    store; state holds one timestamp per open case.
    """
    events = history.select(
        "case_number", F.col("complete_date").cast("timestamp").alias("complete_date"), "closed"
    ).withWatermark("complete_date", delay)
    return events.groupBy("case_number").transformWithStateInPandas(
        statefulProcessor=ScanTimer(hours),
        outputStructType=ALARM_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )


LATEST_SCHEMA = "case_number string, last_scan timestamp, closed boolean"


class LatestScan(StatefulProcessor):
    """Newest scan of one case; a row whenever it moves or the case closes.

    The state of a case goes once the watermark has passed its closing, and that of a case without scans once it has
    passed the newest one by ``days``.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ts timestamp, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, was_closed = self.newest.get() if self.newest.exists() else (None, False)
        newest = None if known is None else pd.Timestamp(known)
        latest, closed = newest, was_closed
        for batch in rows:
            top = batch["complete_date"].max()
            latest = top if latest is None or top > latest else latest
            closed = closed or bool(batch["closed"].any())
        if latest == newest and closed == was_closed:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.newest.update((latest.to_pydatetime(), closed))
        due = latest if closed else latest + pd.Timedelta(days=self.days)
        self.handle.registerTimer(int(due.timestamp() * 1000) + 1)
        yield pd.DataFrame({"case_number": [key[0]], "last_scan": [latest], "closed": [closed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_scans_stream(history: DataFrame, *, delay: str = "1 hour", idle_days: int = 180) -> DataFrame:
    """Newest scan per case as updates (T04): the newest row of a case counts.

    ``history`` needs case_number, complete_date and a boolean ``closed``. Needs the RocksDB state store; state holds one
    timestamp per case that is open, or closed within ``delay``. A scan that comes later than that starts a case anew.
    """
    events = history.select(
        "case_number", F.col("complete_date").cast("timestamp").alias("complete_date"), F.coalesce("closed", F.lit(False)).alias("closed")
    )
    return (
        events.filter("complete_date IS NOT NULL")
        .withWatermark("complete_date", delay)
        .groupBy("case_number")
        .transformWithStateInPandas(
            statefulProcessor=LatestScan(idle_days), outputStructType=LATEST_SCHEMA, outputMode="Update", timeMode="EventTime"
        )
    )
