"""Recurring work driven by streams: result refresh and intraday snapshots."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from datetime import date, datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from casewright.functions.calendar import BusinessCalendar
from casewright.session import checkpoint_root
from casewright.sources.stores import WriteReport, guarded_write, upsert_snapshot
from casewright.sources.working import working_table

log = logging.getLogger(__name__)


#: Seconds that a cancelled result has to come to its end.
GRACE = 30


def refresh_results(
    results: Mapping[str, Callable[..., DataFrame]],
    root: str,
    *,
    now: datetime,
    keep: int = 7,
    workers: int = 4,
    timeout: float | None = None,
    shared: Mapping[str, Callable[[], DataFrame]] | None = None,
) -> dict[str, WriteReport | Exception]:
    """Recompute every named result and publish it; a failing one keeps its last good version.

    At most ``workers`` results run side by side, each in a job group and a scheduler pool of its own. One that takes
    more than ``timeout`` seconds has its jobs cancelled and counts as failed. With ``shared`` inputs every one of them is
    written once, and each result is built from the mapping of the written tables.
    """
    if not results:
        return {}
    session = SparkSession.active()
    tables = {name: working_table(build(), f"shared-{name}") for name, build in (shared or {}).items()}
    run_id, started, lock = uuid.uuid4().hex[:8], {}, threading.Lock()

    def refreshed(name: str) -> WriteReport:
        context = session.sparkContext
        context.setJobGroup(f"refresh-{run_id}-{name}", f"refresh {name}", interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", name)
        with lock:
            started[name] = time.monotonic()
        build = results[name]
        return guarded_write(build(tables) if shared else build(), f"{root.rstrip('/')}/{name}", now=now, keep=keep)

    pool = ThreadPoolExecutor(max_workers=workers, thread_name_prefix="refresh")
    pending: dict[Future, str] = {pool.submit(inheritable_thread_target(session)(refreshed), name): name for name in results}
    outcome: dict[str, WriteReport | Exception] = {}
    cancelled: dict[str, float] = {}
    while pending:
        done, _ = wait(pending, timeout=0.5, return_when=FIRST_COMPLETED)
        for future in done:
            name, error = pending.pop(future), future.exception()
            if error is not None and not isinstance(error, Exception):
                raise error
            if name in cancelled and error is not None:
                error = TimeoutError(f"{name} took more than {timeout} s")
            if error is not None:
                log.error("result %s not refreshed", name, exc_info=error)
            outcome[name] = error or future.result()
        for future, name in list(pending.items()):
            since = started.get(name)
            if timeout is None or since is None:
                continue
            if name not in cancelled and time.monotonic() - since > timeout:
                cancelled[name] = time.monotonic()
                session.sparkContext.cancelJobGroup(f"refresh-{run_id}-{name}")
            elif name in cancelled and time.monotonic() - cancelled[name] > GRACE:
                # It hangs outside a job; the others are not held up by it.
                del pending[future]
                outcome[name] = TimeoutError(f"{name} took more than {timeout} s and did not stop")
    pool.shutdown(wait=False)
    return {name: outcome[name] for name in results}


def refresh_on_arrival(
    arrivals: DataFrame,
    results: Mapping[str, Callable[[], DataFrame]],
    root: str,
    *,
    clock: Callable[[], datetime] = datetime.now,
    checkpoint: str | None = None,
    interval: str | None = None,
) -> DataStreamWriter:
    """Refresh all results for every batch of newly arrived source files.

    Give ``interval`` (such as '60 seconds') for a running service; without it the available files
    are worked off once.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        refresh_results(results, root, now=clock())

    return _writer(arrivals, each_batch, "refresh", checkpoint, interval)


def snapshot_on_arrival(
    arrivals: DataFrame,
    build: Callable[[date], DataFrame],
    path: str,
    calendar: BusinessCalendar,
    *,
    clock: Callable[[], datetime] = datetime.now,
    keep_days: int = 7,
    checkpoint: str | None = None,
    interval: str | None = None,
) -> DataStreamWriter:
    """Upsert the day's snapshot on business days (T02); a repeated batch rewrites the same partition."""

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        today = clock().date()
        if calendar.is_business_day(today):
            upsert_snapshot(build(today), path, as_of=today, sort=["team", "name"], keep_days=keep_days)

    return _writer(arrivals, each_batch, "snapshot", checkpoint, interval)


def _writer(
    arrivals: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    name: str,
    checkpoint: str | None,
    interval: str | None,
) -> DataStreamWriter:
    spark: SparkSession = arrivals.sparkSession
    folder = checkpoint or f"{checkpoint_root(spark)}/streams/{name}"
    writer = arrivals.writeStream.foreachBatch(each_batch).option("checkpointLocation", folder)
    if interval:
        return writer.trigger(processingTime=interval)
    return writer.trigger(availableNow=True)
