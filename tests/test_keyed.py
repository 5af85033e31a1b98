"""Stores merged by key: which partitions a merge writes, and what it leaves alone."""

import os
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casewright.sources.keyed import KeyedStore, bucket_of, month_of

SCHEMA = "code string, day date, amount int"


def month():
    return month_of(F.col("day"))


def night(k):
    return datetime(2026, 7, k, 2)


def frame(spark, entries, schema=SCHEMA):
    return spark.createDataFrame(entries, schema)


def files(store):
    """Every data file under the store with its size and time."""
    out = {}
    for root, _, names in os.walk(store.folder.path):
        for name in names:
            if name.endswith(".parquet"):
                info = os.stat(os.path.join(root, name))
                out[os.path.join(root, name)] = info.st_size, info.st_mtime_ns
    return out


def content(store):
    return sorted(map(tuple, store.read().collect()), key=str)


@pytest.fixture
def filled(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "cases"), "code")
    entries = [(f"c{k}", date(2026, 1 + k % 6, 3), k) for k in range(60)]
    report = store.merge(frame(spark, entries), month(), now=night(1), stamp="at", unique=True)
    assert (report.inserted, report.changed, report.moved, report.rows, report.previous_rows) == (60, 0, 0, 60, 0)
    assert report.parts == tuple(f"2026-0{m}" for m in range(1, 7)) and store.parts() == dict.fromkeys(report.parts, 10)
    return store, entries


def test_unchanged_rows_write_nothing(spark, filled):
    store, entries = filled
    before, rows = files(store), content(store)
    report = store.merge(frame(spark, entries[::-1]), month(), now=night(2), stamp="at", unique=True)
    assert report.published and report.parts == report.buckets == () and report.rows == 60
    assert files(store) == before and content(store) == rows


def test_a_changed_row_writes_one_partition_a_late_one_two(spark, filled):
    store, entries = filled
    before = files(store)
    report = store.merge(frame(spark, [("c7", date(2026, 2, 3), 700)]), month(), now=night(2), stamp="at", unique=True)
    assert report.parts == ("2026-02",) and (report.inserted, report.changed, report.moved) == (0, 1, 0) and len(report.buckets) == 1
    assert files(store).items() >= before.items()
    stamps = {r.code: r["at"] for r in store.read().collect()}
    assert stamps["c7"] == night(2) and {v for k, v in stamps.items() if k != "c7"} == {night(1)}
    # It came in two months later than was said, and its day moves.
    report = store.merge(frame(spark, [("c7", date(2026, 4, 30), 700)]), month(), now=night(3), stamp="at", unique=True)
    assert report.parts == ("2026-02", "2026-04") and report.moved == 1 and report.rows == 60
    assert store.parts()["2026-02"] == 9 and store.parts()["2026-04"] == 11
    assert [r[:3] for r in content(store) if r[0] == "c7"] == [("c7", date(2026, 4, 30), 700)]
    # Nothing but the touched partitions is read from new folders.
    new = {f for f in store.files() if f.startswith("d_20260703")}
    assert {f.split("=")[1] for f in new} == {"2026-02", "2026-04"}


def test_a_partition_that_empties_goes(spark, filled):
    store, entries = filled
    moved = [(c, date(2026, 12, 1), a) for c, d, a in entries if d.month == 5]
    report = store.merge(frame(spark, moved), month(), now=night(2), stamp="at", unique=True)
    assert report.moved == 10 and "2026-05" not in store.parts() and store.parts()["2026-12"] == 10
    assert store.merge(frame(spark, moved), month(), now=night(3), stamp="at", unique=True).parts == ()


def test_groups_of_several_rows(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "children"), "case_id")
    schema, part = "case_id long, task string, month string", F.col("month")

    def merge(entries, k):
        return store.merge(frame(spark, entries, schema), part, now=night(k), drop=["month"])

    first = [(1, "a", "m1"), (1, "b", "m1"), (1, "b", "m1"), (2, "a", "m1"), (3, None, "m2"), (None, "x", "m9")]
    assert merge(first, 1).rows == 5 and store.parts() == {"m1": 4, "m2": 1}
    assert merge([first[1], first[2], first[0], first[4]], 2).parts == ()
    # One of two equal rows less; a parent that moves takes all its rows along; others stay.
    report = merge([(1, "a", "m1"), (1, "b", "m1"), (3, None, "m3")], 3)
    assert report.parts == ("m1", "m2", "m3") and (report.changed, report.moved) == (1, 1)
    assert content(store) == [(1, "a"), (1, "b"), (2, "a"), (3, None)]
    with pytest.raises(PySparkException, match="two partitions for key 2"):
        merge([(2, "a", "m1"), (2, "b", "m2")], 4)
    assert content(store) == [(1, "a"), (1, "b"), (2, "a"), (3, None)]


def test_null_partitions_repeated_and_missing_keys(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "code")
    rows = [("a", None, 1), (None, None, 2), ("b'/ é", date(2026, 1, 1), None)]
    assert store.merge(frame(spark, rows), month(), now=night(1)).rows == 2
    assert store.parts() == {"none": 1, "2026-01": 1}
    assert store.merge(frame(spark, rows), month(), now=night(2)).parts == ()
    odd = KeyedStore(spark, str(tmp_path / "odd"), "code")
    odd.merge(frame(spark, rows), F.concat(F.col("code"), F.lit(":%=/x")), now=night(1))
    assert odd.parts() == {"a:%=/x": 1, "b'/ é:%=/x": 1} and len(content(odd)) == 2
    assert odd.merge(frame(spark, rows), F.concat(F.col("code"), F.lit(":%=/x")), now=night(2)).parts == ()
    with pytest.raises(PySparkException, match="repeated key a"):
        store.merge(frame(spark, [("a", None, 1), ("a", None, 1)]), month(), now=night(3), unique=True)
    empty = KeyedStore(spark, str(tmp_path / "empty"), "code")
    assert not empty.exists() and empty.merge(frame(spark, []), month(), now=night(1)).rows == 0
    assert empty.read().count() == 0 and empty.merge(frame(spark, rows), month(), now=night(2)).rows == 2
    with pytest.raises(FileNotFoundError):
        KeyedStore(spark, str(tmp_path / "nothing"), "code").read()


def test_new_columns_are_added_and_none_may_go(spark, filled):
    store, _ = filled
    wider = spark.createDataFrame([("c1", date(2026, 2, 3), 1, "x")], SCHEMA + ", zip string")
    assert store.merge(wider, month(), now=night(2), stamp="at").parts == ("2026-02",)
    assert {r.code: r.zip for r in store.read().filter("code IN ('c1', 'c2')").collect()} == {"c1": "x", "c2": None}
    with pytest.raises(ValueError, match="rows lack zip"):
        store.merge(frame(spark, [("c1", date(2026, 2, 3), 5)]), month(), now=night(3), stamp="at")


def test_a_merge_that_dies_leaves_the_store_as_it_was(spark, filled, monkeypatch):
    store, entries = filled
    rows = content(store)
    for first in (True, False):
        fresh = store if not first else KeyedStore(spark, store.folder.path + "-first", "code")
        monkeypatch.setattr(fresh.folder, "write_text", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            fresh.merge(frame(spark, [("c1", date(2026, 1, 1), 9)]), month(), now=night(2), stamp="at")
        monkeypatch.undo()
        again = KeyedStore(spark, fresh.folder.path, "code")
        assert again.exists() != first and (first or content(again) == rows)
        # The same run once more.
        assert again.merge(frame(spark, [("c1", date(2026, 1, 1), 9)]), month(), now=night(2), stamp="at").inserted == first
        assert ("c1", date(2026, 1, 1), 9, night(2)) in content(again)


def test_old_versions_are_pruned_and_readers_keep_theirs(spark, filled):
    store, entries = filled
    old = store.read()
    for k in range(2, 6):
        store.merge(frame(spark, [("c0", date(2026, 1, 3), 100 + k)]), month(), now=night(k), stamp="at", keep=2)
        if k == 2:
            assert old.count() == 60
    lists = [n for n in store.folder.children() if n.startswith("m_")]
    assert len(lists) == 2 and len(content(store)) == 60
    folders = {n for n in store.folder.children() if n.startswith("d_")}
    assert len(folders) == 3  # the first one, for five months, and the newest two
    assert sorted(os.listdir(f"{store.folder.path}/{min(folders)}")).count("in=2026-01") == 0


def test_dealt_partitions(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "dealt"), "code")
    entries = [(f"k{n}", None, n) for n in range(300)]
    part = bucket_of(F.col("code"))
    assert len(store.merge(frame(spark, entries), part, now=night(1)).parts) == 16
    assert len(store.merge(frame(spark, [("k5", None, 0)]), part, now=night(2)).parts) == 1
    assert sum(store.parts().values()) == 300
