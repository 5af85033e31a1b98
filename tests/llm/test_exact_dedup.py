"""Exact duplicates against grouping by text."""

from collections import defaultdict

import brute
from pyspark.sql import functions as F

from casewright.llm import exact_dedup

SCHEMA = "doc_id long, text string"
ROWS = [
    (1, "Same Text"), (5, "same text"), (3, "SAME TEXT"), (2, "same  text"), (4, None), (6, ""), (7, "É"), (8, "é"),
    (9, "x" * 100_000), (10, "X" * 100_000), (11, "x" * 99_999 + "y"),
]


def wanted(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[brute.lower(t)].append(i)
    return {i: (max(groups[brute.lower(t)]), len(groups[brute.lower(t)])) for i, t in rows}


def test_groups_keepers_and_digests(spark):
    got = exact_dedup.exact_duplicates(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == wanted(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert len({r.text_sha256 for r in got}) == len({brute.lower(t) for _, t in ROWS})


def test_bytes_decide_when_digests_meet(spark):
    """A digest of three values: everything collides, and the check of full bytes separates it again."""
    run = exact_dedup.ExactDedup(spark, digest=lambda text: (F.length(text) % 3).cast("string"))
    got = run.add(spark.createDataFrame(ROWS, SCHEMA)).documents().collect()
    assert {r.id: (r.keep_id, r.group_size) for r in got} == wanted(ROWS)


def test_state_goes_on_with_later_documents(spark):
    first, second = spark.createDataFrame(ROWS[:4], SCHEMA), spark.createDataFrame(ROWS[4:] + [(50, "same text")], SCHEMA)
    run = exact_dedup.ExactDedup(spark).add(first)
    assert {r.id for r in run.documents().where("kept").collect()} == {5, 2}
    run.add(second)
    rows = ROWS + [(50, "same text")]
    assert {r.id: (r.keep_id, r.group_size) for r in run.documents().collect()} == wanted(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.kept for r in got) == 2 and {(r.keep_id, r.group_size) for r in got} == {(1, 3), (None, 2)}
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "a", "p", 1), (2, "A", None, 2), (2, "A", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, n long")
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [rows[1]]
