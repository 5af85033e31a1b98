"""Near-duplicates against all pairs on full sets."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from casewright.llm import near_dedup

SCHEMA = "doc_id long, text string"


def result(spark, rows, schema=SCHEMA):
    return near_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()


def family(rng, size, words=60, edits=2):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        yield " ".join(own)


def test_families_that_straddle_the_threshold(spark, monkeypatch):
    # Small blocks, so that long lists are dealt out by pairs of blocks.
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(near_dedup, "PIVOT_ROWS", 16)
    rng = random.Random(3)
    texts = [t for size, edits in ((150, 4), (40, 2), (30, 6), (2, 1)) for t in family(rng, size, edits=edits)]
    texts += [f"lone {k} " + " ".join(f"y{rng.randrange(9999)}" for _ in range(30)) for k in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    wanted = brute.near_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, rows)} == wanted


def test_blank_short_null_and_repeated(spark):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one"), (7, "a b c d e"), (7, "a b c d e"),
        (None, "a b c d e"), (None, "alone with no id at all"), (8, "ß b c d e f"), (9, "b c d e f g"),
    ]
    got = sorted(map(tuple, result(spark, rows)), key=str)
    wanted = [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
        (7, 1, 7, True), (7, 1, 7, True), (None, 1, 7, False), (None, 2, None, True), (8, 2, 8, True), (9, 2, 9, True),
    ]
    assert got == sorted(wanted, key=str)


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, []) == []
    rows = [(1, "a b c d e f", "x", 5), (2, "a b c d e f", "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, place long").withColumnRenamed("place", "size")
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [rows[0]]


def test_one_row_of_a_component_stays(spark):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (2, "z"), (9, None), (9, None)]
    left = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, "A b c d e f"), (2, "z"), (9, None), (9, None)]


def test_very_long_text(spark):
    text = " ".join(f"v{k}" for k in range(120_000))
    rows = [(1, text), (2, text + " end"), (3, "v1 v2 v3")]
    assert {r.doc_id: r.component_id for r in result(spark, rows)} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("common", [0, 50])
def test_common_values_change_no_result(spark, monkeypatch, common):
    monkeypatch.setattr(near_dedup, "COMMON_VALUES", common)
    monkeypatch.setattr(near_dedup, "COMMON_IN_PART", 2)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wanted = brute.near_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == wanted


def test_cells_are_handed_on_by_bytes(monkeypatch):
    monkeypatch.setattr(near_dedup, "HELD_BYTES", 20_000)
    rows = [{"key": k // 30, "i": 0, "j": 0, "node": k, "text": "x" * 500} for k in range(600)]
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 7]) for k in range(0, 600, 7)]
    got = list(near_dedup.by_cell(lambda batch: batch)(iter(batches)))
    assert [n for b in got for n in b.column("node").to_pylist()] == list(range(600))
    assert len(got) > 5 and all(b.column("node")[0].as_py() % 30 == 0 for b in got)
    assert all(b.schema.field("text").type == pa.large_string() for b in got)


def test_unrelated_long_sets_share_no_list():
    rng = np.random.default_rng(8)
    documents, members = 400, 3000
    sets = np.sort(rng.integers(0, 2**64, (documents, members), dtype=np.uint64), axis=1).ravel()
    whole = near_dedup.signatures_of(sets, np.arange(documents + 1) * members)
    keys = near_dedup.list_keys((whole >> np.uint64(32)).astype(np.uint32), whole.astype(np.uint32))
    assert (keys >= 0).all() and ((keys >> near_dedup.VALUE_BITS) == np.arange(near_dedup.COORDINATES)).all()
    assert len(np.unique(keys)) == keys.size
    # The upper bits of a value are as good as random too.
    assert len(np.unique(whole[:, 0] >> np.uint64(48))) > 390
