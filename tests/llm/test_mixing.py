"""Mixing against a plain version of targets, and the properties of thresholds."""

import hashlib

import brute
import pytest

from casewright.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def plain_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full: set = set()
    while True:
        left = [s for s in order if s not in full]
        rate = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in left) if left else 0
        over = {s for s in left if weight[s] * rate >= 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else weight[s] * rate for s in order}
        full |= over


def words(count, start=0):
    return " ".join(f"w{start + k}" for k in range(count))


@pytest.mark.parametrize("spread", [(400, 10, 10), (30, 30, 30), (5, 300, 2)])
def test_targets_are_met_within_one_document(spark, spread):
    rows, number = [], 0
    for source, count in zip(("b", None, "a"), spread, strict=True):
        for k in range(count):
            rows.append((number, source, words(1 + (k * 7) % 40)))
            number += 1
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    source = {i: s for i, s, _ in rows}
    sizes = {s: sum(len(brute.WORD.findall(t)) for _, x, t in rows if x == s) for s in {"a", "b", None}}
    targets = plain_targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if source[r.doc_id] == s]
        assert own[0].target == pytest.approx(targets[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - targets[s]) <= max(r.size for r in own)
        passes = {r.taken // r.size for r in own if r.size}
        assert passes <= {0, 1, 2} and len(passes) <= 2
        # Whoever is taken once more has the smaller hashes.
        code = lambda r: int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)
        more, less = ([code(r) for r in own if r.taken // r.size == p] for p in (max(passes), min(passes)))
        assert len(passes) == 1 or max(more) < min(less)


def test_smaller_budgets_are_nested(spark):
    rows = [(k, "a", words(1 + k % 9)) for k in range(200)]
    slim = mixing.Mix(spark.createDataFrame(rows, SCHEMA))
    before = -1
    for target in (0.0, 3.0, 100.0, 500.0, 900.0):
        goals = slim.goals.selectExpr("source", "source_size", f"cast({target} as double) AS target")
        cut = mixing.thresholds(slim.rows, goals).first()
        assert cut.passes == 0 and cut.below >= before
        before = cut.below


def test_nulls_blank_texts_repeats_and_empty(spark):
    rows = [(None, None, None), (1, None, ""), (2, "a", "x y"), (2, "a", "x y"), (3, "", "one"), (4, "a", words(30_000))]
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA + ", hash string, size long")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.taken for r in got if r.doc_id == 2} in ({0}, {2}, {4})
    assert mixing.mix(docs.limit(0)).collect() == []
    blank = mixing.mix(spark.createDataFrame([(1, "a", None), (2, "b", " ")], SCHEMA)).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in blank} == {(0, 0, 0.0, 0)}
    again = mixing.mixed(docs)
    assert again.columns == docs.columns
    taken = sum(r.taken // r.size for r in got if r.size)
    assert again.where("text is not null and text != ''").count() == taken


def test_clashing_names_of_the_mixed_table(spark):
    names = "doc_id long, source string, text string, _copy int, _copies int, hash int, passes string, whole int, copies int, col int, `a.b` int"
    rows = [(k, "s" if k % 2 else None, "some words here", k, -k, 3, "p", 4, 5, 6, 7) for k in range(30)] + [(None, None, None, *range(3), "p", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, names)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.size}
    again = mixing.mixed(docs)
    assert again.columns == docs.columns
    left = [tuple(r) for r in again.collect()]
    assert sorted(r for r in left if r[0] is not None) == sorted(r for r in rows if r[0] is not None for _ in range(taken[r[0]]))
    assert mixing.mixed(docs.limit(0)).collect() == []
