"""Base counts and the robust estimates against a plain version."""

import math
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from casewright.llm import outliers

SCHEMA = "doc_id long, text string, lang string, source string"


def counts(text):
    words = brute.WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def steps(n, chars, symbols, lines, repeats):
    values = (math.log(max(chars, 1) / max(n, 1)), math.sqrt(symbols / max(n, 1)), math.log1p(lines), repeats / max(n, 1))
    return [math.floor(abs(v) * 256 + 0.5) * (1 if v >= 0 else -1) for v in values]


def nearest_rank_free(values, part):
    """Linear interpolation between order statistics, as Spark's exact percentile does."""
    return float(np.percentile(np.asarray(values, float), part * 100))


def distances(rows: np.ndarray) -> np.ndarray | None:
    """The same estimates with dense matrices: the best of two starts after concentration steps."""
    if len(rows) < outliers.MIN_GROUP:
        return None
    floor = np.diag([(f * 256) ** 2 for f in outliers.FLOORS])
    centre = np.array([nearest_rank_free(c, 0.5) for c in rows.T])
    spread = np.array([nearest_rank_free(abs(c - m), 0.5) for c, m in zip(rows.T, centre, strict=True)])
    best = None
    for cov in (np.zeros((4, 4)), np.diag((1.4826 * spread) ** 2)):
        mean, cov = centre, cov + floor
        for _ in range(outliers.STEPS):
            gap = rows - mean
            d = np.floor(np.log(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) + 1e-6) * 64)
            near = rows[d <= math.ceil(nearest_rank_free(d, 0.75))]
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) + floor
        volume = np.linalg.slogdet(cov)[1]
        if best is None or volume < best[0] - 1e-9:
            best = volume, mean, cov
    gap = rows - best[1]
    d = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(best[2]), gap)
    middle = nearest_rank_free(np.floor(np.log(d + 1e-6) * 64), 0.5)
    return d / max(1.0, math.exp(middle / 64) / outliers.MEDIAN)


def test_counts_and_distances_match(spark):
    rng = random.Random(4)
    vocabulary = [f"{'abcdefgh'[k % 8] * (1 + k % 7)}{k}" for k in range(400)]
    rows = []
    for k in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 200))]
        if k % 25 == 0:
            words = [w + "##%%" for w in words]
        if k % 40 == 1:
            words = words[:4] * 30
        text = "".join(w + rng.choice("    \n\t") for w in words) + ("\nsame line\nsame line" if k % 9 == 0 else "")
        rows.append((k, text, ("en", "fr", None)[k % 3], ("a", None)[k % 2]))
    rows += [(1000, None, "en", "a"), (1001, "", None, None), (1002, "word", "xx", "b"), (1003, "é " * 60, "xx", "b")]
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    groups = defaultdict(list)
    for i, text, lang, source in rows:
        r, base = got[i], counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base, text
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.base_failed and r.kept)
        if not r.base_failed:
            groups[lang, source].append((i, steps(*base)))
    rejected = 0
    for members in groups.values():
        wanted = distances(np.array([s for _, s in members], float))
        for k, (i, _) in enumerate(members):
            if wanted is None:
                assert got[i].distance is None and got[i].kept
            else:
                assert got[i].distance == pytest.approx(wanted[k], rel=1e-6)
                assert got[i].kept == (wanted[k] <= outliers.LIMIT)
                rejected += not got[i].kept
    assert rejected >= 5


def test_small_groups_are_judged_by_wider_ones(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice("some words of plain prose told at length by many".split()) + str(rng.randrange(900)) for _ in range(150))
    junk = lambda: " ".join(w + "##%%" for w in prose().split())
    rows = [(prose(), "en", "large") for _ in range(60)]
    rows += [(t(), "en", source) for source in ("tail", None) for t in (prose, prose, junk)]
    rows += [(t(), lang, "other") for lang in ("fr", None) for t in (prose, junk)]
    docs = [(k, *row) for k, row in enumerate(rows)]
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(docs, SCHEMA), ["doc_id"]).collect()}
    stats = np.array([steps(*counts(text)) for _, text, _, _ in docs], float)
    english = [k for k, _, lang, _ in docs if lang == "en"]
    wanted = dict(zip(range(60), distances(stats[:60]), strict=True))
    wanted |= {k: d for k, d in zip(english, distances(stats[english]), strict=True) if k >= 60}
    wanted |= {k: d for k, d in enumerate(distances(stats)) if k not in wanted}
    for k, text, _, _ in docs:
        assert got[k].distance == pytest.approx(wanted[k], rel=1e-6)
        assert got[k].kept == ("##" not in text)


def test_a_text_with_forty_symbols_in_a_hundred_words_is_rejected(spark):
    rng = random.Random(8)
    prose = lambda marks: " ".join(f"word{rng.randrange(900)}" + "|" * (j % 100 < marks) for j in range(100))
    rows = [(k, prose(marks), "en", "a") for k, marks in enumerate([0] * 60 + [10, 40])]
    got = {r.doc_id: r.kept for r in outliers.judge(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert [k for k in got if not got[k]] == [61]


def test_a_table_below_the_least_group_is_judged(spark):
    clean = [" ".join(f"word{k}x{j}" for j in range(60)) for k in range(8)]
    rows = [(k, text, "en", f"s{k % 3}") for k, text in enumerate([*clean, clean[0].replace(" ", "## ")])]
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    assert [got[k].kept for k in range(9)] == [True] * 8 + [False] and all(r.distance is not None for r in got.values())


def test_empty_repeated_and_clashing(spark):
    rows = [(1, "a b c " * 30, "en", "s", 1, "x"), (1, "a b c " * 30, "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_words int, g string")
    assert [(r.doc_id, r.base_failed) for r in outliers.judge(docs, ["doc_id"]).collect()] == [(1, True), (1, True)]
    assert outliers.judge(docs.limit(0), ["doc_id"]).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counted = outliers.base_counts(docs, ["doc_id"])
    assert "Python" not in counted._jdf.queryExecution().toString()
