"""The ordinal classifier: gradient, order of thresholds, accuracy on rows it has not seen."""

from collections import Counter

import numpy as np
import pyarrow as pa

from casewright.llm import quality, ragged

FOLDER = "/root/testdata/sf0.1"


def test_thresholds_stay_in_order_and_grades_are_found():
    rng = np.random.default_rng(0)
    rows, cells = 900, 40
    text = np.repeat(np.arange(rows), 5)
    cell = rng.integers(0, cells, len(text))
    weight = np.linspace(-2, 2, cells)
    score = np.bincount(text, weights=weight[cell], minlength=rows)
    grades = np.digitize(score, [-2, 1])
    model = quality.fit(text, cell, np.ones(len(text)), grades)
    assert np.all(np.diff(model.thresholds) > 0)
    tails = model.tails(model.scores(text, cell, np.ones(len(text)), rows))
    assert np.all(tails[:, 0] >= tails[:, 1])
    assert ((tails > 0.5).sum(axis=1) == grades).mean() > 0.95


def test_slopes_equal_differences_of_the_loss():
    rng = np.random.default_rng(2)
    text, place, value = np.repeat(np.arange(50), 4), rng.integers(0, 9, 200), rng.random(200)
    grades = rng.integers(0, 4, 50)
    point = np.r_[rng.normal(size=9), -1.0, 0.3, -0.4]
    slopes = quality.loss_and_slopes(point, text, place, value, grades, 4)[1]
    for k in range(len(point)):
        step = np.zeros(len(point))
        step[k] = 1e-6
        above, below = (quality.loss_and_slopes(p, text, place, value, grades, 4)[0] for p in (point + step, point - step))
        assert abs((above - below) / 2e-6 - slopes[k]) < 1e-6


def test_words_of_a_text_and_their_values():
    texts = ["", "one two two three", "Same same SAME", "x " * 5_000 + "y", "...", "é a"]
    data, offsets = ragged.as_bytes(pa.array(texts))
    text, cell, value = quality.features(data, offsets)
    for k, words in enumerate([[], ["one", "two", "two", "three"], ["same"] * 3, ["x"] * 5_000 + ["y"], []]):
        shares = sorted(quality.WORD_WEIGHT * (n / len(words)) ** 0.5 for n in Counter(words).values())
        mine, marks = value[text == k], cell[text == k] >= 1 << quality.BITS
        assert marks.sum() == len(shares) and (mine[marks] == quality.MARK_WEIGHT).all()
        assert np.allclose(sorted(mine[~marks]), sorted(shares + [1.0] * 11))
    # A text has the same features alone and among others.
    alone = quality.features(*ragged.as_bytes(pa.array([texts[1]])))
    assert np.array_equal(np.sort(alone[1]), np.sort(cell[text == 1]))


def test_only_rare_words_bound_to_a_grade_tell():
    rng = np.random.default_rng(3)
    grades = np.r_[np.zeros(100, int), np.full(100, 1), np.full(2_800, 2)]
    marks = 1 << quality.BITS
    told = [(t, marks + 7) for t in range(100, 160)]  # rare, in texts of one grade
    common = [(t, marks + 8) for t in range(3_000) if t >= 200 or t % 9 == 0]
    chance = [(t, marks + 9) for t in rng.choice(3_000, 90, replace=False)]
    share = [(t, 7) for t in range(3_000)]
    text, cell = np.array(told + common + chance + share).T
    kept = quality.telling(text, cell, grades)
    assert set(cell[kept]) == {7, marks + 7}


def test_one_telling_word_counts_in_a_long_text(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0 and quality = 1")
    scored = quality.graded(docs, labels.where("doc_id % 3 != 0")).join(held, "doc_id").toPandas()
    assert scored[scored.toxic == 1].kept.mean() < 0.4
    assert scored[scored.toxic == 0].kept.mean() > 0.99


def test_held_out_ratings(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    scored = quality.graded(docs, train).join(held, "doc_id").toPandas()
    clean = (scored.quality == 1) & (scored.toxic == 0)
    assert len(scored) == held.count()
    assert scored[clean].kept.mean() > 0.99
    assert scored[scored.quality == 0].kept.mean() < 0.03
    assert scored[(scored.quality == 1) & (scored.toxic == 1)].expected_grade.mean() < scored[clean].expected_grade.mean()
    assert scored.tail_probability.between(0, 1).all() and scored.expected_grade.between(0, 2).all()


def test_toxic_texts_are_rejected_more_often_than_a_lower_cut_would(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0 and quality = 1")
    scored = quality.graded(docs, labels.where("doc_id % 3 != 0")).join(held, "doc_id").toPandas()
    toxic = scored.toxic == 1
    assert scored[toxic].kept.mean() < 0.65
    assert scored[~toxic].kept.mean() > 0.99


def test_a_repeated_identifier_is_rated_once(spark):
    docs = spark.createDataFrame([(1, "same text")] * 40 + [(1, "other text"), (2, None), (3, "rare")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r.grade, r.text or "") for r in quality.rated(docs, labels).collect())
    assert [grade for grade, _ in got] == [0, 1, 2] and got[0][1] in ("same text", "other text")


def test_edges(spark):
    rows = [(1, None, 5.0), (2, "", None), (3, "word " * 200_000, 1.0), (4, "a b", 2.0), (4, "a b", 2.0), (None, "c", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, expected_grade double")
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, None), (4, 0, 1), (3, 1, 0), (None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.graded(docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 4), (True, 0)]
    untrained = quality.graded(docs, labels.limit(0)).collect()
    assert len(untrained) == len(rows) and all(r.kept for r in untrained)
    assert quality.graded(docs.limit(0), labels).collect() == []
    left = quality.drop_low_quality(docs, labels.limit(0))
    assert left.columns == docs.columns and left.count() == len(rows)
