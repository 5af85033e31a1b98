"""Language labels: spans of mixed text, accuracy on rows it has not seen, best paths against all paths."""

from itertools import product

import numpy as np

from casewright.llm import langid

SCHEMA = "doc_id long, text string, lang string"
ENGLISH = "the cat and the dog went over the hill with their friends to see what was there and then they came home again"
GERMAN = "der hund und die katze gingen über den berg mit ihren freunden um zu sehen was dort war und dann kamen sie wieder nach hause"
RUSSIAN = "кошка и собака пошли через холм со своими друзьями чтобы увидеть что там было и потом они вернулись домой"


def test_best_paths_are_the_best_of_all():
    rng = np.random.default_rng(2)
    of = np.array([0, 5, 5, 6, 10])
    scores = rng.normal(size=(10, 3)).astype(np.float32)
    labels = langid.best_paths(scores, of, 0.7)
    for a, b in zip(of[:-1], of[1:], strict=True):
        value = lambda path, a=a: sum(scores[a + k, s] for k, s in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:], strict=False))
        best = max(map(value, product(range(3), repeat=b - a)))
        assert np.isclose(value(tuple(labels[a:b])), best)


def train(spark, extra=()):
    rows = [(k, text, lang) for k in range(60) for text, lang in ((ENGLISH, "en"), (GERMAN, "de"), (RUSSIAN, "ru")) for k in [k * 3 + len(lang)]]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def test_spans_of_mixed_text_and_edges(spark):
    extra = [
        (9001, f"{ENGLISH} {GERMAN} {RUSSIAN} {ENGLISH}", None), (9002, None, "en"), (9003, "12 ... !", None), (9004, "", None),
        (9005, "ελληνικά", None), (None, ENGLISH, None), (9006, (GERMAN + " ") * 3000, None), (9007, "КОШКА", None),
    ]
    docs = train(spark, extra)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [s.lang for s in got[9001].spans] == ["en", "de", "ru", "en"]
    words = [len(t.split()) for t in (ENGLISH, GERMAN, RUSSIAN, ENGLISH)]
    assert all(abs(s.words - n) <= 2 for s, n in zip(got[9001].spans, words, strict=True))
    assert sum(s.words for s in got[9001].spans) == sum(words)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (9002, 9003, 9004))
    assert got[9005].lang_pred in ("en", "de", "ru") and got[None].lang_pred == "en" and got[None].held_out is False
    assert (got[9006].lang_pred, got[9006].score, len(got[9006].spans)) == ("de", 1.0, 1)
    assert got[9007].lang_pred == "ru"


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "text", None), (1, "text", None)], SCHEMA)
    assert [r.lang_pred for r in langid.identify(docs).collect()] == ["und", "und"]
    assert langid.identify(docs.limit(0)).collect() == []


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert len(got) > 200 and (got.lang_pred == got.lang).mean() > 0.98
