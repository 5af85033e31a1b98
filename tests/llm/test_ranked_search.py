"""Ranked search against a plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pytest

from casewright.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def plain(docs, items, best=10):
    """Sorted (item_id, rank, doc_id, score)."""
    held = [(i, Counter(TERM.findall(brute.lower(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        wanted = TERM.findall(brute.lower(text))
        scores = []
        for doc_id, counts in held:
            m = 25 + 75 * sum(counts.values()) * n_docs // n_terms
            score = 0
            for t in wanted:
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


def found(spark, docs, items):
    got = ranked_search.search(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert [f.dataType.typeName() for f in got.schema] == ["long", "integer", "long", "long"]
    return sorted(map(tuple, got.collect()), key=str)


def corpus(rng, size):
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    return [" ".join(rng.choices(words, k=rng.choice([1, 3, 20, 60, 200]))) for _ in range(size)], words


@pytest.mark.parametrize("blocks", [(1024, 1 << 14), (3, 1 << 14), (50, 40)])
def test_equals_scoring_of_all_documents(spark, monkeypatch, blocks):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", blocks[0])
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", blocks[1])
    monkeypatch.setattr(ranked_search, "HEAD_DOCS", 20)
    monkeypatch.setattr(ranked_search, "GROWTH", 3)
    rng = random.Random(7)
    texts, words = corpus(rng, 400)
    docs = list(enumerate(texts + texts[:30]))
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 15, 40])))) for k in range(9)] + [(9, texts[5]), (10, texts[6] + " " + texts[7])]
    assert found(spark, docs, items) == plain(docs, items)


def test_edges(spark):
    docs = [
        (1, None), (2, ""), (3, "?! ,"), (4, "Été-2 ok"), (4, "Été-2 ok"), (None, "ok"), (5, "OK ok　ok"), (6, "x" * 200_000), (7, "ok " * 50_000),
    ]
    items = [(1, "ok été"), (2, None), (3, "..."), (4, "nowhere"), (1, "ok été"), (5, "OK OK ok"), (5, "x" * 200_000), (None, "ok")]
    wanted = plain([(i, t or "") for i, t in docs], [(i, t or "") for i, t in items])
    assert found(spark, docs, items) == wanted and len(wanted) > 10


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], [(1, "ok")]) == []
    assert found(spark, [(1, "ok")], []) == []
    names = "doc_id long, text string, item int, length string, rank int, id int"
    docs = spark.createDataFrame([(1, "a b", 1, "x", 1, 1), (2, "b", 1, "y", 2, 2), (3, "c", 0, "z", 3, 3)], names)
    items = spark.createDataFrame([(8, "a b", 4, "x")], "item_id long, text string, row int, doc_id string")
    assert sorted(map(tuple, ranked_search.search(docs, items).collect())) == plain([(1, "a b"), (2, "b"), (3, "c")], [(8, "a b")])


def test_short_vectors_are_neither_scored_nor_needed():
    block = ranked_search.block_of([0], [np.array([1, 2, 3], np.uint64)])
    known = ranked_search.Corpus(100, 1000, np.array([400, 900, 100], np.int64))
    scorer = ranked_search.Scorer(block, known, np.array([10**9]), 10)
    reach = 10**9 / scorer.lengths[0]
    assert not len(scorer.alive(reach * 0.99)) and len(scorer.alive(reach * 1.01))


def test_rounds_cover_every_bucket():
    buckets = [(k, 500) for k in range(40, -40, -1)]
    parts = list(ranked_search.rounds(buckets))
    assert parts[0] == (37, 40) and parts[-1][0] == -39
    assert [low - 1 for low, _ in parts[:-1]] == [high for _, high in parts[1:]]
