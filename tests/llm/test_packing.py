"""Boundaries against all choices, batches against the budget."""

import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from casewright.llm import packing


def padding(cells, ends):
    total, at = 0, 0
    for longest, count, tokens in cells:
        while longest > ends[at]:
            at += 1
        total += ends[at] * count - tokens
    return total


def test_boundaries_are_the_best_of_all():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(0, 60), rng.randrange(1, 9)))
        cells = [(x, n := rng.randrange(1, 20), x * n) for x in lengths]
        for buckets in (1, 2, 3, 5):
            ends = packing.best_boundaries(cells, buckets)
            assert len(ends) <= buckets and ends[-1] == lengths[-1]
            choices = (c for k in range(buckets) for c in combinations(lengths[:-1], k))
            assert padding(cells, ends) == min(padding(cells, [*c, lengths[-1]]) for c in choices)


def test_cells_hold_neighbouring_lengths(spark):
    cells = spark.range(1, 300_000, 7).select("id", packing.cell("id").alias("cell"))
    sizes = cells.groupBy("cell").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    assert sizes.where("b > a * (1 + 1 / 512D)").count() == 0
    assert cells.where("id < 1024 and cell != id").count() == 0
    assert cells.count() > sizes.count() < 6_000


def check(rows, wanted, budget):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in rows) == sorted((i is None, i or 0, n) for i, n in wanted)
    batches, limits = defaultdict(list), {}
    for r in rows:
        assert 0 <= r.padding == r.bucket_length - r.length
        batches[r.bucket, r.batch].append(r.slot)
        assert limits.setdefault(r.bucket, r.bucket_length) == r.bucket_length
    last = {b: max(n for x, n in batches if x == b) for b in limits}
    for (bucket, number), slots in batches.items():
        fit = max(1, budget // max(limits[bucket], 1))
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == fit or number == last[bucket])
        assert len(slots) <= fit


def test_batches_are_full_and_within_budget(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_ROWS", 50)
    rng = random.Random(2)
    wanted = [(k, min(3000, int(rng.lognormvariate(4, 1)))) for k in range(1500)] + [(None, 5), (7, 0), (7, 0), (8, 90_000)]
    docs = spark.createDataFrame([(i, n, "b") for i, n in wanted], "doc_id long, n long, bucket string")
    check(packing.pack(docs, F.col("n"), budget=4096, buckets=6).collect(), wanted, 4096)


def test_words_of_text_null_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b  c\nd"), (3, "a b  c\nd"), (4, "x " * 50_000)], "doc_id long, text string")
    wanted = [(1, 0), (2, 0), (3, 4), (3, 4), (4, 50_000)]
    check(packing.pack(docs).collect(), wanted, packing.BUDGET)
    assert packing.pack(docs.limit(0)).collect() == []
