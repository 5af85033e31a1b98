"""A quality classifier: ordinal regression with cumulative links on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score into grades:
P(grade <= k) = logistic(threshold_k - score). This gives each text an expected grade and the probability of a grade of at
least ``wanted``, by which texts are selected.

Features: every distinct word (letters only, hashed) with the square root of its share of the text; the presence of
telling words, whatever the length of the text, so that one such word counts in a long text too; and the text's shape:
eleven statistics, each as one cell of a scale, hashed into the same vector. A word is telling if at most ``RARE`` of the
rated texts hold it and its presence differs between the grades beyond chance (likelihood ratio of at least ``TELLING``,
which chance exceeds once in 5e8 words). The model is fitted on the driver from at most
about ``RATED`` rated texts chosen by a hash of the identifier; scoring covers every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm import ragged
from casewright.llm.langid import PLAIN

BITS = 17
RATED = 6_000
GRADES = 3
WANTED = 2
KEEP_AT = 0.5
PENALTY = 2e-4
ROUNDS = 300
RATE = 0.1
WORD_WEIGHT = 4.0
MARK_WEIGHT = 3.0
RARE = 0.05
TELLING = 40.0
CELLS = 16
STAT_CODES = ragged.numbers(31, 64 * CELLS)
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>{}[]\\^~=+_@", np.uint8))
DIGITS = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?'\"()-", np.uint8))


def cell_of(code: np.ndarray) -> np.ndarray:
    return (code >> ragged.U64(64 - BITS)).astype(np.int64)


def share_cell(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share on a scale that is finer near 0."""
    return np.minimum(np.sqrt(part / np.maximum(whole, 1)) * CELLS, CELLS - 1).astype(np.int64)


def log_cell(value: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(value, 0) + 1), CELLS - 1).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, value) of every feature of the block, in order of texts; presences lie in the cells from 2 ** BITS on."""
    rows = len(offsets) - 1
    starts, ends, of = ragged.word_bounds(data, offsets)
    n = np.diff(of)
    owner = np.repeat(np.arange(rows), n)
    exact = ragged.word_hashes(ragged.lower(data), starts, ends)
    plain = PLAIN[data]
    p_starts, p_ends, p_of = ragged.word_bounds(plain, offsets)
    letters = ragged.word_hashes(plain, p_starts, p_ends)
    p_n = np.diff(p_of)

    keys = np.repeat(np.arange(rows, dtype=np.int64), p_n) << BITS | cell_of(letters)
    keys, counts = np.unique(keys, return_counts=True)
    text = keys >> BITS
    value = WORD_WEIGHT * np.sqrt(counts / np.maximum(p_n, 1)[text])

    def summed(flags: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        upto = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=upto[1:])
        return np.diff(upto[at])

    again = np.zeros(len(exact), bool)
    again[1:] = (exact[1:] == exact[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((exact, owner))
    run = np.ones(len(exact), bool)
    run[1:] = (exact[order][1:] != exact[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][run], minlength=rows)
    sizes = np.diff(np.r_[np.flatnonzero(run), len(exact)]) if len(exact) else np.empty(0, np.int64)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, owner[order][run], sizes)
    size = np.diff(offsets)
    lines = summed(data == 10) + 1
    scales = [
        log_cell(n),
        share_cell(summed(SYMBOLS[data]), size),
        share_cell(summed(DIGITS[data]), size),
        share_cell(summed(MARKS[data]), size),
        share_cell(n - distinct, n),
        share_cell(most, n),
        share_cell(summed(again, of), n),
        log_cell(8 * size / np.maximum(n, 1)),
        share_cell(lines, n + 1),
        share_cell(summed((data - np.uint8(65)) < 26), size),
        log_cell(p_n - n),
    ]
    word = keys & ((1 << BITS) - 1)
    texts, cells, values = [text, text], [word, word + (1 << BITS)], [value, np.full(len(word), MARK_WEIGHT)]
    for k, scale in enumerate(scales):
        texts.append(np.arange(rows))
        cells.append(cell_of(STAT_CODES[k * CELLS + scale]))
        values.append(np.ones(rows))
    text = np.concatenate(texts)
    order = np.argsort(text, kind="stable")
    return text[order], np.concatenate(cells)[order], np.concatenate(values)[order]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Ordinal:
    """Weights over cells and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, text: np.ndarray, cell: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(text, weights=self.weights[cell] * value, minlength=rows)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by row."""
        return logistic(scores[:, None] - self.thresholds)


def telling(text: np.ndarray, cell: np.ndarray, grades: np.ndarray, count: int = GRADES) -> np.ndarray:
    """Which features stay in the fit: all but the presences of words that are common or not bound to a grade."""
    mark = cell >= 1 << BITS
    at = (cell[mark] - (1 << BITS)) * count + grades[text[mark]]
    held = np.bincount(at, minlength=count << BITS).reshape(-1, count)
    rows = np.bincount(grades, minlength=count)
    both = held.sum(axis=1, keepdims=True)
    ratio = np.zeros(len(held))
    for seen, all_seen in ((held, both), (rows - held, len(grades) - both)):
        expected = all_seen * (rows / max(len(grades), 1))
        ratio += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.where(seen > 0, expected, 1)), 0).sum(axis=1)
    chosen = (ratio >= TELLING) & (both[:, 0] <= RARE * len(grades))
    return ~mark | chosen[np.where(mark, cell - (1 << BITS), 0)]


def cuts_of(free: np.ndarray) -> np.ndarray:
    """Thresholds: the first one, then sums of positive gaps."""
    return np.cumsum(np.r_[free[0], np.exp(free[1:])])


def loss_and_slopes(point: np.ndarray, text: np.ndarray, place: np.ndarray, value: np.ndarray, grades: np.ndarray, count: int) -> tuple[float, np.ndarray]:
    """The penalised mean loss at ``point`` (weights, then the free numbers of the thresholds) and its slope by each number."""
    rows, used = len(grades), len(point) - (count - 1)
    w, free = point[:used], point[used:]
    score = np.bincount(text, weights=w[place] * value, minlength=rows)
    edges = np.concatenate([[-np.inf], cuts_of(free), [np.inf]])
    upper, lower = (np.where(np.isinf(e), np.where(e > 0, 1.0, 0.0), logistic(np.where(np.isinf(e), 0, e - score))) for e in (edges[grades + 1], edges[grades]))
    chance = np.maximum(upper - lower, 1e-12)
    d_upper, d_lower = upper * (1 - upper) / chance, lower * (1 - lower) / chance
    slope = (d_upper - d_lower) / rows  # of the loss by score
    d_cuts = np.array([(d_lower[grades == k + 1].sum() - d_upper[grades == k].sum()) / rows for k in range(count - 1)])
    d_free = np.r_[d_cuts.sum(), [d_cuts[k:].sum() * np.exp(free[k]) for k in range(1, count - 1)]]
    slopes = np.r_[np.bincount(place, weights=slope[text] * value, minlength=used) + PENALTY * w, d_free]
    return float(-np.log(chance).mean() + PENALTY / 2 * (w**2).sum()), slopes


def fit(text: np.ndarray, cell: np.ndarray, value: np.ndarray, grades: np.ndarray, count: int = GRADES) -> Ordinal:
    """Penalised maximum likelihood by gradient steps of adapted size; thresholds stay in order as sums of positive gaps."""
    rows = len(grades)
    model = Ordinal(np.zeros(2 << BITS), np.arange(count - 1, dtype=float))
    if not rows:
        return model
    above = 1 - np.array([(grades <= k).mean() for k in range(count - 1)])
    start = -np.log(np.clip(above, 1e-3, 1 - 1e-3) / np.clip(1 - above, 1e-3, 1))
    free = np.r_[start[0], np.log(np.maximum(np.diff(start), 0.05))]
    used = np.unique(cell)
    place = np.searchsorted(used, cell).astype(np.int32)
    point = np.zeros(len(used) + len(free))
    point[len(used) :] = free
    mean, square = np.zeros_like(point), np.zeros_like(point)
    for step in range(1, ROUNDS + 1):
        slopes = loss_and_slopes(point, text, place, value, grades, count)[1]
        mean = 0.9 * mean + 0.1 * slopes
        square = 0.999 * square + 0.001 * slopes**2
        point = point - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    model.weights[used] = point[: len(used)]
    model.thresholds = cuts_of(point[len(used) :])
    return model


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grade, text) -> (grade, cells, values)."""
    for batch in batches:
        data, offsets = ragged.as_bytes(batch.column("text"))
        for first, end, part, part_of in ragged.blocks(data, offsets):
            text, cell, value = features(part, part_of)
            at = np.searchsorted(text, np.arange(end - first + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("grade").slice(first, end - first),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(cell.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(value.astype(np.float32))),
                ],
                names=["grade", "cells", "values"],
            )


def scorer(model, wanted: int, text: str, kept: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ragged.as_bytes(batch.column(text))
            expected, tails = [np.empty(0)], [np.empty(0)]
            for first, end, part, part_of in ragged.blocks(data, offsets):
                tail = model.value.tails(model.value.scores(*features(part, part_of), end - first))
                expected.append(tail.sum(axis=1))
                tails.append(tail[:, wanted - 1])
            scores = [pa.array(np.concatenate(expected)), pa.array(np.concatenate(tails))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *scores], names=[*kept, "expected_grade", "tail_probability"])

    return score


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: of low quality; 1: good but toxic; 2: good. Null without a quality; a missing toxic mark counts as none."""
    return F.when(quality == 0, 0).when(quality > 0, F.when(F.coalesce(toxic, F.lit(0)) > 0, 1).otherwise(2)).cast("long")


def rated(docs: DataFrame, labels: DataFrame, most: int = RATED) -> DataFrame:
    """(grade, text) of about ``most`` rated documents at most, one row per identifier.

    Of several ratings of a document the lowest counts; of several texts the one of the largest hash.
    """
    grades = labels.select(F.col("doc_id").alias("id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    grades = grades.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    count = grades.count()
    part = min(1.0, most / count) if count else 0.0
    chosen = grades.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < part * 1_000_000)
    # The sample is bounded by ``most``, so it may go to every task.
    found = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")
    return found.groupBy("id", "grade").agg(F.max_by("text", F.xxhash64("text")).alias("text")).select("grade", "text")


def train(docs: DataFrame, labels: DataFrame, most: int = RATED) -> Ordinal:
    got = rated(docs, labels, most).mapInArrow(extract, "grade long, cells array<int>, values array<float>").toArrow().combine_chunks()
    if not got.num_rows:
        return fit(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    cells, values = (got.column(n).combine_chunks() for n in ("cells", "values"))
    grades = got.column("grade").to_numpy()
    text = np.repeat(np.arange(got.num_rows, dtype=np.int32), np.diff(cells.offsets.to_numpy()))
    cell, value = cells.flatten().to_numpy(), values.flatten().to_numpy()
    chosen = telling(text, cell, grades)
    # Only what the fit needs stays in the driver's memory; numbers keep the width they came in.
    text, cell, value = text[chosen], cell[chosen], value[chosen]
    del got, cells, values, chosen
    return fit(text, cell, value, grades)


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], wanted: int, keep_at: float) -> DataFrame:
    """The columns ``keep`` under the names k0, k1 and so on, expected_grade, tail_probability and kept."""
    model = train(docs, labels)
    untrained = not model.weights.any()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    text = names[keep.index("text")] if "text" in keep else "text"
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in zip(names, keep, strict=True)), *([] if "text" in keep else ["text"]))
    fields = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(names, keep, strict=True))
    scored = rows.mapInArrow(scorer(shared, wanted, text, names), ", ".join(filter(None, [fields, "expected_grade double, tail_probability double"])))
    return scored.withColumn("kept", F.lit(untrained) | (F.col("tail_probability") >= keep_at))


def graded(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, wanted: int = WANTED, keep_at: float = KEEP_AT) -> DataFrame:
    """``keep`` (doc_id), expected_grade, tail_probability and kept, one row per row of ``docs``.

    A null text is the empty text; texts of any length are read whole. Without a rating the thresholds stay at their start
    and nothing is rejected. Repeated rows are scored each; an empty table gives an empty result; of other columns only
    those in ``keep`` are passed on.
    """
    keep = keep or ["doc_id"]
    scores = ("expected_grade", "tail_probability", "kept")
    return judged(docs, labels, keep, wanted, keep_at).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *scores)


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns, whatever the names of these.

    Nulls, ties, repeated rows and empty tables are as in ``graded``.
    """
    found = judged(docs, labels, docs.columns, WANTED, KEEP_AT).where("kept")
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)))
