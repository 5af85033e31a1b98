"""Best documents for each item of a query set, by integer scores of shared terms, through buckets of vector length.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. With N the
documents that have a term, L all their terms, n those of one document, df the documents that hold a term and tf its
occurrences in one, the score of a document sums w * impact over the item's terms, repeats included:
w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 25 + (75 * n * N) div L, impact = (10**9 * tf) div (1000 * tf + 8m).

Item and document are vectors with coordinates count * sqrt(w) and impact * sqrt(w), their inner product is the score.
Documents are put in order by the length of their vector. Rounds go from long vectors to short ones, each over buckets
with some thirty times the documents of the rounds before, with the items' k-th best scores so far as thresholds:

* an item whose length times the longest vector left is under its threshold is done (Cauchy and Schwarz), and vectors
  too short for all items are not read (the filter reaches the files, which are sorted by length);
* inside a bucket, the product over an item's ``FOCUS`` heaviest coordinates plus the product of the lengths of what is
  left bounds each score from above;
* documents that pass are scored again, exactly, in 64-bit integers. Bounds are doubles with a slack of 1e-9.

Items are taken in blocks of bounded size, each against all documents. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm import ragged
from casewright.sources.working import working_table

BEST = 10
FOCUS = 8
BLOCK_ITEMS = 1024
BLOCK_TERMS = 1 << 14
HEAD_DOCS = 2_000
GROWTH = 30
#: Buckets of a factor of two in length.
STEPS = 8
SLICE_CELLS = 1 << 19
SLACK = 1e-9
FOUND = "item long, doc_id long, score long"


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each text in order, and the offsets of each text's terms."""
    data = ragged.lower(data)
    inside = (data >= 128) | ((data - np.uint8(48)) < 10) | ((data - np.uint8(97)) < 26)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]][: len(data)]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False][: len(data)])) + 1
    return ragged.word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


@dataclass
class Block:
    """Items of one pass: their rows, the sorted hashes of their terms, and each item's terms (places) with counts."""

    rows: list[int]
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    counts: list[np.ndarray]


def block_of(rows: list[int], hashes: list[np.ndarray]) -> Block:
    vocabulary = np.unique(np.concatenate(hashes))
    distinct = [np.unique(h, return_counts=True) for h in hashes]
    return Block(rows, vocabulary, [np.searchsorted(vocabulary, h) for h, _ in distinct], [c for _, c in distinct])


def blocks_of(items: DataFrame) -> Iterator[Block]:
    """Blocks of the items (row, text) that have terms; the driver holds one block at a time."""
    rows: list[int] = []
    hashes: list[np.ndarray] = []
    size = 0
    for row in items.toLocalIterator():
        data, offsets = ragged.as_bytes(pa.array([row.text], pa.string()))
        own, _ = term_hashes(data, offsets)
        if not len(own):
            continue
        if rows and (size + len(own) > BLOCK_TERMS or len(rows) == BLOCK_ITEMS):
            yield block_of(rows, hashes)
            rows, hashes, size = [], [], 0
        rows.append(row.row)
        hashes.append(own)
        size += len(np.unique(own))
    if rows:
        yield block_of(rows, hashes)


def lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def vectoriser(vocabulary):
    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) -> (id, n, terms, tfs) for each document with a term; only terms of the block are listed."""
        known = vocabulary.value
        for batch in batches:
            data, offsets = ragged.as_bytes(batch.column("text"))
            for first, end, part, part_of in ragged.blocks(data, offsets):
                hashes, of = term_hashes(part, part_of)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[at] == hashes)
                owner = np.searchsorted(of, hit, "right") - 1
                cells, tfs = np.unique(owner * len(known) + at[hit], return_counts=True)
                sizes = np.bincount(cells // len(known), minlength=end - first)
                whole = pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, end - first), pa.array(np.diff(of)), lists(cells % len(known), np.r_[0, np.cumsum(sizes)]), lists(tfs, np.r_[0, np.cumsum(sizes)])],
                    names=["id", "n", "terms", "tfs"],
                )
                yield whole.filter(pa.array(np.diff(of) > 0))

    return vectorise


def holders(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents of one partition hold each term."""
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(flat_lists(batch.column("terms"))[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    return count


@dataclass(frozen=True)
class Corpus:
    """Counts over all documents and the weights of the block's terms."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    def impacts(self, n: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        m = 25 + (75 * n * self.n_docs) // self.n_terms
        tfs = tfs.astype(np.int64)
        return (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, sizes))


def measurer(corpus):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, n, terms, tfs) -> (id, length, bucket, terms, impacts), without vectors that have no length."""
        known: Corpus = corpus.value
        roots = np.sqrt(known.weights.astype(np.float64))
        for batch in batches:
            terms, of = flat_lists(batch.column("terms"))
            tfs, _ = flat_lists(batch.column("tfs"))
            impacts = known.impacts(batch.column("n").to_numpy(), tfs, np.diff(of))
            rows = np.flatnonzero(np.diff(of))
            lengths = np.zeros(len(of) - 1)
            if len(rows):
                # Sums within a row; differences of a running sum would lose digits.
                lengths[rows] = np.sqrt(np.add.reduceat((impacts * roots[terms]) ** 2, of[:-1][rows]))
            buckets = np.floor(np.log2(np.maximum(lengths, 1e-300)) * STEPS).astype(np.int32)
            whole = pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(lengths), pa.array(buckets), lists(terms, of), lists(impacts, of)],
                names=["id", "length", "bucket", "terms", "impacts"],
            )
            yield whole.filter(pa.array(lengths > 0))

    return measure


class Scorer:
    """Best documents of each item among those of one task; vectors come longest first."""

    def __init__(self, block: Block, corpus: Corpus, thresholds: np.ndarray, best: int):
        self.block, self.best = block, best
        self.thresholds = thresholds.astype(np.float64)
        self.floor = thresholds.copy()
        self.weights = [c * corpus.weights[t] for t, c in zip(block.terms, block.counts, strict=True)]
        self.roots = np.sqrt(corpus.weights.astype(np.float64))
        width = min(FOCUS, max(map(len, block.terms)))
        self.focus = np.zeros((len(block.terms), width), np.int64)
        self.heavy = np.zeros((len(block.terms), width))
        self.lengths, self.rest = np.zeros(len(block.terms)), np.zeros(len(block.terms))
        for k, (terms, counts) in enumerate(zip(block.terms, block.counts, strict=True)):
            q = counts * self.roots[terms]
            order = np.argsort(-q, kind="stable")
            self.focus[k, : len(order[:width])] = terms[order[:width]]
            self.heavy[k, : len(order[:width])] = q[order[:width]]
            self.lengths[k] = math.sqrt(float((q * q).sum()))
            self.rest[k] = math.sqrt(float((q[order[width:]] ** 2).sum()))
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * len(block.terms)
        self.ids: list[list[int | None]] = [[] for _ in block.terms]

    def alive(self, longest: float) -> np.ndarray:
        """Items that a vector of this length may still serve."""
        return np.flatnonzero((self.lengths * longest * (1 + SLACK) >= self.thresholds) & (self.lengths > 0))

    def take(self, ids: list[int | None], lengths: np.ndarray, of: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> bool:
        """Scores a slice; False once no item has use for vectors as short as these."""
        items = self.alive(float(lengths.max()))
        if not len(items):
            return False
        rows = np.repeat(np.arange(len(ids)), np.diff(of))
        exact = np.zeros((len(ids), len(self.block.vocabulary)), np.int64)
        exact[rows, terms] = impacts
        for start in range(0, len(items), 64):
            some = items[start : start + 64]
            places = self.focus[some]
            own = exact[:, places.ravel()].reshape(len(ids), len(some), -1) * self.roots[places]
            # An item with fewer terms repeats place 0 with weight 0; such a place must not shorten the rest.
            used = self.heavy[some] > 0
            inside = np.where(used, own, 0.0)
            left = np.sqrt(np.maximum(lengths[:, None] ** 2 * (1 + SLACK) - (inside**2).sum(axis=2), 0.0))
            bounds = (inside * self.heavy[some]).sum(axis=2) + left * self.rest[some]
            passing = bounds * (1 + SLACK) >= self.thresholds[some]
            for column in np.flatnonzero(passing.any(axis=0)).tolist():
                self._rescore(int(some[column]), np.flatnonzero(passing[:, column]), ids, exact)
        return True

    def _rescore(self, item: int, rows: np.ndarray, ids: list[int | None], exact: np.ndarray) -> None:
        scores = exact[rows[:, None], self.block.terms[item]] @ self.weights[item]
        good = scores >= max(int(self.floor[item]), 1)
        rows, scores = rows[good], scores[good]
        if not len(rows):
            return
        found = [*zip(self.scores[item].tolist(), self.ids[item], strict=True), *((s, ids[r]) for s, r in zip(scores.tolist(), rows.tolist(), strict=True))]
        found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
        del found[self.best :]
        self.scores[item], self.ids[item] = np.array([s for s, _ in found], np.int64), [i for _, i in found]
        if len(found) == self.best:
            self.floor[item] = max(self.floor[item], found[-1][0])
            self.thresholds[item] = float(self.floor[item])

    def result(self) -> pa.RecordBatch:
        items = [row for row, s in zip(self.block.rows, self.scores, strict=True) for _ in s]
        ids = [i for own in self.ids for i in own]
        return pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(ids, pa.int64()), pa.array(np.concatenate(self.scores))], names=["item", "doc_id", "score"]
        )


def searcher(block, corpus, thresholds, best: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(block.value, corpus.value, thresholds, best)
        step = max(16, SLICE_CELLS // len(scorer.block.vocabulary))
        wanted = True
        for batch in batches:
            if not wanted:
                break
            terms, of = flat_lists(batch.column("terms"))
            impacts, _ = flat_lists(batch.column("impacts"))
            ids, lengths = batch.column("id").to_pylist(), batch.column("length").to_numpy()
            for a in range(0, len(ids), step):
                b = min(a + step, len(ids))
                cells = slice(of[a], of[b])
                wanted = scorer.take(ids[a:b], lengths[a:b], of[a : b + 1] - of[a], terms[cells], impacts[cells])
                if not wanted:
                    break
        yield scorer.result()

    return search


def rounds(buckets: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(lowest, highest) bucket of each round, from (bucket, documents) with the longest vectors first."""
    wanted, seen, high = HEAD_DOCS, 0, None
    for bucket, count in buckets:
        high = bucket if high is None else high
        seen += count
        if seen >= wanted:
            yield bucket, high
            wanted, high = seen * GROWTH, None
    if high is not None:
        yield buckets[-1][0], high


def ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search_block(docs: DataFrame, block: Block, best: int) -> DataFrame:
    """(item, doc_id, score, rank) of one block against all of ``docs`` (id, text)."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    size = len(block.vocabulary)
    vectors = working_table(docs.mapInArrow(vectoriser(send(block.vocabulary)), "id long, n long, terms array<int>, tfs array<int>"), "search-terms")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(size, np.int64)
    for term, df in vectors.select("terms").mapInArrow(holders(size), "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        held[term] = df
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()]
    corpus = send(Corpus(n_docs, max(n_terms, 1), np.array(weights, np.int64)))
    measured = working_table(
        vectors.mapInArrow(measurer(corpus), "id long, length double, bucket int, terms array<int>, impacts array<int>"), "search-lengths"
    )
    buckets = sorted(((b, n) for b, n in measured.groupBy("bucket").count().collect()), reverse=True)
    # Buckets of one length are dealt over tasks by the length itself, so that a full one is no single task.
    ordered = working_table(
        measured.repartitionByRange(F.desc("bucket"), F.desc("length"), "id").sortWithinPartitions(F.desc("length")), "search-buckets"
    )
    shared, found = send(block), None
    place = {row: k for k, row in enumerate(block.rows)}
    thresholds = np.zeros(len(block.rows), np.int64)
    lengths = Scorer(block, corpus.value, thresholds, best).lengths
    for low, high in rounds(buckets):
        least = float(min((t / q for t, q in zip(thresholds.tolist(), lengths.tolist(), strict=True) if q > 0), default=0.0))
        some = ordered.where(F.col("bucket").between(low, high) & (F.col("length") >= least * (1 - SLACK)))
        new = some.drop("bucket").mapInArrow(searcher(shared, corpus, thresholds, best), FOUND)
        found = working_table(ranked(new if found is None else found.select("item", "doc_id", "score").union(new), best), "search-best")
        for item, score in found.where(F.col("rank") == best).select("item", "score").collect():
            thresholds[place[item]] = score
    return found


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item of ``items`` (item_id, text).

    Defined results: equal scores come by ascending doc_id, null ids last; rows with one doc_id are documents of their
    own; equal rows of ``items`` are one item, unequal ones with one id are ranked each for itself; a null text or one
    without terms is found by none and finds none, nor does a document with score 0; texts of any length are read
    whole; empty tables give an empty result; other columns are never read. What the driver collects is bounded by a
    block of items: its terms, their document counts and one score per item.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    wanted = items.select("item_id", "text").distinct().withColumn("row", F.monotonically_increasing_id())
    wanted = working_table(wanted, "search-items")
    parts = [search_block(rows, block, best) for block in blocks_of(wanted.select("row", "text"))]
    parts = [p for p in parts if p is not None]
    columns = ["item_id", "rank", "doc_id", "score"]
    if not parts:
        none = wanted.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
        return none.select(*columns)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.join(wanted.select(F.col("row").alias("item"), "item_id"), "item").select(*columns)
