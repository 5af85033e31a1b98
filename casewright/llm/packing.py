"""Optimal length buckets and batches of a budget of lengths inside each: words, unless a length in tokens is given.

The global histogram of lengths is one small table: exact cells up to 1,024, above that 512 cells per power of two, so
its size does not grow with the data. Dynamic programming over its cells chooses the bucket boundaries with the least
padding, from 1,024 on among the longest lengths of the cells, each 0.2 % wide at most; a boundary is the longest length
that occurs in its bucket, so no document is cut. The recurrence

    padding(k, j) = min over i < j of padding(k - 1, i) + longest(j) * count(i..j) - tokens(i..j)

is a minimum of straight lines in ``longest(j)`` and takes one pass over the cells per bucket.

A batch holds as many documents as fit into the budget at the bucket's length (at least one). Documents are numbered
inside a bucket through hash chunks of about ``CHUNK_ROWS``: numbers within a chunk come from a window over that chunk,
its offset from the chunks' counts; so a bucket with a third of all documents is many tasks and every batch but the
last of a bucket is full.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casewright.llm.words import word_count
from casewright.llm.workspace import PLACE, kept, located

BUCKETS = 16
BUDGET = 65_536
CHUNK_ROWS = 4_096
EXACT_BITS = 10


def cell(length: str) -> Column:
    """The histogram cell of a length: the length itself, or its power of two and the next nine bits."""
    bits = f"length(bin({length}))"
    return F.expr(
        f"if({bits} <= {EXACT_BITS}, {length}, ({bits} << {EXACT_BITS}) + shiftright({length}, {bits} - {EXACT_BITS}))"
    )


def best_boundaries(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Boundaries for (longest, count, tokens) cells in order of length; at most ``buckets`` of them."""
    longest = [c[0] for c in cells]
    counts, tokens = [0], [0]
    for _, count, total in cells:
        counts.append(counts[-1] + count)
        tokens.append(tokens[-1] + total)
    size = len(cells)
    best: list[int | None] = [0] + [None] * size
    choices: list[list[int]] = []
    for _ in range(min(buckets, size)):
        lines: deque[tuple[int, int, int]] = deque()  # slope, intercept, start cell
        now: list[int | None] = [None] * (size + 1)
        choice = [0] * (size + 1)
        for j in range(1, size + 1):
            i = j - 1
            if best[i] is not None:
                m, c = -counts[i], best[i] + tokens[i]
                while len(lines) > 1:
                    (m1, c1, _), (m2, c2, _) = lines[-2], lines[-1]
                    if (c - c1) * (m1 - m2) > (c2 - c1) * (m1 - m):
                        break
                    lines.pop()
                lines.append((m, c, i))
            if not lines:
                continue
            x = longest[j - 1]
            while len(lines) > 1 and lines[1][0] * x + lines[1][1] <= lines[0][0] * x + lines[0][1]:
                lines.popleft()
            m, c, i = lines[0]
            now[j], choice[j] = m * x + c + x * counts[j] - tokens[j], i
        best = now
        choices.append(choice)
    ends, j = [], size
    for choice in reversed(choices):
        ends.append(longest[j - 1])
        j = choice[j]
    return ends[::-1]


def boundaries(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The best boundaries for the ``length`` column of ``rows``; none for an empty table."""
    histogram = rows.groupBy(cell("length").alias("cell")).agg(
        F.max("length").alias("longest"), F.count("*").alias("n"), F.sum("length").alias("tokens")
    )
    cells = sorted((r.longest, r.n, r.tokens) for r in histogram.collect())
    return best_boundaries(cells, buckets) if cells else []


def pack(docs: DataFrame, length: Column | None = None, id_column: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, length, bucket, bucket_length, batch, slot, padding), one row per row of ``docs``.

    ``length`` is the number of words of ``text`` unless given; null counts as 0. ``batch`` counts from 0 inside a bucket,
    ``slot`` inside a batch. A document longer than the budget is a batch of its own. Null identifiers and repeated rows are
    packed like any other; an empty table gives an empty result.
    """
    if length is None:
        rows = located(docs, [id_column, "text"], "pack-rows").toDF("id", "text", PLACE)
        rows = rows.select("id", word_count(F.col("text")).alias("length"), PLACE)
    else:
        rows = docs.select(F.col(f"`{id_column}`").alias("id"), length.alias("length"))
        rows = located(rows, ["id", "length"], "pack-rows").withColumn("length", F.coalesce("length", F.lit(0)).cast("long"))
    rows = kept(rows.select("id", "length", F.col(f"{PLACE}.file").alias("file"), F.col(f"{PLACE}.position").alias("position")), "pack-slim")
    ends = boundaries(rows, buckets)
    limits = F.array(*(F.lit(e).cast("long") for e in ends)) if ends else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(limits, lambda e: e < F.col("length"))).cast("long"))
    rows = rows.withColumn("bucket_length", F.get(limits, F.col("bucket").cast("int")))

    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("chunks"))
    code = F.xxhash64("id", "position")
    rows = rows.join(sizes, "bucket").withColumn("chunk", F.pmod(code, "chunks")).withColumn("code", code)
    counts = rows.groupBy("bucket", "chunk").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("bucket").orderBy("chunk").rowsBetween(W.unboundedPreceding, W.currentRow))
    offsets = counts.select("bucket", "chunk", (upto - F.col("n")).alias("offset"))
    inside = F.row_number().over(W.partitionBy("bucket", "chunk").orderBy("code", "id", "position", "file"))
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))))
    number = F.col("offset") + F.col("inside") - 1
    return (
        rows.withColumn("inside", inside)
        .join(offsets, ["bucket", "chunk"])
        .select(
            F.col("id").alias("doc_id"),
            "length",
            "bucket",
            "bucket_length",
            F.floor(number / fit).alias("batch"),
            F.pmod(number, fit).alias("slot"),
            (F.col("bucket_length") - F.col("length")).alias("padding"),
        )
    )
