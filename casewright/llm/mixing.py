"""Mixing sources to target weights by nested hash thresholds.

Every document has a fixed 60-bit hash of its identifier; a budget takes the documents below a threshold, so that a
smaller budget's documents are among a larger one's and reruns agree. The threshold of a source is found from sums of
sizes by source and hash bucket: the bucket in which the budget is reached is refined by its next bits, over the rows of
that bucket only, until one hash is left in it; that one is taken if this brings the sum nearer. Nothing is sorted and a
source with a third of all rows is a few thousand partial sums per task.

A source's target may be up to ``most`` times its size: whole passes over the source come first, the rest is a budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casewright.llm.words import word_count
from casewright.llm.workspace import PLACE, kept, located

LEVELS = 5
BITS = 12
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def hash60(identifier: Column) -> Column:
    """The first 60 bits of the MD5 of the identifier's text; null counts as an empty text."""
    text = F.coalesce(identifier.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight): weights repeat over the sources by code point, null last."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source, not per document
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    return sources.withColumn("weight", F.get(weights, place))


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target``: shares by weight, none above ``most`` times its source, the excess reshared by weight.

    Needs ``source_size`` and ``weight``. Each pass caps the sources whose share is too large; a pass that caps none ends.
    """
    sources = kept(sources, "mix-sources")
    cap = most * F.col("source_size")
    rate, before = None, -1
    while True:
        full = F.lit(False) if rate is None else F.col("weight") * rate >= cap
        sums = sources.agg(
            F.sum("source_size").alias("whole"),
            F.sum(F.when(full, cap).otherwise(0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weights"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if sums.n == before or not sums.weights:
            break
        before, rate = sums.n, (share * sums.whole - sums.capped) / sums.weights
    best = cap.cast("double") if rate is None else F.least(F.col("weight") * rate, cap.cast("double"))
    return sources.withColumn("target", best)


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, passes, below): documents with a hash under ``below`` are taken once more than ``passes`` times.

    ``rows`` has source, hash and size; ``goals`` has source, source_size and target.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    state = goals.withColumn("passes", passes).select(
        "source", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix")
    )
    state = kept(state, "mix-state")
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * BITS
        inside = rows.alias("r").join(state.alias("s"), same("r", "s")).where(
            F.shiftright("r.hash", shift + BITS) == F.col("s.prefix") if level > 1 else F.lit(True)
        )
        sums = inside.groupBy("r.source", F.shiftright("r.hash", shift).alias("bucket")).agg(
            F.sum("r.size").alias("size"), (F.max("r.hash") == F.min("r.hash")).alias("single")
        )
        # At most 2**BITS rows per source, whatever the number of documents.
        running = F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
        edge = sums.withColumn("upto", running)
        joined = edge.alias("e").join(state.alias("s"), same("e", "s")).where("e.upto >= s.budget and s.budget > 0")
        bucket = joined.groupBy("s.source", "s.passes", "s.budget").agg(
            F.min(F.struct("e.bucket", "e.upto", "e.size", "e.single")).alias("at")
        )
        left = F.col("budget") - (F.col("at.upto") - F.col("at.size"))
        found = bucket.select("source", "passes", left.alias("budget"), F.col("at.bucket").alias("prefix"), F.col("at.size").alias("size"), F.col("at.single").alias("single"))
        state = state.alias("s").join(found.alias("f"), same("s", "f"), "left").select(
            "s.source",
            "s.passes",
            F.coalesce("f.budget", F.lit(0.0)).alias("budget"),
            F.coalesce("f.prefix", F.lit(0)).cast("long").alias("prefix"),
            F.col("f.size").alias("size"),
            F.coalesce("f.single", F.lit(True)).alias("single"),
        )
        state = kept(state, "mix-state")
        if level == LEVELS or state.where("not single").isEmpty():
            break
        state = state.select("source", "passes", "budget", "prefix")
    # What lies under the boundary bucket is in; its one hash is in if that is nearer to the budget.
    nearer = F.when((F.col("budget") > 0) & (2 * F.col("budget") >= F.col("size")), 1).otherwise(0)
    return state.select("source", "passes", ((F.col("prefix") + nearer) * F.lit(1 << shift)).cast("long").alias("below"))


class Mix:
    """One mix over ``docs``: sizes and hashes in a slim table, targets per source, thresholds, copies per row.

    A null source is a source of its own, last in order; a null text has size 0 and is taken with its hash like any other;
    rows with one identifier share one fate; with no words at all, or no rows, every target is 0. Other columns are never read.
    """

    def __init__(self, docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text"):
        rows = located(docs, [id_column, source_column, text_column], "mix-rows").toDF("id", "source", "text", PLACE)
        self.rows = kept(
            rows.select("id", "source", hash60(F.col("id")).alias("hash"), word_count(F.col("text")).alias("size"), PLACE), "mix-slim"
        )
        self.goals = kept(targets(ranked_sources(self.rows)), "mix-goals")
        cuts = thresholds(self.rows, self.goals)
        plan = self.goals.alias("g").join(cuts.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")))
        # Written, so that its size is known: one row per source.
        self.plan = kept(plan.select("g.source", "g.source_size", "g.target", "c.passes", "c.below"), "mix-plan")

    def planned(self, rows: DataFrame) -> DataFrame:
        """``rows`` (source, hash and others) with source_size, target and the copies that the mix takes of each."""
        copies = F.col("p.passes") + F.when(F.col("r.hash") < F.col("p.below"), 1).otherwise(0)
        return rows.alias("r").join(self.plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select(
            "r.*", "p.source_size", "p.target", copies.alias("copies")
        )

    def documents(self) -> DataFrame:
        """(id, source, hash, size, place, source_size, target, copies) for every row."""
        return self.planned(self.rows)


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs``."""
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return Mix(docs).documents().select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken)


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, its columns whatever their names.

    Copies follow from a row's own hash and the plan of its source, so texts are joined with one row per source only.
    Nulls, ties, repeated rows and empty tables are as in ``Mix``.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows = docs.select(F.col("source"), hash60(F.col("doc_id")).alias("hash"), whole)
    again = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return Mix(docs).planned(rows).where("copies > 0").select("whole", again).select("whole.*")
