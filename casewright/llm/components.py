"""Connected components of a graph given as pairs, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from casewright.llm.workspace import kept


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (as ``components`` gives them) with more ``links`` (a, b): only what they join is worked on anew."""

    def named(end: str) -> DataFrame:
        return roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))

    a, b = (F.coalesce(f"root_{end}", end).alias(end) for end in "ab")
    joined = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(a, b).where("a != b")
    joined = kept(joined.distinct(), "edges")
    if joined.isEmpty():
        return roots
    higher = components(joined)
    moved = roots.alias("r").join(higher.alias("h"), F.col("r.root") == F.col("h.node"), "left")
    return kept(moved.select("r.node", F.coalesce("h.root", "r.root").alias("root")).union(higher), "roots")


def components(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): every node of ``pairs`` that isn't the smallest of its component, and that smallest one.

    Each round points every neighbour of a node to the smallest of them, first upwards, then downwards, until
    nothing changes; the number of rounds grows with the logarithm of a component's size. A node with very many
    neighbours is one partial minimum per task and a join that adaptive execution splits. Loops, repeated pairs,
    null ends (left out) and an empty table are all right.
    """
    a, b = F.col(left), F.col(right)
    edges = kept(
        pairs.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        rest = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        found = rest.union(least.select("hi", F.col("m").alias("lo"))).distinct()
        told = Observation()
        edges = kept(found.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("hash")), "edges")
        now = told.get
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
