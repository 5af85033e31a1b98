"""Robust multivariate outliers among documents: minimum-covariance-determinant estimates per language and source.

Only DataFrame expressions are used. Each document gets base counts, from them a vector of transformed statistics in
whole steps of 1/256, and the distance of that vector from its group's robust centre. The estimates come from
concentration steps: the three quarters of a group that lie nearest to the present centre give the next centre and
covariance. Two starts (unit scales, and scales from median deviations, both round the medians) run side by side and the
one with the smaller determinant is taken. Because the statistics and the logarithm of a distance move in whole steps,
medians and the cut at three quarters are exact percentiles over a small count of values, sums are exact, and a group with
a third of all rows is a partial aggregate like any other. ``FLOORS`` are added to the scales, so that a statistic that
never varies in a group does not reject the first document in which it does.

A group of fewer than ``MIN_GROUP`` documents is judged by the estimate of its language, one of a language that has fewer
than that by the estimate of all documents; so each document that passes the base rule is judged.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.words import CONTROLS, filled, words
from casewright.llm.workspace import kept

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
STATISTICS = ("word_length", "symbols", "dup_lines", "repeats")
FLOORS = (0.05, 0.10, 0.25, 0.05)
SCALE = 256
NEAREST = 0.75
STEPS = 3
STARTS = (0, 1)
MIN_GROUP = 20
#: Squared distance beyond which a vector is an outlier: 1 - 1e-6 of a chi-square of four degrees lies below.
LIMIT = 33.4
#: Median of a chi-square of four degrees of freedom.
MEDIAN = 3.3567
DISTANCE_STEPS = 64
PAIRS = list(combinations_with_replacement(range(len(STATISTICS)), 2))


def base_counts(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """``keep`` and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text; null is empty."""
    text = filled(F.col(f"`{text_column}`"))
    shown = F.translate(text, CONTROLS + " ", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, CONTROLS + " ", "") != "")
    counted = docs.select(
        *keep,
        F.length(shown).cast("long").alias("word_chars"),
        (F.length(shown) - F.length(F.translate(shown, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform(words(F.col(f"`{text_column}`")), lambda w: F.xxhash64(w)).alias("_codes"),
    )
    codes = F.col("_codes")
    window = lambda h, i: F.struct(F.xxhash64(h, F.get(codes, i + 1), F.get(codes, i + 2)).alias("h"), i.alias("i"))
    short = F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 2, F.lit(0)))
    counted = counted.withColumn("_windows", F.sort_array(F.transform(short, window)))
    sorted_ = F.col("_windows")
    same = lambda x, k: F.coalesce(F.get(sorted_, k)["h"] == x["h"], F.lit(False))
    twice = F.transform(F.filter(sorted_, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
    counted = counted.withColumn("_starts", F.sort_array(twice))
    starts = F.col("_starts")
    covered = F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3))))
    return counted.select(
        *keep,
        F.size(codes).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def statistics() -> list[Column]:
    """The transformed statistics in whole steps; a text without words counts as one of one word."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.col("n_repeat_words") / n,
    )
    return [F.round(v * SCALE).cast("long").alias(name) for v, name in zip(values, STATISTICS, strict=True)]


def group_key(*columns: str) -> Column:
    """One text for a group; null is a group of its own."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    return F.concat_ws("\0", *(part(c) for c in columns))


def models(rows: DataFrame) -> DataFrame:
    """(g, model, feeds) of each group of ``rows`` (g, wide): the key of the estimate that judges it and of those it is part of."""
    sizes = kept(rows.groupBy("g", "wide").agg(F.count("*").alias("n")), "mcd-sizes")
    wide = sizes.groupBy("wide").agg(F.sum("n").alias("wide_n"), F.min("n").alias("least"))
    own, wider, every = F.concat(F.lit("0"), "g"), F.concat(F.lit("1"), "wide"), F.lit("2")
    enough, wide_enough = F.col("n") >= MIN_GROUP, F.col("wide_n") >= MIN_GROUP
    named = kept(
        sizes.join(wide, "wide").select(
            "g",
            F.when(enough, own).when(wide_enough, wider).otherwise(every).alias("model"),
            F.when(enough, own).alias("own"),
            F.when(wide_enough & (F.col("least") < MIN_GROUP), wider).alias("wider"),
        ),
        "mcd-named",
    )
    # All documents are estimated only where a language is too small.
    last = every if named.where(F.col("model") == every).limit(1).count() else F.lit(None).cast("string")
    return kept(named.select("g", "model", F.array_compact(F.array("own", "wider", last)).alias("feeds")), "mcd-models")


def factor(estimates: DataFrame) -> DataFrame:
    """Adds the inverse of the Cholesky factor of the floored covariance (i_rc) and its log determinant."""
    size = len(STATISTICS)
    rows = estimates
    floors = [(f * SCALE) ** 2 for f in FLOORS]
    for r in range(size):
        for c in range(r + 1):
            dot = sum((F.col(f"l_{r}{k}") * F.col(f"l_{c}{k}") for k in range(c)), F.lit(0.0))
            value = F.col(f"c_{c}{r}") - dot + (F.lit(floors[r]) if r == c else 0.0)
            rows = rows.withColumn(f"l_{r}{c}", F.sqrt(value) if r == c else value / F.col(f"l_{c}{c}"))
    for r in range(size):
        for c in range(r + 1):
            if r == c:
                value = 1.0 / F.col(f"l_{r}{r}")
            else:
                value = -sum((F.col(f"l_{r}{k}") * F.col(f"i_{k}{c}") for k in range(c, r)), F.lit(0.0)) / F.col(f"l_{r}{r}")
            rows = rows.withColumn(f"i_{r}{c}", value)
    volume = sum((F.log(F.col(f"l_{r}{r}")) for r in range(size)), F.lit(0.0)) * 2
    inverse = [f"i_{r}{c}" for r in range(size) for c in range(r + 1)]
    return rows.select("g", "start", *(f"m_{r}" for r in range(size)), *inverse, volume.alias("volume"))


def distance() -> Column:
    """Squared Mahalanobis distance of a row's statistics from the estimates joined to it."""
    gaps = [F.col(name) - F.col(f"m_{r}") for r, name in enumerate(STATISTICS)]
    parts = [sum((F.col(f"i_{r}{c}") * gaps[c] for c in range(r + 1)), F.lit(0.0)) for r in range(len(STATISTICS))]
    return sum((p * p for p in parts), F.lit(0.0))


def stepped(d: Column) -> Column:
    return F.floor(F.log(d + 1e-6) * DISTANCE_STEPS).cast("long")


def moments(rows: DataFrame) -> DataFrame:
    """Mean (m_r) and covariance (c_rc) of the statistics by group and start, from exact sums."""
    whole = lambda c: c.cast("decimal(38,0)")
    sums = rows.groupBy("g", "start").agg(
        F.count("*").cast("double").alias("n"),
        *(F.sum(whole(F.col(s))).cast("double").alias(f"s_{r}") for r, s in enumerate(STATISTICS)),
        *(F.sum(whole(F.col(STATISTICS[r]) * F.col(STATISTICS[c]))).cast("double").alias(f"p_{r}{c}") for r, c in PAIRS),
    )
    n = F.col("n")
    return sums.select(
        "g",
        "start",
        *((F.col(f"s_{r}") / n).alias(f"m_{r}") for r in range(len(STATISTICS))),
        *((F.col(f"p_{r}{c}") / n - F.col(f"s_{r}") / n * F.col(f"s_{c}") / n).alias(f"c_{r}{c}") for r, c in PAIRS),
    )


def first_estimates(rows: DataFrame) -> DataFrame:
    """Medians as centre; covariance of start 0 is zero (so the floors alone), of start 1 from median deviations."""
    half = F.lit(0.5)
    centre = kept(
        rows.groupBy("g").agg(*(F.percentile(s, half).alias(f"m_{r}") for r, s in enumerate(STATISTICS))), "mcd-centre"
    )
    spread = rows.join(centre, "g").groupBy("g").agg(
        *(F.percentile(F.abs(F.col(s) - F.col(f"m_{r}")), half).alias(f"d_{r}") for r, s in enumerate(STATISTICS))
    )
    both = centre.join(spread, "g").withColumn("start", F.explode(F.array(*map(F.lit, STARTS))))
    scale = lambda r: F.when(F.col("start") == 0, 0.0).otherwise((1.4826 * F.col(f"d_{r}")) ** 2)
    return both.select(
        "g",
        "start",
        *(f"m_{r}" for r in range(len(STATISTICS))),
        *((scale(r) if r == c else F.lit(0.0)).alias(f"c_{r}{c}") for r, c in PAIRS),
    )


def estimates(rows: DataFrame) -> DataFrame:
    """Final centre, inverse factor and consistency factor of each group of ``rows`` (g and the statistics)."""
    now = kept(factor(first_estimates(rows)), "mcd-step")
    for _ in range(STEPS):
        far = rows.join(now, "g").withColumn("d", stepped(distance()))
        cut = far.groupBy("g", "start").agg(F.ceil(F.percentile("d", F.lit(NEAREST))).alias("cut"))
        # With the estimates in one small table, the rows need no shuffle by group to learn their cut.
        limits = kept(now.join(cut, ["g", "start"]), "mcd-cut")
        near = rows.join(limits, "g").where(stepped(distance()) <= F.col("cut")).select("g", "start", *STATISTICS)
        now = kept(factor(moments(near)), "mcd-step")
    best = now.groupBy("g").agg(F.min(F.struct("volume", "start")).alias("best")).select("g", F.col("best.start").alias("start"))
    best = kept(now.join(best, ["g", "start"]).drop("start", "volume"), "mcd-best")
    middle = rows.join(best, "g").groupBy("g").agg(F.percentile(stepped(distance()), F.lit(0.5)).alias("middle"))
    consistent = F.greatest(F.lit(1.0), F.exp(F.col("middle") / DISTANCE_STEPS) / MEDIAN)
    return best.join(middle, "g").withColumn("consistent", consistent).drop("middle")


def judge(docs: DataFrame, keep: list[str], language: str = "lang", source: str = "source") -> DataFrame:
    """``keep``, the base counts, base_failed, distance and kept, one row per row of ``docs``.

    Null languages and sources form groups of their own; a null text has no words and fails the base rule; repeated rows count
    as often as they occur. Documents that fail the base rule take no part in the estimates; their distance is null. A group
    with fewer than ``MIN_GROUP`` others is judged by the estimate of all sources of its language, and where these are fewer
    too, by that of all documents, whatever their number. An empty table gives an empty result. The scale is never narrowed
    below the floored covariance.
    """
    groups = [group_key(language, source).alias("g"), group_key(language).alias("wide")]
    named = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col("`text`"), *groups)
    keys = [f"k{i}" for i in range(len(keep))]
    counts = kept(base_counts(named, [*keys, "g", "wide"]).withColumn("base_failed", base_failed()), "mcd-counts")
    rows = counts.where("not base_failed").select("g", "wide", *statistics())
    judges = models(rows)
    fed = rows.join(judges, "g").select(F.explode("feeds").alias("g"), *STATISTICS)
    final = estimates(kept(fed, "mcd-fed")).withColumnRenamed("g", "model")
    final = kept(judges.select("g", "model").join(final, "model").drop("model"), "mcd-final")
    own = counts.join(final, "g", "left").select("*", *statistics())
    d = F.when(~F.col("base_failed"), distance() / F.col("consistent"))
    return own.select(
        *(F.col(k).alias(c) for k, c in zip(keys, keep, strict=True)),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        d.alias("distance"),
        (~F.col("base_failed") & (d <= LIMIT)).alias("kept"),
    )
