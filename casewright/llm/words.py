"""Words as column expressions: maximal runs of characters other than blank and the controls 9 to 13."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROLS = "\t\n\x0b\f\r"


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of ``text`` in order; null has none."""
    plain = F.translate(filled(text), CONTROLS, " " * len(CONTROLS))
    return F.array_remove(F.split(plain, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")
