"""Tables kept between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.session import checkpoint_root

#: Column that holds a row's file and position; named so that no column of a table clashes with it.
PLACE = "_place_of_row"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset, under the warehouse."""
    return f"{checkpoint_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once and read back: cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def one_row_each(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` is a row of a file, and no two are the same one: scans, filters and columns only."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation"


def private_names(columns: list[str], known: tuple[str, ...] = ("doc_id", "text")) -> list[str]:
    """A name for each of ``columns`` that no working column has; the ``known`` ones keep theirs."""
    return [c if c in known else f"k{i}" for i, c in enumerate(columns)]


def located(docs: DataFrame, columns: list[str], purpose: str = "rows") -> DataFrame:
    """The named columns and ``PLACE``, which tells each row from every other: its file and its position there.

    Frames that don't come straight from files are written once first.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("position")
    ).alias(PLACE)
    wanted = [F.col(f"`{name}`") for name in columns]
    if "_metadata" not in docs.columns and one_row_each(docs):
        try:
            return docs.select(*wanted, place)
        except AnalysisException:
            pass
    return kept(docs.select(*wanted), purpose).select(*wanted, place)
