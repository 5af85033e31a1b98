"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from casewright.session import checkpoint_root


def working_table(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once and read back, so that later steps see the same rows even after a lost executor.

    The write is a job that runs at once, also while a query is still being built.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
