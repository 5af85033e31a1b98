"""Session construction and the cluster-wide settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Wall-clock timestamps are timestamp_ntz everywhere; UTC keeps casts free of local rules.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot join key is split even where the next operator would have reused the partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Recording the Python call site of every column expression takes about half of the planning time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "casewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above. ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints, stream state and working tables.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset it lies under the warehouse, so a
    restarted stream finds its state again.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/casewright-work"
