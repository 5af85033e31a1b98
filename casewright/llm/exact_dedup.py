"""Exact duplicates by a stateful stream: state per digest, kept for ever, and a check of full bytes on every hit.

Rows arrive as (digest, identifier, content locator). The stream keeps, for each digest, the locator and identifier
of the row that stays (largest identifier, then latest place) and the number of rows seen; the state has no expiry and
lives in RocksDB on the executors' disks with its log in the shared folder. Each task first combines its own rows of a
digest, so that a text which makes up a third of all rows reaches the state as one row per task. Texts never enter the
state: a hit is checked by fetching both texts through their locators and comparing all bytes. Rows whose bytes differ
in spite of an equal digest are grouped anew among themselves until none are left.

Texts are equal when they are identical after A-Z became a-z; a null text is the empty text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.workspace import PLACE, kept, located, private_names, shared_folder

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Every state partition would set aside some megabytes of disk for its logs before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
FILES_PER_BATCH = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ARRIVALS = "digest string, id long, file string, position long"


def normal_text(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def latest(rows: DataFrame) -> DataFrame:
    """For each digest: the row that stays and the number of rows."""
    return rows.groupBy("digest").agg(F.max(F.struct("id", "file", "position")).alias("last"), F.count("*").alias("n"))


class ExactDedup:
    """A deduplication that can take more documents at any time.

    ``folder`` holds arrivals, state and results; giving the folder of an earlier run goes on from its state, in which
    case every frame added before has to be added again with ``seen=True`` so that locators can be followed.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.digest = spark, digest
        self.folder = folder or shared_folder(spark, "exact")
        self.sources: list[DataFrame] = []

    def add(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seen: bool = False) -> ExactDedup:
        """Sends the rows of ``docs`` through the stream. Null texts and identifiers, repeated rows and empty tables are all right."""
        rows = located(docs, [id_column, text_column], "exact-rows").toDF("id", "text", PLACE)
        rows = rows.select(F.col("id").cast("long"), normal_text(F.col("text")).alias("text"), PLACE)
        self.sources.append(rows)
        if not seen:
            arrived = rows.select(self.digest(F.col("text")).alias("digest"), "id", f"{PLACE}.file", f"{PLACE}.position")
            arrived.write.mode("append").parquet(f"{self.folder}/arrivals")
            self._stream()
        return self

    def _stream(self) -> None:
        """Takes in what has arrived since the last call; a call that was cut off is repeated from its log."""
        before = {key: self.spark.conf.get(key, None) for key in STATE_SETTINGS}
        for key, value in STATE_SETTINGS.items():
            self.spark.conf.set(key, value)
        try:
            arrivals = (
                self.spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{self.folder}/arrivals")
            )
            changes = f"{self.folder}/changes"
            (
                latest(arrivals)
                .writeStream.outputMode("update")
                .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{changes}/batch={number}"))
                .option("checkpointLocation", f"{self.folder}/state")
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)

    def arrivals(self) -> DataFrame:
        return self.spark.read.schema(ARRIVALS).parquet(f"{self.folder}/arrivals")

    def view(self) -> DataFrame:
        """The newest state of each digest, from the changes that the stream has written."""
        schema = "digest string, last struct<id: long, file: string, position: long>, n long, batch long"
        changes = self.spark.read.schema(schema).parquet(f"{self.folder}/changes")
        return changes.groupBy("digest").agg(F.max(F.struct("n", "last")).alias("top")).select("digest", "top.last", "top.n")

    def _differing(self, rows: DataFrame, view: DataFrame) -> DataFrame:
        """Places of the rows whose full text is not that of the row that stays under their digest."""
        shared = view.where("n > 1").select("digest", F.struct("last.file", "last.position").alias("stays"))
        texts = reduce(DataFrame.union, self.sources).select(PLACE, "text")
        hits = rows.select("digest", F.struct("file", "position").alias(PLACE)).join(shared, "digest")
        members = hits.where(F.col(PLACE) != F.col("stays")).select(PLACE, "digest").join(texts, PLACE)
        stays = shared.select(F.col("stays").alias(PLACE), "digest").join(texts, PLACE).select("digest", F.col("text").alias("kept_text"))
        return members.join(stays, "digest").where("text != kept_text").select(f"{PLACE}.file", f"{PLACE}.position")

    def documents(self) -> DataFrame:
        """(id, file, position, keep_id, group_size, kept, digest), one row per row added.

        Of rows with one text and one identifier exactly one is kept; a null identifier counts as the smallest.
        """
        place = ["file", "position"]
        rows, view, parts = self.arrivals(), kept(self.view(), "exact-view"), []
        while True:
            wrong = kept(self._differing(rows, view), "exact-differing")
            if wrong.isEmpty():
                parts.append(rows.join(view, "digest"))
                break
            right = rows.join(wrong, place, "left_anti")
            parts.append(right.join(latest(right), "digest"))
            rows = kept(rows.join(wrong, place, "left_semi"), "exact-again")
            view = latest(rows)
        return reduce(DataFrame.unionByName, parts).select(
            "id",
            "file",
            "position",
            F.col("last.id").alias("keep_id"),
            F.col("n").alias("group_size"),
            F.struct("file", "position").eqNullSafe(F.struct("last.file", "last.position")).alias("kept"),
            "digest",
        )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    A null text is the empty text; texts of any length are read whole; of rows with one text and one identifier one is kept,
    a null identifier counts as the smallest; an empty table gives an empty result; other columns are never read.
    """
    run = ExactDedup(docs.sparkSession).add(docs)
    return run.documents().select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row keeps, with its columns, whatever the names of these.

    A null text is the empty text and a null identifier the smallest; texts of any length are read whole; of repeated rows
    one stays; an empty table gives an empty result.
    """
    columns, names = docs.columns, private_names(docs.columns)
    whole = located(docs.toDF(*names), names, "exact-docs")
    stay = ExactDedup(docs.sparkSession).add(whole).documents().where("kept").select(F.struct("file", "position").alias(PLACE))
    return whole.join(stay, PLACE, "left_semi").select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)))
