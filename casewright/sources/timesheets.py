"""Timesheet files: preamble, header, rows up to the first empty record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.sources.working import working_table

# The layout of the payroll export.
PREAMBLE_LINES = 8
NAME, TOTAL, REST = "Name", "Total hours", "Rest break"
FILE_RANGE = r"(\d{4}-\d{2}-\d{2})-to-(\d{4}-\d{2}-\d{2})"

_FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line, quotes removed."""
    raw = F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1))
    return F.transform(
        raw,
        lambda f: F.when(
            f.startswith('"'),
            F.regexp_replace(F.regexp_replace(f, '^"|"$', ""), '""', '"'),
        ).otherwise(f),
    )


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, file, value and line (from 1 in each file) of every line of text files.

    Files are read once, in blocks, and their lines written to a working table; the write is a job that runs at once. Lines
    are counted per block and the counts summed up along each file, so a file of many blocks is numbered by many tasks and
    a window only ever holds one row per block.
    """
    read = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),  # grows along a block, which one task reads
    )
    lines = working_table(read, "file-lines")
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    places = blocks.select("path", "block", (before - F.col("start")).alias("shift"))
    return lines.join(places, ["path", "block"]).select("path", "file", "value", (F.col("at") + F.col("shift") + 1).alias("line"))


def read_timesheets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """date, end_date, name and work hours of every timesheet row, any number of files per job.

    The date range comes from the file name, work hours are total minus rest break; what is not a
    number counts as missing, and a missing total gives zero.
    """
    start = F.regexp_extract("file", FILE_RANGE, 1)
    dated = F.when(
        start == "", F.raise_error(F.concat(F.lit("no date range in file name: "), "file"))
    ).otherwise(start)
    lines = numbered_lines(spark, paths)
    table = (
        lines.filter((F.col("line") > PREAMBLE_LINES) & (F.col("value") != ""))
        .withColumn("row", csv_fields(F.col("value")))
    )
    empty = F.forall("row", lambda field: field == "")
    bounds = table.groupBy("path").agg(
        F.min_by("row", "line").alias("header"),
        F.min("line").alias("first"),
        F.min(F.when(empty, F.col("line"))).alias("end"),
    )
    exploded = (
        table.join(bounds, "path")
        .filter("line > first AND (end IS NULL OR line < end)")
        .select(
            dated.cast("date").alias("date"),
            F.regexp_extract("file", FILE_RANGE, 2).cast("date").alias("end_date"),
            "header",
            "row",
        )
    )

    def value(name: str) -> Column:
        position = F.array_position(F.col("header"), name).cast("int")
        return F.try_element_at(F.col("row"), F.nullif(position, F.lit(0)))

    hours = value(TOTAL).try_cast("double") - F.coalesce(value(REST).try_cast("double"), F.lit(0.0))
    return exploded.select(
        "date", "end_date", value(NAME).alias("name"), F.coalesce(hours, F.lit(0.0)).alias("work_hours")
    )
