"""Places of rows: told apart whatever the frame is made of."""

from pyspark.sql import functions as F

from casewright.llm.workspace import PLACE, located

FOLDER = "/root/testdata/sf0.001"


def places(df):
    return df.select(PLACE).distinct().count(), df.count()


def test_rows_of_files_are_not_copied(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = located(docs.where("doc_id % 2 = 0"), ["doc_id"])
    assert places(found) == (100, 100)
    assert found.select(f"{PLACE}.file").first()[0].endswith("documents.parquet")


def test_repeated_rows_get_places_of_their_own(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id")
    assert places(located(docs.union(docs), ["doc_id"])) == (400, 400)
    again = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    assert places(located(again, ["doc_id", "k"])) == (400, 400)
    assert places(located(spark.createDataFrame([(1,), (1,)], "doc_id long"), ["doc_id"])) == (2, 2)
