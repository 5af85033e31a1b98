"""Registered text queries against DuckDB where SQL expresses them, and the pipeline stage by stage."""

import brute
import oracle
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from casewright.llm import mixing, packing, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = oracle.connect(FOLDER)
    yield con
    con.close()


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    assert oracle.compare(queries.QUERIES[name](spark, FOLDER), duck, queries.ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - {"op11_ranked_search"}))
def test_query_returns_every_row(spark, name):
    table = {"op1_url_filter": "pages"}.get(name, "documents")
    wanted = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if name in ("op7_chat_formatting", "op13_turn_repair"):
        wanted = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count()
        wanted += name == "op7_chat_formatting"
    assert queries.QUERIES[name](spark, FOLDER).count() == wanted


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
        docs = seen[name][1]
    before, after = (x.collect() for x in seen["exact_dedup"])
    best = {}
    for r in before:
        best[brute.lower(r.text)] = max(r.doc_id, best.get(brute.lower(r.text), -1))
    assert sorted(r.doc_id for r in after) == sorted(best.values())
    before, after = (x.collect() for x in seen["near_dedup"])
    roots = brute.near_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({root for _, root in roots.values()})
    before, after = seen["mixing"]
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(before).collect() if r.size}
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, n in taken.items() for _ in range(n))
    before, after = seen["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = [len(library.encode(r.text or "", add_special_tokens=False).ids) for r in before.collect()]
    packed = after.toPandas()
    assert sorted(packed.length) == sorted(sizes)
    batches = packed.groupby(["bucket", "batch"]).agg(longest=("bucket_length", "max"), rows=("length", "size"), tokens=("length", "sum"))
    assert ((batches.longest * batches.rows <= packing.BUDGET) | (batches.rows == 1)).all()
    assert ((batches.tokens <= packing.BUDGET) | (batches.rows == 1)).all()
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).select("doc_id", "length", "bucket").collect())) == sorted(
        map(str, after.select("doc_id", "length", "bucket").collect())
    )


ADDED = ["kept", "k0", "expected_grade", "tail_probability", "keep_id", "group_size", "component_id", "n_shingles", "node", "key", "size"]
ADDED += ["taken", "target", "_copy", "_copies", "_place_of_row", "length", "n_tokens", "bucket", "id", "place", "digest", "code", "file"]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_clashing_names_nulls_and_an_empty_table(spark, tmp_path, empty):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs.limit(20).union(docs.limit(20)).union(spark.createDataFrame([(None,) * len(docs.columns)] * 2, docs.schema))
    odd = odd.select("*", *(F.lit(f"of {name}").alias(name) for name in ADDED if name not in docs.columns))
    odd.limit(0 if empty else 100).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        if name != "packing":
            assert out.columns == odd.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "near_dedup" and not empty:
            left = rows.collect()
            assert left and all(r[a] == f"of {a}" for r in left for a in ADDED if a not in docs.columns)
            assert len({r.text for r in left}) == len(left)
    assert (rows.count() == 0) == empty
