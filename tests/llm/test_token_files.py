"""Files of token ids: exact round trips and the library's own ids."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from casewright.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def library(texts):
    found = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, 0], "<u4") for e in found]


def plain(rows):
    start, out = 0, []
    for (doc_id, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def result(spark, docs):
    got = token_files.read_back(token_files.encode(docs, PATH))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    return sorted(map(tuple, got.collect()), key=lambda r: (r[1], r[2]))


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    kinds = [
        rng.integers(0, 50_257, 128 * 300),
        np.where(rng.random(128 * 300) < 0.05, rng.integers(0, 2**32, 128 * 300), rng.integers(7, 20, 128 * 300)),
        np.zeros(128 * 3), np.full(128, 2**32 - 1), rng.integers(0, 2**32, 128 * 50), np.arange(128 * 9) % 2 * (2**32 - 1),
    ]
    for ids in kinds:
        ids = ids.astype(np.uint32)
        data, sizes = token_files.pack_blocks(ids)
        assert len(data) == sizes.sum()
        assert (token_files.unpack_blocks(np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes) == ids).all()
    few = np.where(np.arange(128 * 10) % 16 == 0, 2**31, 5).astype(np.uint32)
    assert (token_files.pack_blocks(few)[1] == token_files.BLOCK_HEAD.itemsize + 8 * 5).all()


@pytest.mark.parametrize("total", [0, 1, 127, 128, 129, 50_000])
def test_ids_are_read_from_the_middle(tmp_path, total):
    ids = np.random.default_rng(total).integers(0, 50_257, total).astype(np.uint32)
    name = uuid.uuid4().hex
    out = token_files.FileWriter(str(tmp_path), name)
    for part in np.array_split(ids, 7):
        out.add([len(part)], np.array([len(part)]), part)
    out.close()
    for folder in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        file = token_files.FileReader(folder, name)
        assert file.tables.total == total
        for first, end in ((0, total), (total // 3, total // 2), (total, total), (max(total - 1, 0), total)):
            assert (file.ids(first, end) == ids[first:end]).all()


def test_encoder_equals_the_library():
    rng = random.Random(2)
    letters = " \n\t,.!?;:'sdtabéßÉ×÷1 　\x85\x1c᠎ 一\U0001f600"
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(5000)]
    texts += [f"a{chr(c)} b{chr(c)}. {chr(c)} x, {chr(c)}," for c in range(1, 0x3200)]
    texts += [None, "", "a<|endoftext|> b", "<|endoftext|>", "<|endoftext|", " " * 1000, "x" * 5000, "it's we'll I'd. they're,"]
    with open(PATH, encoding="utf-8") as file:
        encoder = token_files.Encoder(file.read())
    got = []
    for _, _, counts, ids in encoder.encode(pa.array(texts, pa.string())):
        got += [r.tolist() for r in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [r.tolist() for r in library(texts)]
    # What is remembered, and forgetting it, changes nothing.
    again = [ids for _, _, _, ids in encoder.encode(pa.array(texts[::-1], pa.string()))]
    encoder.forget()
    assert [i.tolist() for i in again] == [ids.tolist() for _, _, _, ids in encoder.encode(pa.array(texts[::-1], pa.string()))]


def test_documents_in_order_over_many_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 700)
    rng = random.Random(3)
    rows = [(k * 7 - 300, " ".join(rng.choices("the of Was, naïve. 12 \n\n".split(" "), k=rng.randrange(200)))) for k in range(150)]
    rows.append((10**12, "long " * 100_000))
    mixed = rng.sample(rows, len(rows))
    docs = spark.createDataFrame(mixed, SCHEMA).repartition(7)
    files = token_files.encode(docs, PATH)
    assert files.manifest.count() > 5
    assert sorted(map(tuple, token_files.read_back(files).collect()), key=lambda r: r[1]) == plain(rows)


def test_edges(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "same"), (3, "same"), (3, "other"), (4, "<|endoftext|>")]
    got = result(spark, spark.createDataFrame(rows, SCHEMA))
    assert [r[0] for r in got] == [None, 1, 2, 3, 3, 3, 4]
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    wanted = plain(rows)
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(((r[0], r[2], r[3]) for r in wanted), key=str)
    assert result(spark, spark.createDataFrame([], SCHEMA)) == []
    wide = spark.createDataFrame([(5, "a b", 1, "x", "y", 2)], "doc_id long, text string, start int, id string, file string, position int")
    assert result(spark, wide) == plain([(5, "a b")])


def test_files_of_lost_tasks_are_not_read(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], SCHEMA)
    files = token_files.encode(docs, PATH)
    stray = token_files.FileWriter(files.folder, "ids-stray.cwpf")
    stray.add([99], np.array([2]), np.array([5, 0]))
    stray.close()
    assert token_files.read_back(files).count() == 20
