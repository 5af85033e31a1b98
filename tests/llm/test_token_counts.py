"""Token counts against the library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casewright.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
POOL = "abcXYZ 019\n\t'é中\U0001f600!?.,<|>endoftext  ́٠²\x1c\x85 "


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    fixed = [
        "", "a", "aaaaaaaaaaaaa", "hello world's  don't  \n\n x", "x<|endoftext|>y<|endoftext|><|endoftext|> z", "<|endoftext|>", "<|endof",
        "a" * 5000, "ab" * 3333, "!!!!!!????", "\x00\x01", " " * 300, "²³½ ① x", "א ב ג", "word " * 60_000,
    ]
    return fixed + ["".join(rng.choice(POOL) for _ in range(rng.randrange(60))) for _ in range(3000)]


@pytest.fixture(scope="module")
def wanted(texts):
    return [len(x.ids) for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_librarys(texts, wanted, monkeypatch):
    merges = token_counts.load_merges(PATH)
    assert token_counts.Counter(merges).count(texts) == wanted
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    counter = token_counts.Counter(merges)
    assert [n for k in range(0, len(texts), 50) for n in counter.count(texts[k : k + 50])] == wanted


def test_every_character_is_cut_as_the_library_does():
    texts = [f"a{c}1{c}\u4e00 {c}!{c}" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    merges, library = token_counts.Counter(token_counts.load_merges(PATH)), Tokenizer.from_file(PATH)
    for k in range(0, len(texts), 50_000):
        part = texts[k : k + 50_000]
        assert merges.count(part) == [len(x.ids) for x in library.encode_batch(part, add_special_tokens=False)]


def test_table(spark, texts, wanted):
    rows = [(k, t, 0) for k, t in enumerate(texts[:200])] + [(None, None, 0), (5, texts[5], 0)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (0, 0, False)
        else:
            assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), wanted[r.doc_id])
            assert r.over_limit == (r.n_tokens > 1024)
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_unknown_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.load_merges(public_tokenizers.path("word_bpe_49k.json"))
