"""Words and shingles of a batch against regular expressions."""

import brute
import pyarrow as pa
import pytest

from casewright.llm import ragged

TEXTS = [
    "", None, "a b c d e f", "A B c D e f a b c d e", "x", "x y", "  lead  and trail \n", "é à b c d e f g", "a b c d e",
    "a  b\tc\x0bd e", " ", "A", "\x1f\xa0 b", "w " * 50, *("w%d " % (i % 7) * 3 for i in range(12)),
]


@pytest.mark.parametrize("size", [1, 30, 1 << 21])
def test_shingles_are_the_distinct_word_windows(size):
    data, offsets = ragged.as_bytes(pa.array(TEXTS))
    found = {}
    for first, end, part, part_of in ragged.blocks(data, offsets, size):
        sets, of = ragged.shingles(part, part_of)
        for k in range(first, end):
            found[k] = set(sets[of[k - first] : of[k - first + 1]].tolist())
    wanted = [brute.shingles(t) for t in TEXTS]
    for i, a in enumerate(wanted):
        for j, b in enumerate(wanted):
            assert len(found[i] & found[j]) == len(a & b), (TEXTS[i], TEXTS[j])


def test_sliced_and_empty_columns():
    column = pa.array(["aa bb", None, "cc"])
    data, offsets = ragged.as_bytes(column.slice(1))
    assert bytes(data) == b"cc" and offsets.tolist() == [0, 0, 2]
    data, offsets = ragged.as_bytes(pa.array([], pa.string()))
    assert len(data) == 0 and list(ragged.blocks(data, offsets)) == []
