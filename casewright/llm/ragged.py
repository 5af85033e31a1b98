"""Texts of a batch as one byte array with offsets, and words and shingles on it without a loop over rows.

Words are maximal runs of bytes other than blank and the controls 9 to 13, as in ``[^\\x20\\x09-\\x0D]+``.
All arithmetic is modulo 2**64, so results are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
WORDS = 5
BLOCK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def numbers(seed: int, count: int) -> np.ndarray:
    """Fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BASE = 0x9E3779B97F4A7C15
BYTE_CODES = numbers(11, 256)
SHINGLE_WEIGHTS = numbers(12, WORDS) | U64(1)
POWERS: dict[str, np.ndarray] = {}


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, grown when a longer block comes."""
    if POWERS.get("up", np.empty(0)).size < size:
        size = max(size, BLOCK_BYTES + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            POWERS[name] = np.multiply.accumulate(steps)
    return POWERS["up"], POWERS["down"]


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, end row, bytes, offsets."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; no other byte changes, so texts stay UTF-8."""
    return np.where((data - np.uint8(65)) < 26, data + np.uint8(32), data)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the offsets of each text's words."""
    inside = (data != 32) & ((data - np.uint8(9)) > 4)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from one running sum over the block."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, in one array with offsets.

    A shingle is five words in a row; a text with fewer words has all of them as its only one, a text
    without words has none. Letters A-Z count as a-z.
    """
    data = lower(data)
    starts, ends, of = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    counts = np.diff(of)
    full = np.maximum(counts - WORDS + 1, 0)
    out_of = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.where(counts >= WORDS, full, counts > 0), out=out_of[1:])
    out = np.empty(out_of[-1], U64)
    if len(words) >= WORDS:
        sums = np.zeros(len(words) - WORDS + 1, U64)
        for j in range(WORDS):
            sums += words[j : len(words) - WORDS + 1 + j] * SHINGLE_WEIGHTS[j]
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = owner[: len(sums)] == owner[WORDS - 1 :]
        long = np.repeat(counts >= WORDS, np.diff(out_of))
        out[long] = mix(sums[inside])
    for n in range(1, WORDS):
        rows = np.flatnonzero(counts == n)
        if len(rows):
            at = of[rows]
            out[out_of[rows]] = mix(sum(words[at + j] * SHINGLE_WEIGHTS[j] for j in range(n)) + U64(n))
    for a, b in zip(out_of[:-1].tolist(), out_of[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[out_of[:-1][np.diff(out_of) > 0]] = True
    kept_of = np.zeros(len(out_of), np.int64)
    kept_of[1:] = np.cumsum(new)[out_of[1:] - 1] if len(out) else 0
    kept_of[out_of == 0] = 0
    return out[new], kept_of
