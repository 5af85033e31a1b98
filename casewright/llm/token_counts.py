"""Token counts of a byte-level pair-merge vocabulary, without making the tokens.

Texts are cut into pre-tokens as the vocabulary's library does: special strings first (each is one token), then the
byte-level pattern. The merges run on ragged arrays: all pre-tokens not met before lie one after another in one array of
symbols; every step looks up the rank of each neighbouring pair, takes each sequence's lowest rank and applies it at all
its places at once, overlapping places from the left. A sequence is done when none of its pairs has a rank; what counts is
the number of symbols left. A merge only ever makes symbols whose own merges rank later, so applying a rank everywhere at
once gives what applying it place by place gives.

A worker remembers the counts of the pre-tokens it has met, up to ``REMEMBERED``, then starts afresh: memory is bounded and
results do not depend on it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 1_000_000
NO_RANK = np.int64(1 << 60)
#: The library's byte-level pattern (fixed values).
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranges (fixed values) of letters and numbers that the library's older character tables know as neither.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
LIMIT = 1024
BLOCK_TEXT = 4 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes for themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    others = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(256 + n): b for n, b in enumerate(others)}


@dataclass(frozen=True)
class Merges:
    """Pairs in order of their code ``left * symbols + right``, with the rank and the symbol each makes."""

    symbols: int
    codes: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    specials: tuple[str, ...]


def load_merges(path: str) -> Merges:
    """Reads a vocabulary file; symbols 0 to 255 are the bytes, every merge makes one more."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, pre = told["model"], told.get("pre_tokenizer") or {}
    known = (model.get("type"), pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), told.get("normalizer"), model.get("ignore_merges"))
    if known != ("BPE", "ByteLevel", False, True, None, False):
        raise ValueError(f"not a byte-level pair-merge vocabulary of the known form: {known}")
    symbol = dict(byte_letters())
    pairs, made = [], []
    for pair in model["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        pairs.append((symbol[left], symbol[right]))
        made.append(symbol.setdefault(left + right, len(symbol)))
    size = len(symbol)
    codes = np.array([a * size + b for a, b in pairs], np.int64)
    order = np.argsort(codes, kind="stable")
    added = [t for t in told["added_tokens"]]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens with stripping or word rules are not known")
    return Merges(size, codes[order], order.astype(np.int64), np.array(made, np.int64)[order], tuple(t["content"] for t in added))


def merged_sizes(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """How many symbols are left of each piece."""
    out = np.array([len(p) for p in pieces], np.int64)
    symbols = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), out)
    while len(symbols) > 1:
        inside = owner[1:] == owner[:-1]
        codes = symbols[:-1] * merges.symbols + symbols[1:]
        at = np.minimum(np.searchsorted(merges.codes, codes), len(merges.codes) - 1)
        rank = np.where(inside & (merges.codes[at] == codes), merges.ranks[at], NO_RANK)
        first = np.flatnonzero(np.r_[True, ~inside])
        lowest = np.minimum.reduceat(np.r_[rank, NO_RANK], first)
        going = lowest < NO_RANK
        size = np.diff(np.r_[first, len(symbols)])
        place = np.flatnonzero((rank == np.repeat(lowest, size)[:-1]) & (rank < NO_RANK))
        # Of places side by side (as in aaaa) every second one from the left is applied.
        run = np.r_[True, np.diff(place) != 1]
        start = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
        place = place[(np.arange(len(place)) - start) % 2 == 0]
        symbols[place] = merges.made[at[place]]
        stay = np.ones(len(symbols), bool)
        stay[place + 1] = False
        np.subtract.at(out, owner[place], 1)
        # Sequences without a ranked pair have their final size and leave the arrays.
        stay &= np.repeat(going, size)
        symbols, owner = symbols[stay], owner[stay]
    return out


class Counter:
    """Counts tokens of texts, remembering pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges = merges
        newer = "".join(f"\\U{first:08x}-\\U{last:08x}" for first, last in NEWER)
        self.newer = regex.compile(f"[{newer}]")
        self.pattern = regex.compile(PRE_TOKENS)
        # The same pattern with the classes of the library; slower, so only for texts with such a character.
        older = {r" ?\p{L}+": rf" ?[\p{{L}}--[{newer}]]+", r" ?\p{N}+": rf" ?[\p{{N}}--[{newer}]]+", r"[^\s\p{L}\p{N}]": rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])"}
        pinned = PRE_TOKENS
        for known, classes in older.items():
            pinned = pinned.replace(known, classes)
        self.pinned = regex.compile(pinned, regex.V1)
        special = "|".join(regex.escape(s) for s in sorted(merges.specials, key=len, reverse=True))
        self.special = regex.compile(special) if special else None
        self.sizes: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        split: list[tuple[int, list[str]]] = []
        unseen: set[str] = set()
        sizes = self.sizes
        for text in texts:
            extra, pieces = 0, [text]
            if self.special and any(s in text for s in self.merges.specials):
                pieces = self.special.split(text)
                extra = len(pieces) - 1
            pattern = self.pattern if text.isascii() or not self.newer.search(text) else self.pinned
            found = pattern.findall(pieces[0]) if len(pieces) == 1 else [t for p in pieces for t in pattern.findall(p)]
            split.append((extra, found))
            unseen |= set(found).difference(sizes)
        new = list(unseen)
        sizes.update(zip(new, merged_sizes([t.encode() for t in new], self.merges).tolist(), strict=True))
        out = [extra + sum(map(sizes.__getitem__, found)) for extra, found in split]
        if len(sizes) > REMEMBERED:
            sizes.clear()
        return out


def counter(merges):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(merges.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_bytes, n_tokens, held, size = [], [], [], 0
            for k, text in enumerate(texts):
                held.append(text or "")
                n_bytes.append(len(held[-1].encode()))
                size += n_bytes[-1]
                if size >= BLOCK_TEXT or k == len(texts) - 1:
                    n_tokens += counts.count(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``; ``path`` names the vocabulary file.

    The file is read on the driver and sent to each executor once; its size is that of the vocabulary. A null text is empty
    and has no tokens; texts of any length are counted whole; repeated rows are counted each; other columns are never read.
    """
    merges = docs.sparkSession.sparkContext.broadcast(load_merges(path))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    counted = rows.mapInArrow(counter(merges), "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
