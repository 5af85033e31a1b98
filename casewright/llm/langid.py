"""Languages of texts, mixed ones by span: script ranges, scores per word and a Viterbi path with a switching penalty.

Words are runs of letters (bytes of a-z after lower-casing, and all bytes outside ASCII). A language's score of a word is
the log likelihood of the word's byte trigrams and tetragrams, blanks around it included, under hashed counts learned from
labelled documents. The script of a word's first letter narrows the languages to those that were seen to use it (all of
them if none was). The path through the words of a text with the best sum of scores, less ``SWITCH`` for each change of
language, labels spans; a text's language is the one with most bytes under its label, the score their share.

Counts are learned from at most about ``DOCS_PER_LANGUAGE`` documents of a language, chosen by a hash of the identifier, in
tables of a fixed number of cells per language; prediction covers every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm import ragged

DOCS_PER_LANGUAGE = 2_000
BITS = {3: 14, 4: 15}
SMOOTHING = 0.5
SWITCH = 14.0
EVIDENCE = 0.5
USES_SCRIPT = 0.005
PATH_BYTES = 16 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

#: First and last code point of each script's main ranges (fixed values).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
NAMES = [*SCRIPTS, "other"]
OTHER = len(SCRIPTS)
FIRSTS = np.array(sorted(a for ranges in SCRIPTS.values() for a, _ in ranges), np.int64)
LASTS = np.array([b for _, b in sorted((a, b) for ranges in SCRIPTS.values() for a, b in ranges)], np.int64)
OF_RANGE = np.array([k for _, k in sorted((a, k) for k, ranges in enumerate(SCRIPTS.values()) for a, _ in ranges)], np.int64)

#: Letters of words for themselves, everything else in ASCII as a blank.
PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block with blanks between words, and the words' starts, ends and offsets."""
    plain = PLAIN[data]
    return plain, *ragged.word_bounds(plain, offsets)


def scripts_of(plain: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of each word's first character."""
    padded = np.r_[plain, np.zeros(3, np.uint8)].astype(np.int64)
    a, b, c, d = (padded[starts + k] for k in range(4))
    point = np.where(
        a < 0x80,
        a,
        np.where(
            a < 0xE0,
            (a & 0x1F) << 6 | (b & 0x3F),
            np.where(a < 0xF0, (a & 0x0F) << 12 | (b & 0x3F) << 6 | (c & 0x3F), (a & 7) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | (d & 0x3F)),
        ),
    )
    at = np.searchsorted(FIRSTS, point, "right") - 1
    return np.where((at >= 0) & (point <= LASTS[at]), OF_RANGE[at], OTHER)


def gram_cells(plain: np.ndarray, size: int) -> np.ndarray:
    """The table cell of the ``size`` bytes that start at each place of the block (one blank before it and blanks after)."""
    padded = np.full(len(plain) + size, 32, np.uint32)
    padded[1 : len(plain) + 1] = plain
    code = np.zeros(len(plain) + 1, np.uint32)
    for k in range(size):
        code |= padded[k : k + len(plain) + 1] << np.uint32(8 * k)
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS[size])


def inner_grams(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end place of a word's grams, from the blank before it to that after it; at least one gram."""
    return starts, np.maximum(ends + 3 - size, starts + 1)


def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, kind, cell, n): gram counts of kind 3 and 4, words by script as kind 0, of one partition."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        data, offsets = ragged.as_bytes(batch.column("text"))
        for first, end, part, part_of in ragged.blocks(data, offsets, 64 << 10):
            plain, starts, ends, of = plain_words(part, part_of)
            script = scripts_of(plain, starts)
            grams = {n: gram_cells(plain, n) for n in BITS}
            for row in range(first, end):
                words = slice(of[row - first], of[row - first + 1])
                total = sums.setdefault((langs[row], 0), np.zeros(len(NAMES), np.int64))
                total += np.bincount(script[words], minlength=len(NAMES))
                for n, cells in grams.items():
                    a, b = inner_grams(starts[words], ends[words], n)
                    inside = np.zeros(len(cells) + 1, np.int64)
                    np.add.at(inside, a, 1)
                    np.add.at(inside, b, -1)
                    table = sums.setdefault((langs[row], n), np.zeros(1 << BITS[n], np.int64))
                    table += np.bincount(cells[np.cumsum(inside)[:-1] > 0], minlength=len(table))
    for (lang, kind), table in sums.items():
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(cells), pa.string()), pa.array([kind] * len(cells), pa.int32()), pa.array(cells, pa.int64()), pa.array(table[cells])],
            names=["lang", "kind", "cell", "n"],
        )


class Model:
    """Scores of grams and use of scripts by language."""

    def __init__(self, counts: pa.Table):
        self.languages = sorted(set(counts.column("lang").to_pylist()))
        place = {lang: k for k, lang in enumerate(self.languages)}
        lang = np.array([place[x] for x in counts.column("lang").to_pylist()], np.int64)
        kind, cell, n = (counts.column(c).to_numpy() for c in ("kind", "cell", "n"))
        self.scores: dict[int, np.ndarray] = {}
        for size, bits in BITS.items():
            table = np.full((len(self.languages), 1 << bits), SMOOTHING)
            rows = kind == size
            np.add.at(table, (lang[rows], cell[rows]), n[rows])
            self.scores[size] = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
        used = np.zeros((len(self.languages), len(NAMES)))
        rows = kind == 0
        np.add.at(used, (lang[rows], cell[rows]), n[rows])
        allowed = used >= USES_SCRIPT * np.maximum(used.sum(axis=1, keepdims=True), 1)
        allowed &= used > 0
        allowed[:, ~allowed.any(axis=0)] = True
        allowed[:, OTHER] = True
        self.allowed = allowed.T


def learned(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """A model of the rows (id, lang, text) of ``docs``; rows without a language are left out."""
    named = docs.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    part = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        part = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(part)
    chosen = named.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < part * 1_000_000)
    counts = chosen.select("lang", "text").mapInArrow(learn, "lang string, kind int, cell long, n long")
    return Model(counts.groupBy("lang", "kind", "cell").agg(F.sum("n").alias("n")).toArrow())


def word_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (word by language), bytes of each word and offsets of each text's words, for one block."""
    plain, starts, ends, of = plain_words(data, offsets)
    out = np.empty((len(starts), len(model.languages)), np.float32)
    cells = {n: gram_cells(plain, n) for n in BITS}
    for k in range(len(model.languages)):
        total = np.zeros(len(starts))
        for n in BITS:
            a, b = inner_grams(starts, ends, n)
            upto = np.zeros(len(plain) + 2)
            np.cumsum(model.scores[n][k][cells[n]], out=upto[1:])
            total += upto[b] - upto[a]
        out[:, k] = total * EVIDENCE
    out[~model.allowed[scripts_of(plain, starts)]] = -1e4
    return out, ends - starts, of


def best_paths(scores: np.ndarray, of: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path of its text, all texts of a block side by side."""
    sizes = np.diff(of)
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    steps = int(sizes[order[0]])
    active = len(order) - np.searchsorted(np.sort(sizes[order]), np.arange(steps), "right")
    first = of[:-1][order]
    came = np.empty((len(scores), scores.shape[1]), np.uint8)  # best language one word before
    own = np.arange(scores.shape[1])
    sums = scores[first].astype(np.float64)
    for t in range(1, steps):
        n = active[t]
        now, at = sums[:n], first[:n] + t
        top = now.max(axis=1, keepdims=True) - switch
        came[at] = np.where(now >= top, own, now.argmax(axis=1)[:, None])
        sums[:n] = np.maximum(now, top) + scores[at]
    last = sums.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        labels[at] = last[:n]
        if t:
            last[:n] = came[at, last[:n]]
    return labels


def spans_of(labels: np.ndarray, languages: list[str]) -> list[dict[str, object]]:
    """Runs of one language: first word, number of words, language."""
    if not len(labels):
        return []
    edge = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    size = np.diff(np.r_[edge, len(labels)])
    return [{"first": int(a), "words": int(n), "lang": languages[labels[a]]} for a, n in zip(edge, size, strict=True)]


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))


def labeller(model):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            data, offsets = ragged.as_bytes(texts)
            for first, end, part, part_of in ragged.blocks(data, offsets, PATH_BYTES):
                yield label_block(model.value, batch.slice(first, end - first), part, part_of)

    return label


def label_block(model: Model, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    scored = [word_scores(model, part, part_of) for _, _, part, part_of in ragged.blocks(data, offsets)]
    scores = np.concatenate([s for s, _, _ in scored])
    sizes = np.concatenate([n for _, n, _ in scored])
    of = np.r_[0, np.cumsum(np.concatenate([np.diff(o) for _, _, o in scored]))]
    labels = best_paths(scores, of) if model.languages else np.zeros(len(scores), np.int64)
    texts, langs, shares, spans = rows.column("text"), [], [], []
    for k in range(len(of) - 1):
        own = slice(of[k], of[k + 1])
        text = texts[k].as_py()
        if not text or not LETTER.search(text) or not model.languages:
            langs.append(UNKNOWN)
            shares.append(0.0)
            spans.append([])
            continue
        weight = np.bincount(labels[own], weights=sizes[own], minlength=len(model.languages))
        best = int(weight.argmax())
        langs.append(model.languages[best])
        shares.append(float(weight[best] / weight.sum()))
        spans.append(spans_of(labels[own], model.languages))
    return pa.RecordBatch.from_arrays(
        [rows.column("id"), rows.column("held_out"), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, SPANS)],
        names=["id", "held_out", "lang_pred", "score", "spans"],
    )


def held_out(identifier: Column) -> Column:
    """Whether the CRC-32 of the identifier's text leaves 1 when divided by 3; false for null."""
    code = F.crc32(F.encode(identifier.cast("string"), "utf-8"))
    return F.coalesce(F.pmod(code, F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans), one row per row of ``docs``.

    Learned from the rows that have an identifier and a language and aren't held out. A null text, a text without letters, and
    any text when nothing could be learned, get ``und``, score 0 and no spans. Repeated rows are labelled each; an empty table
    gives an empty result; other columns are never read.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{lang_column}`").alias("lang"), F.col(f"`{text_column}`").alias("text")
    ).withColumn("held_out", held_out(F.col("id")))
    model = docs.sparkSession.sparkContext.broadcast(learned(rows.where("not held_out and id is not null")))
    schema = "id long, held_out boolean, lang_pred string, score double, spans array<struct<first: long, words: long, lang: string>>"
    return rows.select("id", "held_out", "text").mapInArrow(labeller(model), schema).withColumnRenamed("id", "doc_id")
