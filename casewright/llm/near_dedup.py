"""Near-duplicate documents by an inverted join over the coordinates of MinHash signatures.

A document's set holds its distinct five-word shingles (see ``ragged.shingles``). Its signature has 64
coordinates; two sets of similarity s agree in each with probability s. Documents are posted under
(coordinate, value); two documents that agree in at least 32 coordinates are candidates, and candidates are
confirmed on their full sets: 100 * intersection >= 75 * union. At a similarity of exactly 0.75 a link is
missed with a chance of about 5e-6, above it with less.

Prefix and skip: documents that agree in 32 of 64 coordinates share one of the first 33 in any order that is
the same for all, so only 33 are posted. The order puts values that very many documents share last, which
skips their lists unless most of a document is common text. The table of common values is bounded
(``COMMON_VALUES``); which values it holds changes the cost, never the result.

Groups are not expanded into pairs. Texts with one set are one class. In ``ROUNDS`` rounds a list links its
members to one pivot only, later those outside its largest component to a pivot of that component; what is
connected needs no further pair. Lists whose members then still lie in different components are compared inside
tasks: members outside the largest component with all others, long lists dealt out by pairs of blocks. The first
comparison, on 16 bits of each coordinate, marks members that have a candidate in a list; a pair counts in the
first two lists at most that both are posted in. Marked members meet again with their texts, and there, in the first
list that both are posted in, a pair is confirmed on full sets. No pair leaves a task but a confirmed one.
Sets are known by 64-bit shingle hashes, classes by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm import ragged
from casewright.llm.components import components, extended
from casewright.llm.workspace import PLACE, kept, located, private_names, shared_folder

COORDINATES = 64
MATCHES = 32
PERCENT = 75
PREFIX = COORDINATES - MATCHES + 1
VALUE_BITS = 57
COMMON_VALUES = 20_000
COMMON_IN_PART = 8
BLOCK_ROWS = 1024
#: Bytes of rows that a task holds before it compares the whole cells among them.
HELD_BYTES = 1 << 26
PIVOT_ROWS = 512
ROUNDS = 3

FLIPS = ragged.numbers(21, COORDINATES)
FACTORS = ragged.numbers(22, COORDINATES) | ragged.U64(1)
DIGEST_SEEDS = ragged.numbers(23, 2)


def signatures_of(sets: np.ndarray, of: np.ndarray) -> np.ndarray:
    """One row of coordinates per set; sets must not be empty.

    The minimum over a large set has few bits beyond its leading zeros, so it is mixed before it is cut in halves.
    """
    out = np.empty((len(of) - 1, COORDINATES), np.uint64)
    work = np.empty_like(sets)
    for c in range(COORDINATES):
        np.bitwise_xor(sets, FLIPS[c], out=work)
        np.multiply(work, FACTORS[c], out=work)
        out[:, c] = ragged.mix(np.minimum.reduceat(work, of[:-1]))
    return out


def digests_of(sets: np.ndarray, of: np.ndarray) -> np.ndarray:
    """128 bits that stand for a whole set, whatever the order of its members."""
    out = np.empty((len(of) - 1, 2), np.uint64)
    for k in range(2):
        out[:, k] = np.add.reduceat(ragged.mix(sets ^ DIGEST_SEEDS[k]), of[:-1])
    return out


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, file, position, text) -> the same without text, set size, digest and signature (null without words).

    A signature holds the upper half of each coordinate, ``low`` the rest, which only tells lists apart.
    """
    for batch in batches:
        data, offsets = ragged.as_bytes(batch.column("text"))
        for first, end, part, part_of in ragged.blocks(data, offsets):
            sets, of = ragged.shingles(part, part_of)
            sizes = np.diff(of)
            full = np.flatnonzero(sizes)
            digests: list[bytes | None] = [None] * len(sizes)
            signs: list[bytes | None] = [None] * len(sizes)
            lows: list[bytes | None] = [None] * len(sizes)
            if len(full):
                edges = np.append(of[:-1][full], of[-1])
                whole = signatures_of(sets, edges)
                upper, lower = (whole >> ragged.U64(32)).astype(np.uint32), whole.astype(np.uint32)
                for row, d, s, low in zip(full.tolist(), digests_of(sets, edges), upper, lower, strict=True):
                    digests[row], signs[row], lows[row] = d.tobytes(), s.tobytes(), low.tobytes()
            rows = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(n) for n in ("id", "file", "position")), pa.array(sizes), *(pa.array(c, pa.binary()) for c in (digests, signs, lows))],
                names=["id", "file", "position", "size", "digest", "sign", "low"],
            )


def sign_matrix(column: pa.Array, kind: type = np.uint32) -> np.ndarray:
    """Signatures of a batch as rows of coordinates."""
    data, offsets = ragged.as_bytes(column.cast(pa.large_binary()).view(pa.large_string()))
    return data.view(kind).reshape(len(offsets) - 1, -1)


def keys_of(signs: np.ndarray) -> np.ndarray:
    """(coordinate, upper half of the value) as one number."""
    return (np.arange(COORDINATES, dtype=np.int64) << 32) | signs.astype(np.int64)


def list_keys(signs: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """(coordinate, 57 bits of the value) as one number, the key of a list."""
    return (np.arange(COORDINATES, dtype=np.int64) << VALUE_BITS) | (signs.astype(np.int64) << 25) | (lows >> np.uint32(7)).astype(np.int64)


def common_in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coordinate values that one partition holds at least ``COMMON_IN_PART`` times, with their counts."""
    parts = [keys_of(sign_matrix(b.column("sign"))).ravel() for b in batches if b.num_rows]
    if parts:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        often = counts >= COMMON_IN_PART
        yield pa.RecordBatch.from_arrays([pa.array(keys[often]), pa.array(counts[often])], names=["key", "n"])


def posted(signs: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The coordinates under which each class is posted: the first ``PREFIX``, those with common values coming last."""
    rare = np.ones(signs.shape, bool)
    if len(common):
        keys = keys_of(signs)
        rare = common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] != keys
    return np.sort(np.argsort(~rare, axis=1, kind="stable")[:, :PREFIX], axis=1)


def poster(common: np.ndarray):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signs = sign_matrix(batch.column("sign"))
                keys = np.take_along_axis(list_keys(signs, sign_matrix(batch.column("low"))), posted(signs, common), axis=1)
                nodes = np.repeat(batch.column("node").to_numpy(), PREFIX)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], names=["key", "node"])

    return post


def enough_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sign_a, sign_b) -> the pairs that agree in ``MATCHES`` coordinates."""
    for batch in batches:
        if batch.num_rows:
            same = (sign_matrix(batch.column("sign_a")) == sign_matrix(batch.column("sign_b"))).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(same >= MATCHES))


def close_in_size(a: str, b: str) -> F.Column:
    """Sets of similarity 0.75 differ in size by no more than that."""
    return 100 * F.least(F.col(a), F.col(b)) >= PERCENT * F.greatest(F.col(a), F.col(b))


def near_pairs(signs: np.ndarray, label: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of ``left`` and ``right`` in different components that agree in ``MATCHES`` coordinates."""
    for start in range(0, len(left), 256):
        some = left[start : start + 256]
        maybe = (label[some][:, None] != label[right]) & (
            100 * np.minimum(size[some][:, None], size[right]) >= PERCENT * np.maximum(size[some][:, None], size[right])
        )
        if not maybe.any():
            continue
        same = np.zeros(maybe.shape, np.uint8)
        for c in range(COORDINATES):
            same += signs[some, c][:, None] == signs[right, c]
        x, y = np.nonzero(maybe & (same >= MATCHES))
        for at in range(0, len(x), 4096):
            yield some[x[at : at + 4096]], right[y[at : at + 4096]]


def cells_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Key and the places of the two sides of each cell (key, i, j) of a sorted batch."""
    key, i, j, block = (batch.column(n).to_numpy() for n in ("key", "i", "j", "block"))
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
        rows = np.arange(a, b)
        yield int(key[a]), rows[block[a:b] == i[a]], rows[block[a:b] == j[a]]


def posted_mask(signs: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Rows of flags: the coordinates under which each class is posted."""
    mask = np.zeros(signs.shape, bool)
    np.put_along_axis(mask, posted(signs, common), True, axis=1)
    return mask


def sketcher(common: np.ndarray):
    """(node, size, sign) -> the same with 16 bits of each coordinate, and the posted coordinates."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signs = sign_matrix(batch.column("sign"))
                masks = np.packbits(posted_mask(signs, common), axis=1)
                cells = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (signs.astype(np.uint16), masks)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), *cells], names=["node", "size", "sketch", "mask"])

    return sketch


def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whole cells -> (key, node) of the members that have a candidate there.

    Equal halves of unequal coordinates could hide a pair's first list, so its second one counts too.
    """
    signs = sign_matrix(batch.column("sketch"), np.uint16)
    masks = np.unpackbits(sign_matrix(batch.column("mask"), np.uint8), axis=1).astype(bool)
    node, label, size, keys = (batch.column(n).to_numpy() for n in ("node", "label", "size", "key"))
    marked = np.zeros(len(node), bool)
    for key, left, right in cells_of(batch):
        for x, y in near_pairs(signs, label, size, left, right):
            both = (signs[x] == signs[y]) & masks[x] & masks[y]
            early = both[:, : key >> VALUE_BITS].sum(axis=1) < 2
            marked[x[early]] = marked[y[early]] = True
    return pa.RecordBatch.from_arrays([pa.array(keys[marked]), pa.array(node[marked])], names=["key", "node"])


def linker(common: np.ndarray):
    """Whole cells with texts -> the pairs of different components that full sets confirm."""

    def link(batch: pa.RecordBatch) -> pa.RecordBatch:
        signs = sign_matrix(batch.column("sign"))
        masks = posted_mask(signs, common)
        node, label, size = (batch.column(n).to_numpy() for n in ("node", "label", "size"))
        data, offsets = ragged.as_bytes(batch.column("text"))
        parts = [ragged.shingles(part, part_of) for _, _, part, part_of in ragged.blocks(data, offsets)]
        sets = np.concatenate([s for s, _ in parts])
        of = np.r_[0, np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))]
        found = [np.empty((2, 0), np.int64)]
        for key, left, right in cells_of(batch):
            for x, y in near_pairs(signs, label, size, left, right):
                both = (signs[x] == signs[y]) & masks[x] & masks[y]
                first = both.argmax(axis=1) == key >> VALUE_BITS
                x, y = x[first], y[first]
                for row in np.unique(x):
                    partners = y[x == row]
                    members = np.concatenate([sets[of[k] : of[k + 1]] for k in partners])
                    counts = of[partners + 1] - of[partners]
                    hits = np.isin(members, sets[of[row] : of[row + 1]])
                    shared = np.add.reduceat(hits, np.r_[0, np.cumsum(counts)[:-1]], dtype=np.int64)
                    close = 100 * shared >= PERCENT * (counts + of[row + 1] - of[row] - shared)
                    found.append(np.stack([np.full(close.sum(), node[row]), node[partners[close]]]))
        pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return link


def wide(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts with offsets of 64 bits, so that joined ones stay in one piece beyond 2 GB."""
    at = batch.schema.get_field_index("text")
    return batch if at < 0 else batch.set_column(at, "text", batch.column(at).cast(pa.large_string()))


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    pieces = pa.Table.from_batches(held).combine_chunks().to_batches()
    if len(pieces) != 1:
        raise ValueError(f"rows of a cell came in {len(pieces)} pieces")
    return pieces[0]


def by_cell(ready):
    """Applies ``ready`` to batches of whole cells; rows come sorted by cell, of at most about 2 ``BLOCK_ROWS`` each.

    Cells i = j compare all members of a block with each other, others those of block i with those of block j. Whole cells
    are handed on once rows or bytes are enough; a single cell is held whatever its bytes.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_rows, held_bytes, most = 0, 0, HELD_BYTES
        for batch in map(wide, batches):
            if not batch.num_rows:
                continue
            held.append(batch)
            held_rows += batch.num_rows
            held_bytes += batch.nbytes
            if held_rows < 4 * BLOCK_ROWS and held_bytes < most:
                continue
            table = joined(held)
            i, j, key = (table.column(n).to_numpy() for n in ("i", "j", "key"))
            other = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield ready(table.slice(0, cut))
            held, held_rows = [table.slice(cut)], len(key) - cut
            held_bytes = held[0].nbytes
            # What is left of a long cell is not joined anew with each batch.
            most = max(HELD_BYTES, 2 * held_bytes)
        if held_rows:
            yield ready(joined(held))

    return compare


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, part, kind): the text of a (kind 0), then those of its partners -> confirmed pairs."""
    pivot, pivot_set = None, np.empty(0, np.uint64)
    for batch in batches:
        data, offsets = ragged.as_bytes(batch.column("text"))
        a, kind, b = (batch.column(n).to_pylist() for n in ("a", "kind", "b"))
        links: list[tuple[int, int]] = []
        for first, end, part, part_of in ragged.blocks(data, offsets):
            sets, of = ragged.shingles(part, part_of)
            for row in range(first, end):
                own = sets[of[row - first] : of[row - first + 1]]
                if kind[row] == 0:
                    pivot, pivot_set = a[row], own.copy()
                elif pivot == a[row]:
                    both = int(np.isin(own, pivot_set, assume_unique=True).sum())
                    if 100 * both >= PERCENT * (len(own) + len(pivot_set) - both):
                        links.append((a[row], b[row]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"]
        )


class NearDuplicates:
    """One run over ``docs``: signatures, classes and components, each a table in the shared folder.

    Defined results: a null or blank text has an empty set and is its own component; repeated rows and equal texts
    are one class; a component's id is its smallest non-null doc_id (null if it has none); an empty table gives
    empty tables. Other columns of ``docs``, whatever their names, are never read.
    """

    def __init__(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"):
        self.texts = located(docs, [id_column, text_column], "near-rows").toDF("id", "text", "place")
        flat = self.texts.select(F.col("id").cast("long"), "text", "place.file", "place.position")
        self.signs = kept(
            flat.mapInArrow(sign, "id long, file string, position long, size long, digest binary, sign binary, low binary"), "near-signs"
        )
        self.classes = kept(
            self.signs.where("digest is not null")
            .groupBy("digest")
            .agg(F.min("id").alias("id"), F.first("sign").alias("sign"), F.first("low").alias("low"), F.first("size").alias("size"), F.min(F.struct("file", "position")).alias("place"))
            .withColumn("node", F.monotonically_increasing_id()),
            "near-classes",
        )
        self.roots = self._link()

    def _link(self) -> DataFrame:
        signs = self.classes.select("node", "sign", "size")
        common = (
            signs.select("sign")
            .mapInArrow(common_in_part, "key long, n long")
            .groupBy("key")
            .agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "key")
            .limit(COMMON_VALUES)
        )
        values = np.sort(np.array([r.key for r in common.collect()], np.int64))
        postings = kept(self.classes.select("node", "sign", "low").mapInArrow(poster(values), "key long, node long"), "near-postings")
        lists = postings.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last")
        shared = kept(postings.join(lists.select("key", "pivot"), "key"), "near-shared")
        texts = self._texts(shared.select("node").distinct())

        stars = shared.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        tried = kept(self._matching(stars, signs), "near-stars")
        roots = components(kept(self._confirmed(tried, texts), "near-links"))
        for turn in range(1, ROUNDS):
            labelled, mixed = self._mixed(shared, roots, turn)
            pairs = labelled.join(mixed, "key").where("label != top").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
            new = pairs.distinct().join(tried, ["a", "b"], "left_anti")
            new = kept(self._matching(new, signs), "near-stars")
            more = kept(self._confirmed(new, texts), "near-links")
            tried = tried.union(new)
            roots = extended(roots, more)

        labelled, mixed = self._mixed(shared, roots, ROUNDS)
        inside = kept(labelled.join(mixed.select("key"), "key", "left_semi"), "near-mixed")
        sketch = kept(
            signs.select("node", "size", "sign").mapInArrow(sketcher(values), "node long, size long, sketch binary, mask binary"), "near-sketches"
        )
        marked = self._cells(inside, mixed, sketch).mapInArrow(by_cell(mark), "key long, node long").distinct()
        again, mixed = self._mixed(kept(marked, "near-marked"), roots, ROUNDS)
        details = texts.join(again.select("node").distinct(), "node", "left_semi").join(signs, "node")
        more = self._cells(again, mixed, details).mapInArrow(by_cell(linker(values)), "a long, b long").distinct()
        roots = extended(roots, kept(more, "near-links"))
        # All later results read roots and classes; the files stay with the run's other tables.
        texts.sparkSession.sql(f"DROP TABLE {self.texts_table}")
        return roots

    @staticmethod
    def _mixed(shared: DataFrame, roots: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """Members of lists with their components, and of each list with several components: the largest one (top), a
        member of it (pivot, another one each turn), its size (most) and the number of other members (others)."""
        own = shared.select("key", "node").join(roots, "node", "left")
        labelled = kept(own.select("key", "node", F.coalesce("root", "node").alias("label")), "near-labels")
        parts = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("pivot"))
        lists = parts.groupBy("key").agg(
            F.count("*").alias("labels"),
            F.sum("n").alias("members"),
            F.max("n").alias("most"),
            F.max_by("label", "n").alias("top"),
            F.max_by("pivot", "n").alias("pivot"),
        )
        mixed = lists.where("labels > 1").select("key", "top", "pivot", "most", (F.col("members") - F.col("most")).alias("others"))
        return labelled, mixed

    @staticmethod
    def _cells(labelled: DataFrame, mixed: DataFrame, details: DataFrame) -> DataFrame:
        """Rows of mixed lists with ``details`` of their nodes, dealt out and sorted by cell (key, i, j).

        Members outside the largest component fill the first blocks and meet every block, those inside meet only the first.
        """
        outside, most = (F.ceil(F.col(c) / BLOCK_ROWS).cast("int") for c in ("others", "most"))
        lists = mixed.select("key", "top", outside.alias("outside"), (outside + most).alias("blocks"))
        is_top = F.col("label") == F.col("top")
        code = F.xxhash64("node")
        block = F.when(is_top, F.col("outside") + F.pmod(code, F.col("blocks") - F.col("outside"))).otherwise(F.pmod(code, F.col("outside")))
        others = F.sequence(F.lit(0), F.when(is_top, F.col("outside")).otherwise(F.col("blocks")) - 1)
        return (
            labelled.join(lists, "key")
            .withColumn("block", block.cast("int"))
            .withColumn("other", F.explode(others))
            .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label")
            .join(details, "node")
            .repartition("key", "i", "j")
            .sortWithinPartitions("key", "i", "j")
        )

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """One text for each class that shares a list with another, bucketed by node: each round joins it without a shuffle."""
        wanted = self.classes.join(nodes, "node", "left_semi").select(F.col("place").alias(PLACE), "node")
        found = self.texts.select(F.col("place").alias(PLACE), "text").join(wanted, PLACE).select("node", "text")
        spark = found.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        folder = shared_folder(spark, "near-texts")
        self.texts_table = name = f"near_texts_{folder.rsplit('-', 1)[1]}"
        writer = found.repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node")
        writer.option("path", folder).format("parquet").saveAsTable(name)
        return spark.table(name)

    def _matching(self, pairs: DataFrame, signs: DataFrame) -> DataFrame:
        left = signs.toDF("a", "sign_a", "size_a")
        right = signs.toDF("b", "sign_b", "size_b")
        near = pairs.join(left, "a").join(right, "b").where(close_in_size("size_a", "size_b"))
        return near.select("a", "b", "sign_a", "sign_b").mapInArrow(enough_matches, "a long, b long")

    def _confirmed(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs checked on full sets. A node with many partners is dealt out in parts, its own text to each."""
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("parts"))
        pivots = (
            texts.withColumnRenamed("node", "a")
            .join(parts, "a")
            .select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("b"), "text")
        )
        partners = (
            pairs.join(parts, "a")
            .withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
            .join(texts.withColumnRenamed("node", "b"), "b")
            .select("a", "part", F.lit(1).alias("kind"), "b", "text")
        )
        return (
            pivots.union(partners)
            .repartition("a", "part")
            .sortWithinPartitions("a", "part", "kind")
            .mapInArrow(confirm, "a long, b long")
            .distinct()
        )

    def members(self) -> DataFrame:
        """(digest, component_id) for every class."""
        root = self.classes.join(self.roots, "node", "left").select("digest", "id", F.coalesce("root", "node").alias("root"))
        least = root.groupBy("root").agg(F.min("id").alias("component_id"))
        return root.join(least, "root").select("digest", "component_id")

    def documents(self) -> DataFrame:
        """(id, file, position, n_shingles, component_id, kept) for every row."""
        rows = self.signs.select("id", "file", "position", "size", "digest")
        own = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
        return (
            rows.join(self.members(), "digest", "left")
            .select("id", "file", "position", F.col("size").alias("n_shingles"), own.alias("component_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
        )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    A null text or one without a word has no shingle, is linked with nothing and is kept; texts of any length are read whole;
    repeated rows share a component; an empty table gives an empty result; other columns are never read.
    """
    return NearDuplicates(docs).documents().select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the row with its smallest id; of several such rows, one.

    Columns stay as they are, whatever their names. Rows without a word are linked with nothing and all stay; texts of any
    length are read whole; an empty table gives an empty result.
    """
    columns, names = docs.columns, private_names(docs.columns)
    whole = located(docs.toDF(*names), names, "near-docs")
    run = NearDuplicates(whole)
    stay = (
        run.documents()
        .where("kept")
        .groupBy("id", "component_id", F.when(F.col("n_shingles") == 0, F.struct("file", "position")))
        .agg(F.min(F.struct("file", "position")).alias("place"))
        .select("place")
    )
    return whole.join(stay.withColumnRenamed("place", PLACE), PLACE, "left_semi").select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)))
