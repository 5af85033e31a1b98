"""Token ids of every document in binary files of patched frame-of-reference blocks.

``encode`` puts the documents in ascending order of their id (a range shuffle of the texts), encodes them with the
tokenizers library and writes files into a folder that all executors share. A file is written by one task under a name
of its own; which files count is said by a table of files (the manifest) that Spark commits, so the leftovers of a lost
task are never read. ``read_back`` reads the files and gives one row per document.

File: a head, the blocks, the document table, the block index, a tail. All ids of a file lie in one row, cut into blocks
of ``BLOCK``. A block subtracts its minimum, packs the differences at the width that ``PERCENTILE`` percent of them need,
and lists the others with their place. The index holds the start of each block, so that ids are read from the middle of a
file without what comes before.

The library encodes distinct pieces of text, not repeated ones. Texts are cut only where its byte-level pattern always
ends a token: before white space that follows something else, and between a Latin letter and a full stop, comma or the
like. Texts that hold a special string go to the library whole. Memory is bounded by ``REMEMBERED`` pieces, a batch and
a file's tables.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm import ragged
from casewright.llm.workspace import PLACE, located, shared_folder
from casewright.sources.working import working_table

BLOCK = 128
PERCENTILE = 90
FILE_IDS = 1 << 22
REMEMBERED = 1_000_000
END_ID = 0
MAGIC = b"CWPF0001"
BLOCK_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("patches", "u1")])
TAIL = struct.Struct("<qqqq8s")
#: Blocks that are packed or unpacked at once.
BLOCKS_AT_ONCE = 2048

Block = tuple[int, np.ndarray]


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below 2**width as rows of bytes, lowest bit first."""
    bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def unpacked(rows: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``packed``."""
    if not width:
        return np.zeros((len(rows), BLOCK), np.uint32)
    at = np.arange(BLOCK, dtype=np.int64) * width
    wide = np.concatenate([rows, np.zeros((len(rows), 5), np.uint8)], axis=1)
    found = np.zeros((len(rows), BLOCK), np.uint64)
    for k in range(5):
        found |= wide[:, (at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((found >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of the blocks of ``ids`` (a multiple of ``BLOCK``), and the size of each."""
    rows = ids.astype(np.uint32, copy=False).reshape(-1, BLOCK)
    least = rows.min(axis=1)
    differences = rows - least[:, None]
    bound = np.sort(differences, axis=1)[:, -(-BLOCK * PERCENTILE // 100) - 1]
    widths = np.ceil(np.log2(bound.astype(np.float64) + 1)).astype(np.int64)
    over = differences.astype(np.uint64) >> widths[:, None].astype(np.uint64) > 0
    patches = over.sum(axis=1)
    sizes = BLOCK_HEAD.itemsize + BLOCK // 8 * widths + 5 * patches
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)

    def put(where: np.ndarray, what: np.ndarray) -> None:
        out[where[:, None] + np.arange(what.shape[1])] = what

    head = np.zeros(len(rows), BLOCK_HEAD)
    head["least"], head["width"], head["patches"] = least, widths, patches
    put(starts, head.view(np.uint8).reshape(len(rows), -1))
    low = np.where(over, np.uint32(0), differences)
    for width in np.unique(widths[widths > 0]).tolist():
        some = np.flatnonzero(widths == width)
        put(starts[some] + BLOCK_HEAD.itemsize, packed(low[some], width))
    block, place = np.nonzero(over)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(patches) - patches, patches)
        lists = starts[block] + BLOCK_HEAD.itemsize + BLOCK // 8 * widths[block]
        out[lists + nth] = place
        put(lists + patches[block] + 4 * nth, differences[block, place].astype("<u4").view(np.uint8).reshape(-1, 4))
    return out.tobytes(), sizes


def unpack_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` within ``data``."""
    head = data[starts[:, None] + np.arange(BLOCK_HEAD.itemsize)].copy().view(BLOCK_HEAD).ravel()
    rows = np.zeros((len(starts), BLOCK), np.uint32)
    for width in np.unique(head["width"]).tolist():
        some = np.flatnonzero(head["width"] == width)
        body = starts[some] + BLOCK_HEAD.itemsize
        rows[some] = unpacked(data[body[:, None] + np.arange(BLOCK // 8 * width)], width)
    patches = head["patches"].astype(np.int64)
    if patches.any():
        block = np.repeat(np.arange(len(starts)), patches)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(patches) - patches, patches)
        lists = starts[block] + BLOCK_HEAD.itemsize + BLOCK // 8 * head["width"][block].astype(np.int64)
        values = data[(lists + patches[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
        rows[block, data[lists + nth]] = values
    return (rows + head["least"][:, None]).ravel()


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and its path there."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


class FileWriter:
    """One file; ``add`` takes documents in order, ``close`` writes the tables."""

    def __init__(self, folder: str, name: str):
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        self.stream = system.open_output_stream(f"{path}/{name}")
        self.stream.write(MAGIC)
        self.name, self.rest = name, np.empty(0, np.uint32)
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.sizes: list[np.ndarray] = []
        self.total = 0

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.counts += counts.tolist()
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(ids) // BLOCK * BLOCK
        self._write(ids[:whole])
        self.rest = ids[whole:].copy()

    def _write(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids), BLOCKS_AT_ONCE * BLOCK):
            data, sizes = pack_blocks(ids[at : at + BLOCKS_AT_ONCE * BLOCK])
            self.stream.write(data)
            self.sizes.append(sizes)

    def close(self) -> None:
        if len(self.rest):
            self._write(np.r_[self.rest, np.full(BLOCK - len(self.rest), self.rest[-1], np.uint32)])
        sizes = np.concatenate([np.empty(0, np.int64), *self.sizes])
        starts = len(MAGIC) + np.cumsum(sizes) - sizes
        known = np.array([i is not None for i in self.doc_ids], np.uint8)
        table = np.array([i or 0 for i in self.doc_ids], "<i8")
        for part in (table, known, np.array(self.counts, "<i8"), starts.astype("<i8")):
            self.stream.write(part.tobytes())
        end = len(MAGIC) + int(sizes.sum())
        self.stream.write(TAIL.pack(len(table), self.total, len(starts), end, MAGIC))
        self.stream.close()


@dataclass(frozen=True)
class Tables:
    """What a file says of itself: documents with their counts of ids, and where each block begins and the last ends."""

    doc_ids: list[int | None]
    counts: np.ndarray
    total: int
    starts: np.ndarray


class FileReader:
    def __init__(self, folder: str, name: str):
        system, path = opened(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        size = self.file.size()
        documents, total, blocks, end, magic = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{name} is no file of token ids")
        told = self._at(end, size - TAIL.size - end)
        ids = np.frombuffer(told, "<i8", documents)
        known = np.frombuffer(told, np.uint8, documents, 8 * documents)
        counts = np.frombuffer(told, "<i8", documents, 9 * documents)
        starts = np.frombuffer(told, "<i8", blocks, 17 * documents)
        listed = [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)]
        self.tables = Tables(listed, counts, total, np.append(starts, end))

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids ``first`` to ``end`` of the file; only the blocks that hold them are read."""
        if first >= end:
            return np.empty(0, np.uint32)
        from_block, to_block = first // BLOCK, -(-end // BLOCK)
        starts = self.tables.starts[from_block : to_block + 1]
        data = np.frombuffer(self._at(int(starts[0]), int(starts[-1] - starts[0])), np.uint8)
        found = unpack_blocks(data, starts[:-1] - starts[0])
        return found[first - from_block * BLOCK : end - from_block * BLOCK]

    def chunks(self) -> Iterator[np.ndarray]:
        step = BLOCKS_AT_ONCE * BLOCK
        for first in range(0, self.tables.total, step):
            yield self.ids(first, min(first + step, self.tables.total))

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, number of ids, crc32 of the ids as little-endian 32-bit numbers) of each document in order."""
        chunks, have, at = self.chunks(), np.empty(0, "<u4"), 0
        for doc_id, count in zip(self.tables.doc_ids, self.tables.counts.tolist(), strict=True):
            crc, left = 0, count
            while left:
                if at == len(have):
                    have, at = next(chunks).astype("<u4", copy=False), 0
                take = min(left, len(have) - at)
                crc = zlib.crc32(have[at : at + take], crc)
                at, left = at + take, left - take
            yield doc_id, count, crc


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text, and where the library's pattern ends a token whatever comes before or after."""
    begin = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        blank = (data == 32) | ((data - np.uint8(9)) < 5)
        begin[1:-1] = blank[1:] & ~blank[:-1]
        # Other white space takes two or three bytes with these in front; no cut after anything that begins so.
        if (data == 0xC2).any() or (data == 0xE1).any() or (data == 0xE2).any() or (data == 0xE3).any():
            two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
            begin[2:-1] &= ~two[:-1]
            three = ((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
            begin[3:-1] &= ~three[:-1]
        letter = ((data | np.uint8(32)) - np.uint8(97)) < 26
        mark = (data == 44) | (data == 46) | (data == 33) | (data == 63) | (data == 58) | (data == 59)
        begin[1:-1] |= letter[:-1] & mark[1:]
        accented = (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        begin[2:-1] |= accented & mark[2:]
    begin[offsets] = True
    return np.flatnonzero(begin[:-1])


class Encoder:
    """Ids of texts by the library, each distinct piece once while it is remembered."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.keys, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)
        self.of = np.zeros(1, np.int64)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of a block in the order of the text, and the offsets of each text's pieces."""
        starts = cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = ragged.word_hashes(data, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != distinct
        if new.any():
            raw = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            ids = self.library([raw[a:b].decode() for a, b in spans])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.pool = np.concatenate([self.pool, np.fromiter((i for r in ids for i in r), np.uint32, int(sizes.sum()))])
            numbers = len(self.of) - 1 + np.arange(len(ids))
            self.of = np.concatenate([self.of, self.of[-1] + np.cumsum(sizes)])
            self.keys = np.insert(self.keys, at[new], distinct[new])
            self.rows = np.insert(self.rows, at[new], numbers)
            at = np.searchsorted(self.keys, distinct)
        return self.rows[at][which], np.searchsorted(starts, offsets)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, count of ids of each row, all ids with ``END_ID`` after each text), block by block."""
        data, offsets = ragged.as_bytes(texts)
        for first, end, part, part_of in ragged.blocks(data, offsets):
            numbers, of = self.pieces(part, part_of)
            sizes = np.diff(self.of)[numbers]
            total = np.zeros(len(numbers) + 1, np.int64)
            np.cumsum(sizes, out=total[1:])
            counts = total[of[1:]] - total[of[:-1]]
            inside = np.arange(total[-1]) - np.repeat(total[:-1], sizes)
            ids = self.pool[np.repeat(self.of[:-1][numbers], sizes) + inside]
            raw = part.tobytes()
            if any(s.encode() in raw for s in self.specials):
                rows = np.split(ids, np.cumsum(counts)[:-1])
                for row in range(end - first):
                    text = raw[part_of[row] : part_of[row + 1]].decode()
                    if any(s in text for s in self.specials):
                        rows[row] = np.array(self.library([text])[0], np.uint32)
                ids, counts = np.concatenate(rows), np.array([len(r) for r in rows])
            ids = np.insert(ids, np.cumsum(counts), END_ID)
            yield first, end, counts + 1, ids
            if len(self.keys) > REMEMBERED:
                self.forget()


#: The encoder of a Python worker, kept from task to task.
ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = Encoder(vocabulary)
    return ENCODERS[key]


FILES = "name string, first_id long, first_file string, first_position long, n_docs long, n_ids long"


def writer(folder: str, vocabulary):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (id, file, position, text) -> one row for each file written."""
        encoder = encoder_of(vocabulary.value)
        out: FileWriter | None = None
        told: tuple = ()

        def closed() -> pa.RecordBatch:
            out.close()
            row = dict(zip(("first_id", "first_file", "first_position"), told, strict=True))
            row = {"name": out.name, **row, "n_docs": len(out.counts), "n_ids": out.total}
            return pa.RecordBatch.from_pylist([row], pa.schema(FILE_TYPES))

        for batch in batches:
            for first, end, counts, ids in encoder.encode(batch.column("text")):
                ends, row = np.cumsum(counts), 0
                while row < end - first:
                    if out is None:
                        out = FileWriter(folder, f"ids-{uuid.uuid4().hex}.cwpf")
                        told = tuple(batch.column(n)[first + row].as_py() for n in ("id", "file", "position"))
                    done = int(ends[row - 1]) if row else 0
                    upto = min(int(np.searchsorted(ends, done + FILE_IDS - out.total)) + 1, end - first)
                    out.add(batch.column("id").slice(first + row, upto - row).to_pylist(), counts[row:upto], ids[done : ends[upto - 1]])
                    row = upto
                    if out.total >= FILE_IDS:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    return write


FILE_TYPES = [
    ("name", pa.string()),
    ("first_id", pa.int64()),
    ("first_file", pa.string()),
    ("first_position", pa.int64()),
    ("n_docs", pa.int64()),
    ("n_ids", pa.int64()),
]


@dataclass(frozen=True)
class TokenFiles:
    """A folder of files and its manifest: (name, start, n_docs, n_ids); start counts the ids of all files before."""

    folder: str
    manifest: DataFrame


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> TokenFiles:
    """Writes the ids of every text of ``docs``, ``END_ID`` after each, in ascending order of ``id_column``.

    ``path`` names the vocabulary file, read on the driver and sent to each executor. Defined results: a null text is
    empty and has the end id alone; null ids come first; rows with one id follow each other in the order of their files
    and positions there, and a third of all rows under one id is dealt over many tasks; texts of any length are encoded
    whole; an empty table gives an empty manifest; other columns, whatever their names, are never read. The manifest
    has one row per file of at least ``FILE_IDS`` ids (the last of each task excepted), so one task can add them up.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    folder = shared_folder(spark, "token-ids")
    rows = located(docs, [id_column, text_column], "token-rows").toDF("id", "text", PLACE)
    rows = rows.select(F.col("id").cast("long"), f"{PLACE}.file", f"{PLACE}.position", "text")
    keys = ["id", "file", "position"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    files = working_table(ordered.mapInArrow(writer(folder, vocabulary), FILES), "token-files")
    before = Window.orderBy("first_id", "first_file", "first_position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_ids").over(before), F.lit(0))
    return TokenFiles(folder, files.select("name", start.alias("start"), "n_docs", "n_ids"))


def reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(name, start) of files -> (doc_id, start, n_tokens, ids_crc32) of their documents."""
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = FileReader(folder, name)
                crcs = [crc for _, _, crc in file.documents()]
                counts = file.tables.counts
                begins = start + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.tables.doc_ids, pa.int64()), pa.array(begins), pa.array(counts), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read


def read_back(files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; one task reads one file or few."""
    rows = working_table(files.manifest.select("name", "start"), "token-starts")
    tasks = max(1, min(rows.count(), 100_000))
    return rows.repartition(tasks).mapInArrow(reader(files.folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
