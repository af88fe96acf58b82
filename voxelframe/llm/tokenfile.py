"""Token ids on disk: patched frame-of-reference blocks.

A file holds consecutive documents:

    "PFR1" | blocks | index | footer

A block of up to BLOCK ids is a header (count u16, width u8, unused u8, exceptions u16, unused u16, minimum u32), the
ids less the minimum in `width` bits each, and a list of exceptions: the places (u16), then the high parts (u32), of
those that do not fit. The width is what the given percentile of the block's ids needs. Packed ids stand in lanes: of
the 64 rows of a block, row r begins at bit r * width of each lane, so that all lanes and all blocks of one width are
packed together by 64 shifts.

The index has the byte at which each block starts (u64), and the doc_id (i64) and number of ids (u32) of each document.
The footer has their numbers and the file's number of ids. A reader needs the index and the blocks that a document
touches, no more.

Files are written by tasks over ranges of doc_id to storage that all executors share, under names that hold the attempt,
and only those that a finished task names are read: a task that is run again leaves no half a file in the way.

Defined results: null and empty texts are the end id alone; a null doc_id comes before all others; rows of one doc_id
stand together, ordered by text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelframe.llm import bpe
from voxelframe.llm import text as T
from voxelframe.session import input_bytes, keep, scratch, ship, shuffle_partitions, table

MAGIC, BLOCK, ROWS = b"PFR1", 1024, 64
LANES = BLOCK // ROWS
HEADER, FOOTER = struct.Struct("<HBxHxxI"), struct.Struct("<QQQ")
NULL_ID = -(2**63)
FILE_BYTES = 16 << 20
WRITTEN = "part long, path string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack_lanes(v: np.ndarray, width: int) -> np.ndarray:
    """Blocks of BLOCK values below 2**width to `width` words a lane; blocks × width × LANES, uint64."""
    v = v.reshape(-1, ROWS, LANES).astype(np.uint64)
    out = np.zeros((len(v), width, LANES), np.uint64)
    for r in range(ROWS if width else 0):
        word, bit = divmod(r * width, 64)
        out[:, word] |= v[:, r] << np.uint64(bit)
        if bit + width > 64:
            out[:, word + 1] |= v[:, r] >> np.uint64(64 - bit)
    return out


def unpack_lanes(words: np.ndarray, width: int) -> np.ndarray:
    words = words.reshape(-1, width, LANES)
    out = np.zeros((len(words), ROWS, LANES), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for r in range(ROWS if width else 0):
        word, bit = divmod(r * width, 64)
        x = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - bit))
        out[:, r] = x & mask
    return out.reshape(-1, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = 95.0) -> list[bytes]:
    """Blocks of BLOCK ids; the last may have fewer, and is filled up with its minimum."""
    n = -(-len(ids) // BLOCK)
    v = np.zeros((n, BLOCK), np.uint32)
    v.reshape(-1)[: len(ids)] = ids
    count = np.full(n, BLOCK)
    if len(ids) % BLOCK:
        count[-1] = len(ids) % BLOCK
        v[-1, count[-1] :] = v[-1, : count[-1]].min()
    low = v.min(1)
    v -= low[:, None]
    at = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    width = bit_length(np.partition(v, at, axis=1)[:, at])
    over = (v >> width[:, None].astype(np.uint32)) > 0
    odd = over.sum(1)
    packed: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        lanes = pack_lanes(v[own] & np.uint32((1 << w) - 1), w)
        for k, x in zip(own.tolist(), lanes, strict=True):
            packed[k] = x.tobytes()
    row, place = np.nonzero(over)
    high = (v[row, place] >> width[row].astype(np.uint32)).astype("<u4").tobytes()
    place = place.astype("<u2").tobytes()
    cut = np.concatenate([[0], np.cumsum(odd)]).tolist()
    return [HEADER.pack(c, w, m, x) + packed[k] + place[2 * cut[k] : 2 * cut[k + 1]] + high[4 * cut[k] : 4 * cut[k + 1]] for k, (c, w, m, x) in enumerate(zip(count.tolist(), width.tolist(), odd.tolist(), low.tolist(), strict=True))]


def decode_blocks(data: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that start at these bytes of data."""
    heads = [HEADER.unpack_from(data, s) for s in starts]
    out = np.empty((len(heads), BLOCK), np.uint32)
    width = np.array([h[1] for h in heads])
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        raw = b"".join(data[starts[k] + HEADER.size : starts[k] + HEADER.size + 8 * w * LANES] for k in own.tolist())
        out[own] = unpack_lanes(np.frombuffer(raw, np.uint64), w) if w else 0
    for k, (s, (_, w, m, _)) in enumerate(zip(starts, heads, strict=True)):
        if m:
            at = s + HEADER.size + 8 * w * LANES
            place = np.frombuffer(data, "<u2", m, at)
            out[k, place] |= np.frombuffer(data, "<u4", m, at + 2 * m) << np.uint32(w)
    out += np.array([h[3] for h in heads], np.uint32)[:, None]
    if heads and heads[-1][0] < BLOCK:
        return out.reshape(-1)[: len(out) * BLOCK - BLOCK + heads[-1][0]]
    return out.reshape(-1)


class Writer:
    """Takes documents in turn and keeps less than a block and the index in memory."""

    def __init__(self, stream, percentile: float = 95.0):
        self.stream, self.percentile = stream, percentile
        self.rest, self.at = [np.zeros(0, np.uint32)], len(MAGIC)
        self.starts: list[int] = []
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        stream.write(MAGIC)

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.ids.append(doc_ids)
        self.counts.append(counts)
        self.rest.append(ids)
        if sum(map(len, self.rest)) >= 64 * BLOCK:
            ids = np.concatenate(self.rest)
            whole = len(ids) // BLOCK * BLOCK
            self._put(ids[:whole])
            self.rest = [ids[whole:]]

    def _put(self, ids: np.ndarray) -> None:
        made = encode_blocks(ids, self.percentile)
        for b in made:
            self.starts.append(self.at)
            self.at += len(b)
        self.stream.write(b"".join(made))

    def close(self) -> tuple[int, int]:
        """The numbers of documents and of ids."""
        ids = np.concatenate(self.rest)
        if len(ids):
            self._put(ids)
        counts = np.concatenate([np.zeros(0, np.int64), *self.counts])
        self.stream.write(np.array(self.starts, "<u8").tobytes() + np.concatenate([np.zeros(0, np.int64), *self.ids]).astype("<i8").tobytes() + counts.astype("<u4").tobytes())
        self.stream.write(FOOTER.pack(len(self.starts), len(counts), int(counts.sum())))
        return len(counts), int(counts.sum())


class Reader:
    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        blocks, docs, self.n_tokens = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        self.end = size - FOOTER.size - 8 * blocks - 12 * docs
        index = self._at(self.end, 8 * blocks + 12 * docs)
        if self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        self.starts = np.frombuffer(index, "<u8", blocks)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.counts = np.frombuffer(index, "<u4", docs, 8 * blocks + 8 * docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def _at(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def blocks(self, a: int, b: int) -> np.ndarray:
        """The ids of blocks a to b - 1."""
        edges = [*self.starts[a:b].tolist(), int(self.starts[b]) if b < len(self.starts) else self.end]
        return decode_blocks(self._at(edges[0], edges[-1] - edges[0]), [x - edges[0] for x in edges[:-1]])

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from the blocks that it touches."""
        a, b = int(self.first[k]), int(self.first[k + 1])
        if a == b:
            return np.zeros(0, np.uint32)
        block = a // BLOCK
        return self.blocks(block, -(-b // BLOCK))[a - block * BLOCK : b - block * BLOCK]

    def documents(self, size: int = 1 << 20):
        """Runs of documents of about `size` ids: (first document, end document, ids)."""
        i, n = 0, len(self.counts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + size, "right")) - 1)
            a, b = int(self.first[i]), int(self.first[j])
            block = a // BLOCK
            yield i, j, self.blocks(block, -(-b // BLOCK))[a - block * BLOCK : b - block * BLOCK] if b > a else np.zeros(0, np.uint32)
            i = j


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2, percentile: float = 95.0) -> DataFrame:
    """Encode `docs` (doc_id, text) and write files in ascending order of doc_id; returns a row for each file, kept in a
    table: its place in the order, path, and numbers of documents and ids."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = vocabulary or bpe.default_path()
    n = max(shuffle_partitions(spark), -(-input_bytes(docs) // FILE_BYTES))

    def run(batches):
        from pyspark import TaskContext

        encode, writer = bpe.encoder(vocabulary, bpe.Library, fine=True), None
        store, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(root, recursive=True)
                path = f"{root}/part-{part:06d}-{uuid.uuid4().hex[:12]}.pfr"
                writer = Writer(store.open_output_stream(path), percentile)
            ids = np.asarray(batch.column("doc_id").cast(pa.int64()).fill_null(NULL_ID))
            for i, j, buf, off in T.chunks(*T.flat(batch.column("text"))):
                tokens, count = encode(buf, off)
                out = np.full(len(tokens) + j - i, end_id, np.uint32)
                out[np.arange(len(tokens)) + np.repeat(np.arange(j - i), count)] = tokens
                writer.add(ids[i:j], count + 1, out)
        if writer is not None:
            numbers = writer.close()
            writer.stream.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [numbers[0]], "n_tokens": [numbers[1]]})

    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return keep(ordered.mapInArrow(run, WRITTEN), "manifest")


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each document of the files: where it starts among all ids, its number of ids and their crc32."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("begin"))  # a small row for each file

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as stream:
                    reader = Reader(stream)
                    for i, j, ids in reader.documents():
                        raw, cut = ids.astype("<u4").tobytes(), (reader.first[i : j + 1] - reader.first[i]).tolist()
                        doc = reader.doc_ids[i:j]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(doc, pa.int64(), mask=doc == NULL_ID), "start": begin + reader.first[i:j], "n_tokens": reader.counts[i:j],
                            "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.int64()),
                        })

    return files.repartitionByRange(max(1, manifest.count()), "begin").mapInArrow(run, READ)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    return read(spark, write(table(spark, sf_dir, "documents"), folder), folder)
