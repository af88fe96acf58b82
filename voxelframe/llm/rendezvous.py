"""Documents in hashed groups ask about keys; buckets of the key space answer.

A group or bucket is a partition of its own: rows go to the partition of their number, not to that of its hash.

Each group of documents reduces its keys to distinct ones with what it knows of them (the map-side combine: a key that
is in a third of all documents is one entry a group), and sends each bucket one block. A bucket sees all groups' entries
for its share of the keys and answers each group entry by entry, in the same order, so an answer carries no keys. The
documents are shuffled once; later rounds reuse that exchange. Nothing is gathered to the driver, and every block is
remade from its inputs if an executor is lost.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.session import input_bytes, ship, shuffle_partitions

#: Bytes of input files that one group of documents holds. There are groups times buckets blocks, so groups grow with the
#: square root of a large input, which keeps a block at BLOCK_BYTES or more: 5 MB at 30 GB, 300 MB at 100 TB.
GROUP_BYTES, BLOCK_BYTES = 6 << 20, 1 << 10
BLOCK = pa.schema([("grp", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
BLOCK_DDL = "grp int, bucket int, payload binary"


def lean() -> None:
    """Give memory that is free back to the system, now and, for large arrays, whenever they are freed: a Python worker
    lives through many tasks beside the JVM that has most of the executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pack(*arrays: np.ndarray, rising: bool = True) -> bytes:
    """Arrays as one block; the first, if rising, as differences. Bytes of equal weight stand together, so that the
    shuffle's compression removes those that are nearly always zero."""
    out = []
    for k, a in enumerate(arrays):
        a = np.ascontiguousarray(a)
        if rising and k == 0 and len(a):
            a = np.concatenate([a[:1], np.diff(a)])
        out.append(struct.pack("<2sxxxxxxq", a.dtype.str[1:].encode(), len(a)))
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() if len(a) else b"")
    return b"".join(out)


def unpack(block: bytes, rising: bool = True) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(block):
        kind, n = struct.unpack_from("<2sxxxxxxq", block, at)
        at += 16
        kind = np.dtype("<" + kind.decode())
        a = np.frombuffer(block, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(a.T).view(kind).reshape(n)
        at += n * kind.itemsize
        out.append(np.cumsum(a, dtype=kind) if rising and not out and n else a)
    return out


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal shares of the key space begins in sorted keys."""
    edges = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


class Rendezvous:
    """Groups of the rows of `docs`, which has doc_id and text; `others` are further columns, kept in the struct `others`."""

    def __init__(self, docs: DataFrame, others: Iterable[str] = (), group_bytes: int = GROUP_BYTES):
        spark = docs.sparkSession
        ship(spark)
        size = input_bytes(docs)
        self.n = max(shuffle_partitions(spark), int(size / max(group_bytes, (size * BLOCK_BYTES) ** 0.5)) + 1)
        more = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")] if others else []
        self.docs = docs.select("doc_id", "text", *more, self.group_of(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))).alias("grp")).repartitionById(self.n, "grp")

    def group_of(self, doc_id):
        return F.pmod(F.xxhash64(doc_id), F.lit(self.n)).cast("int")

    def ask(self, fn: Callable, answers: DataFrame | None = None) -> DataFrame:
        """fn(documents, answers by bucket) gives sorted distinct uint64 keys and any arrays that go with them, or
        an iterator of ready (bucket, block)."""
        n = self.n

        def run(grp, docs, got):
            lean()
            made = fn(docs, blocks(got, "bucket") if got is not None else None)
            if isinstance(made, tuple):
                keys, *rest = made
                at = cuts(keys, n)
                made = ((b, pack(keys[at[b] : at[b + 1]], *(x[at[b] : at[b + 1]] for x in rest))) for b in range(n))
            made = list(made)
            lean()
            return pa.table([pa.array([grp] * len(made), pa.int32()), pa.array([b for b, _ in made], pa.int32()), pa.array([p for _, p in made], pa.binary())], BLOCK)

        if answers is None:
            return self.docs.groupBy("grp").applyInArrow(lambda key, t: run(key[0].as_py(), t, None), BLOCK_DDL)
        return self._with(answers).applyInArrow(lambda key, t, a: run(key[0].as_py(), t, a), BLOCK_DDL)

    def answer(self, asks: DataFrame, fn: Callable, tag: int = 0) -> DataFrame:
        """fn(bucket, {group: block}) gives (group, block) pairs. tag tells the answers of several rounds apart."""

        def run(key, t):
            lean()
            made = list(fn(key[0].as_py(), blocks(t, "grp")))
            lean()
            return pa.table([pa.array([g for g, _ in made], pa.int32()), pa.array([key[0].as_py() + (tag << 24)] * len(made), pa.int32()), pa.array([p for _, p in made], pa.binary())], BLOCK)

        return asks.repartitionById(self.n, "bucket").groupBy("bucket").applyInArrow(run, BLOCK_DDL)

    def finish(self, fn: Callable, answers: DataFrame, schema: str) -> DataFrame:
        """fn(documents, answers by bucket) gives a table of the result's rows."""
        def run(key, t, a):
            lean()
            return fn(t, blocks(a, "bucket"))

        return self._with(answers).applyInArrow(run, schema)

    def _with(self, answers: DataFrame):
        return self.docs.groupBy("grp").cogroup(answers.repartitionById(self.n, "grp").groupBy("grp"))


def blocks(t: pa.Table, by: str) -> dict[int, bytes]:
    """In order of their keys, whatever order the shuffle brought them in."""
    return dict(sorted(zip(t[by].to_pylist(), t["payload"].to_pylist(), strict=True)))


def merge(asked: dict[int, bytes]) -> tuple[list[int], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a bucket's blocks: the groups, where each begins and ends, each entry's distinct key as an index, and the
    arrays, entries of all groups one after another. The last of the arrays is the keys."""
    parts = {g: unpack(p) for g, p in asked.items()}
    ends = np.cumsum([0, *(len(x[0]) for x in parts.values())])
    joined = [np.concatenate(x) for x in zip(*parts.values(), strict=True)]
    keys, index = np.unique(joined[0], return_inverse=True)
    return list(parts), ends, index.reshape(-1), [*joined[1:], keys]
