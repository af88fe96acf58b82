"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item leaks into a document if a part of the document is within k edits (insert, delete, replace a character)
of the whole item, both with A-Z lower-cased and white space drawn together; k is `rate` of the item's length in
characters. Such a part shares at least m + 1 - q - k * q q-grams with an item of m characters, and all of these on at
most k + 1 neighbouring diagonals (place in the document less place in the item). Diagonals are covered by bands of twice
that width that overlap by half, shared q-grams are counted by document, item and band, and only bands with enough of
them are aligned, along those diagonals.

q is 8, and less for items so short that the lemma would not ask for a common q-gram: then it is m / (k + 1), for which it
asks for one. So items of every length have the same edit rate.

The items are read in blocks of bounded size; every block runs over all the documents. Equal q-grams are counted some at
a time, so that an item and a document that repeat the same few characters take time but no memory.

Defined results: null and empty texts and items, and items with a null item_id, match nothing; a null doc_id is reported
as null; rows with one doc_id are searched each, equal findings are reported once; equal items under different item_ids
are all reported; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import text as T
from voxelframe.llm.rendezvous import lean
from voxelframe.session import ship, table

Q, RATE = 8, 0.1
#: Bytes of items in a block.
ITEM_BYTES = 8 << 20
#: Pairs of equal q-grams that are counted at a time, and characters and band widths that are aligned at a time.
SOME, CELLS = 1 << 18, 1 << 19
SCHEMA = "doc_id long, item_id long, edits int, start long, end long"


def normal(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, lower-case, each run of white space one space, none at a row's ends; offsets, and the places of the
    code points in the bytes, with that of the end."""
    space = T.SPACE[buf]
    keep = ~space
    again = space.copy()  # white space after a word: its first byte stays
    again[1:] &= keep[:-1]
    first = off[:-1][off[:-1] < len(buf)]
    again[first] = False
    start, end, row = T.spans(buf, off)
    last = end[np.append(row[1:] != row[:-1], True)] if len(row) else end
    tail = last[last < len(buf)]
    again[tail] = False
    at = np.flatnonzero(keep | again)
    out = np.where(space[at], np.uint8(32), T.LOWER[buf[at]])
    whole = (out & 0xC0) != 0x80  # the first byte of a code point
    text = np.frombuffer(out.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return text, np.concatenate([[0], np.cumsum(whole)])[np.searchsorted(at, off)], at[whole]


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """The hash of every q code points."""
    return T.windows(T.mix(text.astype(np.uint64)), q)


class Items:
    def __init__(self, ids: list[int], texts: list[str], rate: float = RATE):
        text, off, _ = normal(*T.flat(pa.array(texts, pa.string())))
        some = np.flatnonzero(np.diff(off) > 0)
        self.ids, self.codes = [ids[k] for k in some.tolist()], [text[off[k] : off[k + 1]] for k in some.tolist()]
        self.texts = [x.tobytes().decode("utf-32-le") for x in self.codes]
        self.size = size = np.diff(off)[some]
        self.k = (rate * size + 1e-9).astype(np.int64)
        self.q = np.where(size + 1 - Q - self.k * Q >= 1, Q, size // (self.k + 1))
        self.need = size + 1 - self.q - self.k * self.q
        self.tables = {}
        for q in np.unique(self.q).tolist():
            own = np.flatnonzero(self.q == q)
            parts = [grams(self.codes[k], q) for k in own.tolist()]
            many = np.array([len(x) for x in parts])
            g, item, place = np.concatenate(parts), np.repeat(own, many), np.concatenate([np.arange(n) for n in many])
            order = np.argsort(g, kind="stable")
            keys, first, many = np.unique(g[order], return_index=True, return_counts=True)
            seen = np.zeros(1 << 22, bool)
            seen[self._spot(keys)] = True
            self.tables[q] = (keys, first, many, item[order], place[order], seen)

    @staticmethod
    def _spot(g: np.ndarray) -> np.ndarray:
        return g >> np.uint64(42)

    def hits(self, g: np.ndarray, q: int):
        """Places in g, items, and places in the items, of all equal q-grams, some at a time."""
        keys, first, many, item, place, seen = self.tables[q]
        near = np.flatnonzero(seen[self._spot(g)])
        at = np.minimum(np.searchsorted(keys, g[near]), len(keys) - 1)
        hit = keys[at] == g[near]
        near, at = near[hit], at[hit]
        total = np.cumsum(many[at])
        for low in range(0, int(total[-1]) if len(total) else 0, SOME):
            k = np.arange(low, min(low + SOME, int(total[-1])))
            own = np.searchsorted(total, k, "right")
            entry = first[at[own]] + k - (total[own] - many[at[own]])
            yield near[own], item[entry], place[entry]

    def bands(self, text: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """(row, item, band) that share enough q-grams. A band is named by its upper half's number."""
        step = int((np.diff(cut).max(initial=0) + self.size.max(initial=0))) + 2  # more than any diagonal
        out = [np.zeros((0, 3), np.int64)]
        for q in self.tables:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for place, item, other in self.hits(grams(text, q), q):
                row = np.searchsorted(cut, place, "right") - 1
                inside = place + q <= cut[row + 1]
                place, item, other, row = place[inside], item[inside], other[inside], row[inside]
                # The diagonal, from 0 on; every k + 1 neighbouring ones are in one half of two bands.
                half = (place - cut[row] - other + self.size[item]) // (self.k[item] + 1)
                found.append(np.unique((row * len(self.ids) + item) * step + half, return_counts=True))
                if len(found) > 8:
                    found = [self._summed(found)]
            code, n = self._summed(found)
            code, n = self._summed([(code, n), (code + 1, n)])
            pair, band = np.divmod(code, step)
            row, item = np.divmod(pair, max(1, len(self.ids)))
            own = n >= self.need[item]
            out.append(np.stack([row[own], item[own], band[own]], axis=1))
        return np.concatenate(out)

    @staticmethod
    def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, index = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return code, np.bincount(index.reshape(-1), np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)

    def find(self, buf: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, item) to (edits, start, end) of the best place, in bytes of the row."""
        if not self.ids:
            return {}
        text, cut, old = normal(buf, off)
        found = self.bands(text, cut)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        rest = []
        for r, i, b in sorted(map(tuple, found.tolist())):
            k, m = int(self.k[i]), int(self.size[i])
            low = (b - 1) * (k + 1) - m - k  # the least diagonal that a part with hits in the band may reach
            first, end = int(cut[r]) + max(0, low), min(int(cut[r + 1]), int(cut[r]) + low + 4 * k + 2 + m)
            at = text[first:end].tobytes().decode("utf-32-le").find(self.texts[i]) if end > first else -1
            if at >= 0:
                best[r, i] = min(best.get((r, i), (1, 0, 0)), (0, first + at, first + at + m))
            elif k:
                rest.append((r, i, int(cut[r]) + low, int(cut[r]), int(cut[r + 1])))
        rest = [x for x in rest if (x[0], x[1]) not in best]
        rest.sort(key=lambda x: -self.size[x[1]])
        at = 0
        while at < len(rest):
            m = int(self.size[rest[at][1]])  # cells of a batch are bounded
            own = rest[at : at + max(1, CELLS // (2 * m + 4 * int(self.k[rest[at][1]])))]
            at += len(own)
            for (r, i, *_), one in zip(own, self.align(text, own), strict=True):
                if one[0] <= self.k[i] and ((r, i) not in best or one < best[r, i]):
                    best[r, i] = one
        after = np.append(old[1:], off[-1])  # where the next code point begins; white space may be before it
        return {(r, i): (e, int(old[a] - off[r]), int(self._end(buf, old[z - 1], after[z - 1]) - off[r])) for (r, i), (e, a, z) in best.items()}

    @staticmethod
    def _end(buf: np.ndarray, first: int, limit: int) -> int:
        """The end of the code point that begins at a byte."""
        end = first + 1
        while end < limit and buf[end] & 0xC0 == 0x80:
            end += 1
        return end

    def align(self, text: np.ndarray, todo: list[tuple[int, ...]]) -> list[tuple[int, int, int]]:
        """For (row, item, place of the band's least diagonal, row's first and end place): the least edits between the
        item and a part of the row within the band, and that part. All are taken down their items' characters together;
        a cell holds the edits in its upper half and where the part starts below."""
        item = np.array([x[1] for x in todo])
        order = np.argsort(-self.size[item], kind="stable")
        item, low, first, end = item[order], *(np.array([x[c] for x in todo])[order] for c in (2, 3, 4))
        size, width = self.size[item], 4 * int(self.k[item].max()) + 2
        one, never = np.int64(1) << 32, np.int64(1) << 60
        at = low[:, None] + np.arange(width + int(size[0]))
        data = np.where((at >= first[:, None]) & (at < end[:, None]), text[np.clip(at, 0, len(text) - 1)], np.uint32(0xFFFFFFFF))
        of = np.zeros((len(item), int(size[0])), np.uint32)
        for k, i in enumerate(item.tolist()):
            of[k, : size[k]] = self.codes[i]
        step = np.arange(width, dtype=np.int64) << 32
        at = at[:, :width]
        line = np.where((at >= first[:, None]) & (at <= end[:, None]), at, never)
        out: list = [None] * len(item)
        live = len(item)
        for row in range(1, int(size[0]) + 1):
            while live and size[live - 1] < row:
                live -= 1
            line = line[:live]
            new = line + np.where(data[:live, row - 1 : row - 1 + width] == of[:live, row - 1, None], 0, one)
            np.minimum(new[:, :-1], line[:, 1:] + one, out=new[:, :-1])
            line = np.minimum.accumulate(new - step, axis=1) + step
            for k in range(live - 1, -1, -1):
                if size[k] > row:
                    break
                place = low[k] + row + np.arange(width)
                ends = np.where((place >= first[k]) & (place <= end[k]), line[k], never)
                z = int(np.argmin(ends))
                out[order[k]] = (int(ends[z] >> 32), int(ends[z] & 0xFFFFFFFF), int(place[z]))
        return out


def _blocks(bench: DataFrame, rate: float):
    items = bench.where("item_id IS NOT NULL AND length(text) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        rows = sorted(tuple(r) for r in part.collect())  # about ITEM_BYTES
        if rows:
            yield Items([r[0] for r in rows], [r[1] for r in rows], rate)


def leaks(docs: DataFrame, bench: DataFrame, rate: float = RATE) -> DataFrame:
    """A row for each document of `docs` (doc_id, text) and item of `bench` (item_id, text) that leaks into it: the
    edits, and the part's first and end byte."""
    ship(docs.sparkSession)

    def search(items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches):
            lean()
            items = shared.value
            for batch in batches:
                ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
                for i, _, buf, off in T.chunks(*T.flat(batch.column("text"))):
                    found = sorted(items.find(buf, off).items())
                    columns = zip(*((ids[i + r], items.ids[k], *x) for (r, k), x in found), strict=True) if found else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "edits", "start", "end"])

        return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

    found = [search(x) for x in _blocks(bench, rate)]
    if not found:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, found).dropDuplicates()


def keep_clean(docs: DataFrame, bench: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of `docs`, with all their columns, into which no item leaks."""
    ship(docs.sparkSession)

    def clean(docs: DataFrame, items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches):
            lean()
            items = shared.value
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for i, _, buf, off in T.chunks(*T.flat(batch.column("text"))):
                    for r, _ in items.find(buf, off):
                        good[i + r] = False
                yield batch.filter(pa.array(good))

        return docs.mapInArrow(run, docs.schema)

    return reduce(clean, _blocks(bench, rate), docs)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
