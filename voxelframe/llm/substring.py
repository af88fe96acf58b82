"""Substring dedup by difference-cover anchors.

Two equal windows of `width` words start at places i and j of their documents. With a difference cover of the residues
modulo `period`, some shift under the period brings both i and j to cover places, so both windows hold an equal shorter
window of width - period + 1 words that starts at a cover place in either document: an anchor. Only anchors are hashed
and compared at first, 3 of 7 places. Windows that hold a shared anchor are then extended to their full width and
compared whole; words of a window that starts in a document of a smaller doc_id are removed.

Windows are compared by 64-bit fingerprints of their word sequences.

Defined results: null and empty texts have no words; rows of one doc_id are one document (each row is returned); a null
doc_id takes no part and loses nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxelframe.llm import text as T
from voxelframe.llm.rendezvous import Rendezvous, cuts, merge
from voxelframe.session import table

#: Every difference modulo 7 is one of two of these residues.
PERIOD, COVER = 7, (0, 1, 3)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Words:
    """The words of a group's documents; anchors and windows by their first word."""

    def __init__(self, docs: pa.Table, width: int):
        self.ids = docs["doc_id"].cast(pa.int64())
        ids = np.asarray(self.ids.fill_null(0))
        named = ~np.asarray(self.ids.is_null())
        self.buf, self.off = T.flat(docs["text"])
        starts, ends, rows, hashes = [], [], [], []
        for i, _, buf, off in T.chunks(self.buf, self.off):
            s, e, row = T.spans(buf, off)
            hashes.append(T.span_hash(T.prefix(buf), s, e, buf))
            starts.append(s + self.off[i])
            ends.append(e + self.off[i])
            rows.append(row + i)
        self.start, self.end, self.row = (T.joined(x, np.int64) for x in (starts, ends, rows))
        h = T.joined(hashes, np.uint64)
        self.count = np.bincount(self.row, minlength=len(ids))
        place = np.arange(len(h)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.doc, self.width = ids, width
        short = width - PERIOD + 1
        ok = named[self.row]
        n = max(0, len(h) - short + 1)
        at = place % PERIOD
        self.anchor = np.flatnonzero((at[:n] == COVER[0]) | (at[:n] == COVER[1]) | (at[:n] == COVER[2]))
        self.anchor = self.anchor[(self.row[self.anchor] == self.row[self.anchor + short - 1]) & ok[self.anchor] & (self.count[self.row[self.anchor]] >= width)]
        self.anchor_key = T.windows(h, short)[self.anchor]
        self.h, self.anchors = h, None

    def first_round(self) -> np.ndarray:
        """Distinct anchors; self.local tells those that several of the group's documents hold."""
        self.anchors, index = np.unique(self.anchor_key, return_inverse=True)
        doc = self.doc[self.row[self.anchor]]
        low, high = np.full(len(self.anchors), np.iinfo(np.int64).max), np.full(len(self.anchors), np.iinfo(np.int64).min)
        np.minimum.at(low, index, doc)
        np.maximum.at(high, index, doc)
        self.index, self.local = index, low < high
        return self.anchors

    def second_round(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows that hold a shared anchor, and the smallest doc_id of each in this group."""
        n = max(0, len(self.h) - self.width + 1)
        marks = np.zeros(len(self.h) + 1, np.int32)
        marks[1 + self.anchor[(shared | self.local)[self.index]]] = 1
        marks = np.cumsum(marks, dtype=np.int32)
        self.at = np.flatnonzero((marks[PERIOD : PERIOD + n] > marks[:n]) & (self.row[:n] == self.row[self.width - 1 :]))
        keys, self.key_of = np.unique(T.windows(self.h, self.width)[self.at], return_inverse=True)
        self.first = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.key_of, self.doc[self.row[self.at]])
        return keys, self.first

    def removed(self, smaller: np.ndarray) -> np.ndarray:
        """Words of windows that start in a smaller doc_id, here or elsewhere."""
        gone = self.at[smaller[self.key_of] | (self.doc[self.row[self.at]] > self.first[self.key_of])]
        d = np.zeros(len(self.h) + 1, np.int32)
        d[gone] += 1
        np.subtract.at(d, gone + self.width, 1)
        return np.cumsum(d[:-1], dtype=np.int32) > 0


def _sizes(keys: np.ndarray, n: int) -> np.ndarray:
    return np.diff(cuts(keys, n))


def remove_repeats(docs: DataFrame, width: int = 13, with_text: bool = False) -> DataFrame:
    """A row for each of `docs` (doc_id, text); with_text adds the kept words as one string."""
    if width < 2 * PERIOD - 1:
        raise ValueError(f"windows have {2 * PERIOD - 1} words or more")
    r = Rendezvous(docs)
    n = r.n

    def split(answers):
        return {b: p for b, p in answers.items() if b < 1 << 24}, {b - (1 << 24): p for b, p in answers.items() if b >= 1 << 24}

    def ask_anchors(docs, _):
        return (_Words(T.rows_in_order(docs), width).first_round(),)

    def elsewhere(_, asked):
        groups, ends, index, (keys,) = merge(asked)
        many = np.bincount(index, minlength=len(keys)) > 1
        for g, a, b in zip(groups, ends[:-1], ends[1:], strict=True):
            yield g, np.packbits(many[index[a:b]]).tobytes()

    def ask_windows(docs, answers):
        w = _Words(T.rows_in_order(docs), width)
        return w.second_round(T.bits_of(answers, _sizes(w.first_round(), n)))

    def earlier(_, asked):
        groups, ends, index, (doc, keys) = merge(asked)
        low = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(low, index, doc)
        before = low[index] < doc
        for g, a, b in zip(groups, ends[:-1], ends[1:], strict=True):
            yield g, np.packbits(before[a:b]).tobytes()

    def finish(docs, answers):
        anchors, windows = split(answers)
        w = _Words(T.rows_in_order(docs), width)
        keys, _ = w.second_round(T.bits_of(anchors, _sizes(w.first_round(), n)))
        gone = w.removed(T.bits_of(windows, _sizes(keys, n)))
        left = np.bincount(w.row[~gone], minlength=len(w.doc))
        shas, texts, at = [], [], 0
        ends = np.cumsum(w.count)
        for i, j, _, _ in T.chunks(w.buf, w.off):
            k = np.arange(at, ends[j - 1])
            at = ends[j - 1]
            k = k[~gone[k]]
            size = w.end[k] - w.start[k] + 1
            out = w.buf[np.minimum(T.take_ranges(w.start[k], size), max(0, len(w.buf) - 1))]
            stop = np.cumsum(size)
            out[stop - 1] = 0x20
            data, stop = out.tobytes(), np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(left[i:j])])]
            for a, b in zip(stop[:-1], stop[1:], strict=True):
                kept = data[a : b - 1] if b > a else b""
                shas.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept)
        made = {"doc_id": w.ids, "n_words": w.count, "n_removed": w.count - left, "kept_sha256": pa.array(shas, pa.string())}
        return pa.table(made | ({"kept": pa.array(texts, pa.binary()).cast(pa.string())} if with_text else {}))

    first = r.answer(r.ask(ask_anchors), elsewhere)
    second = r.answer(r.ask(ask_windows, first), earlier, tag=1)
    return r.finish(finish, first.unionByName(second), SCHEMA + (", kept string" if with_text else ""))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
