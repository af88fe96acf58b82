"""Line dedup against levelled sorted runs of line hashes.

The store holds 128-bit hashes of the lines seen so far in sorted runs, like a log-structured merge tree: each batch of
documents is merge-anti-joined with all the runs, lines that a run has are dropped, and the batch's own new hashes make
a run of level 0. When a level has `fanout` runs, they are merged into one of the next level. Runs are tables bucketed
and sorted by hash, so a batch is shuffled to the runs and the runs stay where they are. Batches are ranges of doc_id
in ascending order, so what a run knows comes from smaller doc_ids. A batch takes about `batch_bytes` of the input, so
their number grows with it and that of the runs with its logarithm. A store that the caller gives stays: the next corpus,
whose doc_ids are larger, is then held against all before.

Defined results: a null or empty text is one empty line; a null doc_id takes no part and loses no lines; rows of one
doc_id are one document (each row is returned); other columns are ignored or, with_text, kept whatever their names, and
n_chars, if there is one, is counted anew; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import text as T
from voxelframe.llm.rendezvous import Rendezvous
from voxelframe.session import input_bytes, keep, scratch, ship, shuffle_partitions, table

SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
SECOND = np.uint64(0xA0761D6478BD642F)
#: Bytes of input files that one batch takes; there are three batches at least.
BATCH_BYTES = 64 << 30


def lines(buf: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Start, end and row of every line; whether its key has `least` code points; two hashes of the key."""
    rows = len(off) - 1
    # Every row's text and a newline, so that rows end as lines do.
    put = off[1:] + np.arange(rows)
    text = np.empty(len(buf) + rows, np.uint8)
    body = np.ones(len(text), bool)
    body[put] = False
    text[body], text[put] = buf, 10
    end = np.flatnonzero(text == 10)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    row = np.searchsorted(put, end)
    low = T.LOWER[text]
    solid = np.flatnonzero(~T.SPACE[low])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = b > a
    first = np.where(some, solid[np.minimum(a, max(0, len(solid) - 1))] if len(solid) else 0, start)
    last = np.where(some, solid[b - 1] + 1 if len(solid) else 0, start)
    points = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80, dtype=np.int64)])
    sums = T.prefix(low)
    h = T.span_hash(sums, first, last, low)
    # The second hash has other byte values and is independent of the first.
    turned = T.TURN[low]
    g = T.span_hash(T.prefix(turned), first, last, turned) ^ SECOND
    shift = row  # newlines that were put in before
    return start - shift, end - shift, row, points[last] - points[first] >= least, h, g


def hashed_lines(docs: DataFrame, least: int) -> DataFrame:
    """Distinct (doc_id, h, g) of the keys that have `least` code points."""

    def run(batches):
        for batch in batches:
            named = batch.filter(batch.column("doc_id").is_valid())
            ids = np.asarray(named.column("doc_id").cast(pa.int64()))
            for i, _, buf, off in T.chunks(*T.flat(named.column("text"))):
                _, _, row, long, h, g = lines(buf, off, least)
                record = np.unique(np.stack([ids[row[long] + i], h[long].view(np.int64), g[long].view(np.int64)], axis=1), axis=0) if long.any() else np.zeros((0, 3), np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": record[:, 0], "h": record[:, 1], "g": record[:, 2]})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h long, g long")


class LineStore:
    """Runs of line hashes by level."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []

    def _run(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        ordered = df.select("h", "g").repartition(self.buckets, "h").sortWithinPartitions("h", "g")
        ordered.write.bucketBy(self.buckets, "h").sortBy("h", "g").option("path", scratch(self.spark, name)).saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of distinct (doc_id, h, g) from documents with larger doc_ids than all before; returns those
        that are not the first of their hash."""
        own = batch.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        new = reduce(lambda left, run: left.join(run, ["h", "g"], "left_anti"), self.runs(), own)
        new = keep(new, "new-lines")
        # What isn't new is in a run; what is new repeats after its first document.
        known = new.where(F.col("first") < F.col("last"))
        dropped = batch.join(new.select("h", "g"), ["h", "g"], "left_anti").unionByName(batch.join(known.select("h", "g", "first"), ["h", "g"]).where(F.col("doc_id") > F.col("first")).drop("first"))
        dropped = keep(dropped.select("doc_id", "h", "g"), "dropped-lines")
        self._push(0, self._run(new))
        return dropped

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged = self._run(reduce(DataFrame.unionByName, [self.spark.table(x) for x in self.levels[level]]))
            self._drop(self.levels[level])
            self.levels[level] = []
            self._push(level + 1, merged)

    def _drop(self, names: list[str]) -> None:
        for x in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {x}")

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def batches_of(rows: DataFrame, n: int) -> list[DataFrame]:
    """Ranges of doc_id of about equal numbers of rows, in ascending order."""
    edges = sorted(set(rows.approxQuantile("doc_id", [k / n for k in range(1, n)], min(0.02, 0.25 / n)))) if n > 1 else []
    bounds = [None, *map(int, edges), None]
    out = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = rows if low is None else rows.where(F.col("doc_id") > low)
        out.append(part if high is None else part.where(F.col("doc_id") <= high))
    return out


def drop_repeats(docs: DataFrame, least: int = 10, batches: int | None = None, fanout: int = 2, with_text: bool = False, store: LineStore | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A row for each of `docs` (doc_id, text): doc_id and digests of the lines that stay. with_text instead keeps all
    columns of docs, and replaces the text."""
    spark = docs.sparkSession
    ship(spark)
    found = keep(hashed_lines(docs, least), "lines")
    runs = store or LineStore(spark, shuffle_partitions(spark), fanout)
    try:
        n = batches or max(3, -(-input_bytes(docs) // batch_bytes))
        dropped = reduce(DataFrame.unionByName, [runs.add(b) for b in batches_of(found, n)])
    finally:
        if store is None:
            runs.close()
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if with_text else []
    r = Rendezvous(docs, others)
    gone = dropped.select("h", "g", "doc_id", r.group_of(F.col("doc_id")).alias("grp")).repartitionById(r.n, "grp")

    def key(doc, h, g):
        return T.mix(T.mix(h ^ T.mix(doc.view(np.uint64))) + g)

    columns = docs.columns

    def finish(docs, gone):
        ids = np.asarray(docs["doc_id"].cast(pa.int64()).fill_null(0))
        named = np.asarray(docs["doc_id"].is_valid())
        wanted = [np.ascontiguousarray(np.asarray(gone[c]).astype(np.int64)) for c in ("doc_id", "h", "g")]
        bad = key(*(x.view(np.uint64) for x in wanted))
        order = np.argsort(bad)
        bad, wanted = bad[order], [x[order] for x in wanted]

        def dropped(*line):
            """Whether a line is one of those, by the whole of both hashes and the doc_id."""
            mixed, hit = key(*(x.view(np.uint64) for x in line)), np.zeros(len(line[0]), bool)
            at, left = np.searchsorted(bad, mixed), np.arange(len(mixed))
            while len(left):
                left = left[(at[left] < len(bad)) & ~hit[left]]
                left = left[bad[at[left]] == mixed[left]]
                hit[left] = np.all([x[at[left]] == y[left] for x, y in zip(wanted, line, strict=True)], axis=0)
                at[left] += 1
            return hit

        texts, total, out = [], [], []
        for i, j, buf, off in T.chunks(*T.flat(docs["text"])):
            start, end, row, long, h, g = lines(buf, off, least)
            drop = long & named[row + i]
            drop[drop] = dropped(np.ascontiguousarray(ids[row[drop] + i].astype(np.int64)), h[drop].view(np.int64), g[drop].view(np.int64))
            total.append(np.bincount(row, minlength=j - i))
            out.append(np.bincount(row, drop, j - i).astype(np.int64))
            s, e, kept = start[~drop], end[~drop], row[~drop]
            size = e - s + 1
            data = np.full(int(size.sum()), 10, np.uint8)
            stop = np.cumsum(size)
            body = np.ones(len(data), bool)
            body[stop - 1] = False
            data[body] = buf[T.take_ranges(s, e - s)]
            cut = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(np.bincount(kept, minlength=j - i))])].tolist()
            raw = data.tobytes()
            texts += [raw[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        if with_text:
            new = pa.array(texts, pa.binary()).cast(pa.string())
            made = {"doc_id": docs["doc_id"], "text": new}
            if others:
                made |= zip(others, docs["others"].combine_chunks().flatten(), strict=True)
            if "n_chars" in made:
                made["n_chars"] = pa.compute.utf8_length(new).cast(made["n_chars"].type)
            return pa.table([made[c] for c in columns], names=columns)
        return pa.table({"doc_id": docs["doc_id"].cast(pa.int64()), "n_lines": T.joined(total, np.int64), "n_dropped": T.joined(out, np.int64), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())})

    from pyspark.sql import types as S

    return r.docs.groupBy("grp").cogroup(gone.groupBy("grp")).applyInArrow(lambda key, left, right: finish(left, right), S.StructType(docs.schema.fields) if with_text else SCHEMA)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), keys AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keys WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.i, k.line, f.first IS NOT NULL AND k.doc_id > f.first AS gone FROM keys k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
