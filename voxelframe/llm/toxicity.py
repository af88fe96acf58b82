"""Toxicity by multiple-instance learning.

Only documents are labelled, but sentences offend. A sentence's probability is logistic in its words and their
beginnings; a document's is the noisy-or of its sentences, 1 - prod(1 - p). Both are trained together from the
documents' labels, so the blame settles on sentences, which `locate` returns.

The model is fitted on at most `per_class` labelled documents of either class, those of least hash (a documented bound);
its features are all that are significantly more frequent in toxic documents of that sample. What is significant depends
on how many features are tried, see `fit`. Every text is scored whole. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts have no sentence and score 0; a null doc_id is not held out; a doc_id with several
labels is toxic if one of them is; null labels are none; repeated rows are scored each; without labels of both classes
nothing can be learnt and all scores are nearly 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import text as T
from voxelframe.llm.lm import held_out
from voxelframe.llm.rendezvous import lean
from voxelframe.session import keep, ship, table

#: Word characters are ASCII letters and digits, and all bytes outside ASCII.
BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
STOP = np.zeros(256, np.int32)
STOP[[ord(c) for c in ".!?\n"]] = 1
BEGINNINGS = (4, 5, 6, 7)
WORD = np.uint64(0x2545F4914F6CDD1D)
THRESHOLD = 0.3
#: A sentence without any feature is hardly ever toxic, so that long documents are not for their length. Not learnt.
BIAS, DECAY = -13.0, 1e-6
#: A feature is tried if it is in so many toxic documents; of all tried, chance alone may choose so many.
TRIED, CHANCE = 3, 5


def sentences(buf: np.ndarray, off: np.ndarray):
    """Hashes of features, each one's sentence; sentences' rows, first and last byte."""
    low = T.LOWER[buf]
    start, end, row = T.spans(low, off, BREAK)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, z
    stops = np.cumsum(STOP[low])[start]
    new = np.ones(len(start), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    sums = T.prefix(low)
    hashes, of = [T.span_hash(sums, start, end, low) ^ WORD], [sentence]
    for k in BEGINNINGS:
        longer = np.flatnonzero(end - start >= k)
        hashes.append(T.span_hash(sums, start[longer], start[longer] + k, low))
        of.append(sentence[longer])
    return np.concatenate(hashes), np.concatenate(of), row[first], start[first], end[np.append(first[1:], len(start)) - 1]


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of features
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys >> np.uint64(44)] = True

    def sentence_scores(self, hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n sentences."""
        near = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, hashes[near]), max(0, len(self.keys) - 1))
        hit = self.keys[at] == hashes[near] if len(self.keys) else np.zeros(0, bool)
        pair = np.unique(of[near][hit] * len(self.keys) + at[hit])  # a feature counts once a sentence
        z = self.bias + np.bincount(pair // max(1, len(self.keys)), self.weights[pair % max(1, len(self.keys))], n)
        return 1 / (1 + np.exp(-z))


def noisy_or(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), n)) + 0.0


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, modulus: int, remainder: int) -> DataFrame:
    """At most per_class documents of each class, by least hash of doc_id; doc_id, text, toxic."""
    train = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != remainder, F.lit(True))
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    # At most 2 * per_class pairs of numbers.
    return docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")


def _weigh(toxic: np.ndarray, sizes: np.ndarray, flat: np.ndarray, doc_of: np.ndarray, rest: np.ndarray, n_features: int, steps: int = 400) -> np.ndarray:
    """Weights by Adam on the documents' cross-entropy. Sentences without features are counted in rest; those with
    features have sizes[k] of them in flat and belong to doc_of[k]."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    x = np.full(n_features, 4.0)
    m, v = np.zeros_like(x), np.zeros_like(x)
    y, n = toxic > 0, len(toxic)
    idle = np.log1p(-1 / (1 + np.exp(-BIAS)))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(BIAS + np.bincount(of, x[flat], len(sizes)))))
        log = np.minimum(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), n) + rest * idle, -1e-9)
        g = np.where(y, np.exp(log) / -np.expm1(log), -1.0)  # of the loss by log
        each = g[doc_of] * -p
        grad = np.bincount(flat, each[of], n_features) / n + DECAY * x
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
    return x


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 5000, modulus: int = 4, remainder: int = 2) -> Model:
    """Learn from `labels` (doc_id, toxic) of those of `docs` (doc_id, text) whose crc32(doc_id) % modulus is not
    remainder."""
    ship(docs.sparkSession)
    sample = keep(_sample(docs, labels, per_class, modulus, remainder), "toxic-sample")
    classes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (classes.get(0) and classes.get(1)):
        return Model(np.zeros(0, np.uint64), np.zeros(0), BIAS)

    def count(batches):
        for batch in batches:
            toxic = np.asarray(batch.column("toxic"))
            for i, _, buf, off in T.chunks(*T.flat(batch.column("text"))):
                hashes, of, row, *_ = sentences(buf, off)
                order = np.lexsort((hashes, row[of]))
                h, r = hashes[order], row[of][order] + i
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                keys, index = np.unique(h[once], return_inverse=True)
                bad = np.bincount(index, toxic[r[once]] == 1, len(keys)).astype(np.int64)
                total = np.bincount(index, minlength=len(keys))
                yield pa.RecordBatch.from_pydict({"feature": keys.view(np.int64), "bad": bad, "good": total - bad})

    found = sample.select("text", "toxic").mapInArrow(count, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # Significance of the share of toxic documents among those with the feature, as n * KL divergence from their share
    # of the sample: chance alone exceeds a gain for about one in e**gain features. So of those that TRIED toxic documents
    # have, CHANCE pass log(tried / CHANCE) by chance.
    n, base = F.col("bad") + F.col("good"), classes[1] / (classes[0] + classes[1])
    q = F.col("bad") / n
    gain = F.col("bad") * F.log(q / base) + F.when(F.col("good") > 0, F.col("good") * F.log((F.col("good") / n) / (1 - base))).otherwise(0.0)
    found = keep(found.where(F.col("bad") >= TRIED).withColumn("gain", gain), "toxic-features")
    least = float(np.log(max(1.0, found.count() / CHANCE)))
    # At most the distinct features of per_class toxic documents, and of these the significant ones.
    chosen = found.where(q > 2 * base / (1 + base)).where(F.col("gain") > least).select("feature")
    keys = np.sort(np.array([r.feature for r in chosen.collect()], np.int64).view(np.uint64))
    if not len(keys):
        return Model(keys, np.zeros(0), BIAS)

    schema = pa.schema([("toxic", pa.int32()), ("rest", pa.int32()), ("sizes", pa.list_(pa.int32())), ("flat", pa.list_(pa.int32()))])

    def bags(batches):
        for batch in batches:
            toxic = np.asarray(batch.column("toxic"))
            for i, j, buf, off in T.chunks(*T.flat(batch.column("text"))):
                hashes, of, row, *_ = sentences(buf, off)
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                pair = np.unique(of[hit] * len(keys) + at[hit])
                which, size = np.unique(pair // len(keys), return_counts=True)
                doc = row[which]
                rest = np.bincount(row, minlength=j - i) - np.bincount(doc, minlength=j - i)
                cut, end = np.cumsum(size) - size, np.cumsum(np.bincount(doc, minlength=j - i))
                made: dict[str, list] = {"toxic": [], "rest": [], "sizes": [], "flat": []}
                for k in range(j - i):
                    a, b = (end[k - 1] if k else 0), end[k]
                    made["toxic"].append(int(toxic[i + k]))
                    made["rest"].append(int(rest[k]))
                    made["sizes"].append(size[a:b].tolist())
                    made["flat"].append((pair[cut[a] : cut[b - 1] + size[b - 1]] % len(keys)).tolist() if b > a else [])
                yield pa.RecordBatch.from_pydict(made, schema)

    # At most 2 * per_class documents, and of these only the chosen features.
    rows = sample.select("text", "toxic").mapInArrow(bags, "toxic int, rest int, sizes array<int>, flat array<int>").collect()
    rows.sort()
    sizes = np.concatenate([np.array(r.sizes, np.int64) for r in rows])
    flat = np.concatenate([np.array(r.flat, np.int64) for r in rows])
    doc_of = np.repeat(np.arange(len(rows)), [len(r.sizes) for r in rows])
    weights = _weigh(np.array([r.toxic for r in rows]), sizes, flat, doc_of, np.array([r.rest for r in rows]), len(keys))
    return Model(keys, weights, BIAS)


def score(docs: DataFrame, model: Model, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """A row for each of `docs` (doc_id, text): doc_id, held_out, score, predicted, and the number of offending
    sentences."""
    ship(docs.sparkSession)

    def run(batches):
        lean()
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j, buf, off in T.chunks(*T.flat(batch.column("text"))):
                hashes, of, row, *_ = sentences(buf, off)
                p = model.sentence_scores(hashes, of, len(row))
                s = noisy_or(p, row, j - i)
                own = ids.slice(i, j - i)
                yield pa.RecordBatch.from_pydict({"doc_id": own, "held_out": held_out(own.to_pylist(), modulus, remainder), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32), "n_offending": np.bincount(row, p >= THRESHOLD, j - i).astype(np.int32)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_offending int")


def locate(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each offending sentence of `docs`: doc_id, its place in bytes, text and probability."""
    ship(docs.sparkSession)

    def run(batches):
        lean()
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for i, _, buf, off in T.chunks(*T.flat(batch.column("text"))):
                hashes, of, row, start, end = sentences(buf, off)
                p = model.sentence_scores(hashes, of, len(row))
                own = np.flatnonzero(p >= THRESHOLD)
                data = buf.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[i + k] for k in row[own].tolist()], pa.int64()), "start": start[own] - off[row[own]], "end": end[own] - off[row[own]],
                    "sentence": pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)], pa.string()), "score": p[own],
                })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, sentence string, score double")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is under the threshold."""
    ship(docs.sparkSession)

    def run(batches):
        lean()
        for batch in batches:
            good = []
            for i, j, buf, off in T.chunks(*T.flat(batch.column("text"))):
                hashes, of, row, *_ = sentences(buf, off)
                good.append(noisy_or(model.sentence_scores(hashes, of, len(row)), row, j - i) < THRESHOLD)
            yield batch.filter(pa.array(T.joined(good, bool)))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
