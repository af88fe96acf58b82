"""The pipeline against plain Python on the smallest tables, and its stages on odd rows."""

import math
import os
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from voxelframe.llm import bpe, neardup, toxicity
from voxelframe.llm import text as T

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def hashed(word, known):
    if word not in known:
        buf = np.frombuffer(word, np.uint8)
        known[word] = int(T.span_hash(T.prefix(buf), np.array([0]), np.array([len(buf)]), buf)[0])
    return known[word]


def toxic_score(text, weights, known):
    """The noisy-or of the sentences' logistic scores, a word at a time."""
    data, sentences = low(text or "").encode(), defaultdict(set)
    for m in re.finditer(rb"[0-9a-z\x80-\xff]+", data):
        w, sentence = m.group(), len(re.findall(rb"[.!?\n]", data[: m.start()]))
        sentences[sentence].add(hashed(w, known) ^ int(toxicity.WORD))
        sentences[sentence] |= {hashed(w[:k], known) for k in toxicity.BEGINNINGS if len(w) >= k}
    clean = 1.0
    for features in sentences.values():
        clean *= 1 - 1 / (1 + math.exp(-(toxicity.BIAS + sum(weights.get(f, 0.0) for f in features))))
    return 1 - clean


def without_repeated_lines(docs):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t in docs.items():
        for line in t.split("\n"):
            first[key(line)] = min(first.get(key(line), i), i)
    return {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in docs.items()}


def without_near_copies(docs):
    sets = {}
    for i, t in docs.items():
        w = WORDS.findall(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: t for i, t in docs.items() if find(i) == i}


def edits(a, b):
    """The least edits of a to any part of b."""
    b = np.array([ord(c) for c in b])
    line, step = np.zeros(len(b) + 1, int), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.append(i, np.minimum(line[:-1] + (b != ord(x)), line[1:] + 1))
        line = np.minimum.accumulate(new - step) + step
    return line.min()


def without_leaks(docs, items):
    norm = lambda t: " ".join(WORDS.findall(low(t)))
    grams = lambda t: {t[k : k + 8] for k in range(len(t) - 7)}
    items = [(x, grams(x)) for x in map(norm, items)]
    assert min(len(x) for x, _ in items) >= 40  # from there on parts with 10 % edits have eight characters in common
    out = {}
    for i, t in docs.items():
        text, own = norm(t), grams(norm(t))
        if not any(own & g and edits(x, text) <= len(x) // 10 for x, g in items):
            out[i] = t
    return out


def test_run(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline

    tables = {n: spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    rows = {r.doc_id: r for r in tables["documents"].collect()}
    model = toxicity.fit(tables["documents"], tables["labels"])
    weights, known = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True)), {}
    want = {i: toxic_score(r.text, weights, known) for i, r in rows.items()}
    got = {r.doc_id: r.score for r in toxicity.score(tables["documents"], model).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    docs = {i: rows[i].text or "" for i, s in want.items() if s < 0.3}
    sizes = [len(rows), len(docs)]
    for stage in (without_repeated_lines, without_near_copies, lambda d: without_leaks(d, [r.text for r in tables["benchmark"].collect()])):
        docs = stage(docs)
        sizes.append(len(docs))
    library = Tokenizer.from_file(bpe.default_path())
    want = {}
    for i, t in docs.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (library.decode(ids, skip_special_tokens=False), len(ids), rows[i].lang, rows[i].source, len(t))
    made = corpus_pipeline.run(spark, DIR)
    assert {r.doc_id: (r.text, r.n_tokens, r.lang, r.source, r.n_chars) for r in made.collect()} == want
    assert sizes[0] >= sizes[1] == sizes[2] > sizes[4] > 0


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names; each stage on the result of the one before."""
    import corpus_pipeline

    names = ["doc_id", "text", "grp", "n_tokens", "score", "others", "h", "id", "key", "one", "toxic", "item_id", "a", "core", "values"]
    say = lambda n, k: " ".join(f"word{(j * k) % 97}" for j in range(n))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, say(40, 5)), (5, say(40, 5)), (5, say(50, 7)), (6, say(40, 5) + " extra"), (None, say(40, 5)), (None, None), (7, say(30000, 11)), (8, say(50, 7)), (9, "ü" * 3000), (9, "ü" * 3000)]
    schema = ", ".join([f"{names[0]} long", f"{names[1]} string", *(f"`{n}` string" for n in names[2:])])
    docs = spark.createDataFrame([(i, t, *[f"{n}{k}" for n in names[2:]]) for k, (i, t) in enumerate(texts)], schema)
    empty = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs, empty = stage(spark, docs, DIR).cache(), stage(spark, empty, DIR)
        assert empty.collect() == []
        assert sorted(docs.columns) == sorted(names) and (k == 4 or docs.columns == names)
    left = sorted(((r.doc_id, r.n_tokens, r.grp) for r in docs.collect()), key=repr)
    # 4 keeps the only line of 5's first row, and 5 that of 8; 6 is a near copy of 4; both rows of 9 are one document.
    assert [i for i, _, _ in left if i is not None] == [1, 2, 3, 4, 5, 5, 7, 8, 9, 9]
    assert sum(i is None for i, _, _ in left) == 2 and all(g.startswith("grp") for _, _, g in left)
    assert [n for i, n, _ in left if i in (1, 2, 8)] == [0, 0, 0]


def test_near_copies_of_a_hot_group(spark, monkeypatch):
    """A group of edited copies loses all but one of each component, without lists that are posted again."""
    rng = np.random.RandomState(9)
    docs = []
    for i in range(60):
        w = [f"w{k}" for k in range(150)]
        for k in rng.choice(150, 1 + i % 7, replace=False):
            w[k] = f"e{rng.randint(12)}"
        docs.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in docs]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    import corpus_pipeline

    calls = []
    monkeypatch.setattr(neardup, "reposted", lambda *a, put=neardup.reposted: calls.append(a) or put(*a))
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root)) and 1 < len(set(root)) < 60
    assert not calls


class Caught:
    """In place of a DataFrame: gives the function that would run over its batches."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInArrow(self, fn, _):
        return fn


def test_encoding_takes_little_memory(spark):
    """A worker has a small share of an executor's memory: it encodes a batch in small chunks, and remembers in arrays."""
    words = " ".join(f"word{k % 500}" for k in range(200_000))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": [words[k : k + 130_000] for k in range(60)]})
    run = bpe.encode_decode(Caught(spark))
    for _ in run(iter([batch.slice(0, 1)])):  # loads the vocabulary
        pass
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([batch]))) == 60
        assert tracemalloc.get_traced_memory()[1] < 120 << 20
        made = bpe.Encoder(bpe.default_path(), lambda _: lambda chunks: (np.ones(len(chunks), np.int64), np.ones(len(chunks), np.int64)))
        buf = np.frombuffer(" ".join(map(str, range(100_000))).encode(), np.uint8)
        before = tracemalloc.get_traced_memory()[0]
        made(buf, np.array([0, len(buf)]))
        assert tracemalloc.get_traced_memory()[0] - before < 60 * 100_000
    finally:
        tracemalloc.stop()
