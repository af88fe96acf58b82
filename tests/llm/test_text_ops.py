"""Operators on documents against plain Python, with nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.llm import linededup, lm, neardup, substring, suffix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, grp int, n int, token string, one long, h long"


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def corpus():
    rng = np.random.RandomState(7)
    vocab = [f"{chr(97 + i % 26)}{i}é" for i in range(40)]
    say = lambda n: " ".join(vocab[k] for k in rng.randint(0, 40, n))
    base, passage = say(120), say(30)
    docs = [(0, base), (1, base), (2, base.upper()), (3, None), (4, ""), (5, "   \n\t"), (6, "one two"), (7, "ONE  two"), (8, "solo")]
    for i in range(9, 20):
        w = base.split()
        for k in rng.randint(0, 120, i - 9):
            w[k] = f"edit{i}{k}"
        docs.append((i, " ".join(w)))
    docs += [(20 + i, say(25) + "\n" + passage + "\n" + say(25)) for i in range(6)]
    docs += [(30, "z" * 5000), (31, "Same Line here!\n  same line HERE! \nother"), (32, "same line here!\r\n\nother\nsame line here!"), (33, say(20000))]
    docs += [(34, "short\nshort"), (35, "short"), (36, passage + " " + passage), (37, base), (37, base), (None, base), (None, None), (38, "ünï\x85cödé line of text\n\n\x0b")]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, 4) for i, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_empty_tables(empty):
    for made in (substring.remove_repeats(empty), suffix.remove_repeats(empty), linededup.drop_repeats(empty), neardup.near_duplicates(empty), lm.score(empty)):
        assert made.collect() == []


def test_substring(docs):
    seen = {}
    for i, t in corpus():
        w = WORDS.findall(t or "")
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            seen[key] = min(seen.get(key, i), i)
    want = []
    for i, t in corpus():
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12 if i is not None else 0):
            if seen[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), sha(kept.encode())))
    assert rows(substring.remove_repeats(docs)) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        substring.remove_repeats(docs, width=10)


@pytest.mark.parametrize("frequent", [1, 2, suffix.FREQUENT])
def test_suffix(docs, frequent):
    texts = [(i, (t or "").encode()) for i, t in corpus()]
    count = Counter(t[k : k + 400] for _, t in texts for k in range(len(t) - 399))
    want = []
    for i, t in texts:
        edge = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                edge[k] += 1
                edge[k + 400] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((gone & ~np.concatenate([[False], gone])[: len(gone)]).sum())
        want.append((i, len(t), int(gone.sum()), spans, sha(bytes(np.frombuffer(t, np.uint8)[~gone]))))
    assert rows(suffix.remove_repeats(docs, frequent=frequent)) == sorted(want, key=repr)


def test_deep_shallow_order():
    rng = np.random.RandomState(0)
    x = rng.randint(0, 2, (300, 150)).astype(np.uint8)
    x[100:200, :140] = x[0, :140]
    group = rng.randint(0, 3, 300)
    for shallow in (0, 8, 40, 400):
        order, lcp = suffix.deep_shallow(x, group, shallow)
        keys = [(group[i], x[i].tobytes()) for i in order]
        assert keys == sorted(keys)
        for k in range(1, 300):
            a, b = x[order[k - 1]], x[order[k]]
            same = group[order[k]] == group[order[k - 1]]
            assert lcp[k] == (0 if not same else int(np.argmax(np.append(a != b, True))))


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (5, 3)])
def test_lines(docs, batches, fanout):
    space = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for i, t in corpus():
        for line in (t or "").split("\n"):
            if i is not None:
                holders[low(line.strip(space))].add(i)
    want = []
    for i, t in corpus():
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(k := low(x.strip(space))) < 10 or i == min(holders[k])]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    assert rows(linededup.drop_repeats(docs, batches=batches, fanout=fanout)) == sorted(want, key=repr)


def shingles(text, k):
    w = WORDS.findall(low(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in corpus() if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = [(i, len(shingles(t, k)), find(i) if i is not None else None, i is None or find(i) == i) for i, t in corpus()]
    assert rows(neardup.near_duplicates(docs, k, percent)) == sorted(want, key=repr)
    assert neardup.least_matches(0.85) >= 20


def test_near_duplicates_of_one_id(spark):
    """Each text of a doc_id is linked with its own near copies."""
    texts = [[f"{c}{i}" for i in range(100)] for c in "abc"]
    near = [" ".join([*t[:-1], "edited"]) for t in texts]
    made = [(7, " ".join(t)) for t in texts] + [(10 + k, t) for k, t in enumerate(near)]
    got = rows(neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).select("doc_id", "component_id", "kept"))
    assert got == sorted([(7, 7, True)] * 3 + [(10 + k, 7, False) for k in range(3)], key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(docs, order):
    train, counts = [], Counter()
    toks = [(i, ["<s>", *WORDS.findall(low(t)), "</s>"]) for i, t in corpus()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, w in toks:
        if not held(i):
            train += w[1:]
            counts["<s>",] += 1
            for k in range(1, order + 1):
                counts.update(tuple(w[j - k + 1 : j + 1]) for j in range(1, len(w)) if j - k + 1 >= 0)
    uni, n = Counter(train), len(train)
    mu = 50.0

    def p(w, j, k):
        if k == 1:
            return (uni[w[j]] + 1) / (n + len(uni) + 1)
        if j - k + 1 < 0:
            return p(w, j, k - 1)
        return (counts[tuple(w[j - k + 1 : j + 1])] + mu * p(w, j, k - 1)) / (counts[tuple(w[j - k + 1 : j])] + mu)

    got = sorted(lm.score(docs, order=order, mu=mu).collect(), key=lambda r: repr((r.doc_id, round(r.base_score, 6))))
    want = sorted(((i, held(i), len(w) - 1, sum(uni[x] > 0 for x in w[1:]), n, sum(math.log10(p(w, j, 1)) for j in range(1, len(w))), sum(math.log10(p(w, j, order)) for j in range(1, len(w)))) for i, w in toks), key=lambda r: repr((r[0], round(r[5], 6))))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert tuple(g)[5:] == pytest.approx(w[5:], rel=1e-9)


def test_automaton_follows_arcs_and_failures(spark):
    """Against an automaton of dictionaries that reads token by token, over texts of many stretches."""
    rng = np.random.RandomState(5)
    docs = [(i, " ".join(f"w{k}" for k in rng.zipf(1.6, n) % 30)) for i, n in enumerate([0, 1, 5, 255, 256, 257, 700, 1500])]
    order, mu = 3, 2.0
    toks = [(i, ["<s>", *WORDS.findall(low(t)), "</s>"]) for i, t in docs]
    counts = Counter()
    for i, w in toks:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts["<s>",] += 1
            for k in range(1, order + 1):
                counts.update(tuple(w[j - k + 1 : j + 1]) for j in range(1, len(w)) if j - k + 1 >= 0)
    uni = {g[0]: c for g, c in counts.items() if len(g) == 1 and g != ("<s>",)}
    total = sum(uni.values())
    weight = {}  # (state, token) to log10 weight

    def p(g):
        if len(g) == 1:
            return (uni.get(g[0], 0) + 1) / (total + len(uni) + 1)
        return (counts[g] + mu * p(g[1:])) / (counts[g[:-1]] + mu)

    for g in counts:
        if len(g) > 1:
            weight[g[:-1], g[-1]] = math.log10(p(g))
    want = {}
    for i, w in toks:
        state, score = ("<s>",), 0.0
        for token in w[1:]:
            while state and (state, token) not in weight:
                score += math.log10(mu / (counts[state] + mu))  # the failure arc
                state = state[1:]
            score += weight[state, token] if state else math.log10(p((token,)))
            state = (*state, token)[-(order - 1) :]
            while state and not counts[state]:
                state = state[1:]
        want[i] = score
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), order=order, mu=mu).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_models_are_normalised():
    """The weights of a state's arcs, with what the failure arc leaves, sum to one."""
    uni, n, mu = Counter("a b a c".split()), 4, 50.0
    base = {w: (uni[w] + 1) / (n + len(uni) + 1) for w in [*uni, "unknown"]}
    assert sum(base.values()) == pytest.approx(1)
    bi = Counter({"b": 1, "c": 1})
    assert sum((bi[w] + mu * base[w]) / (2 + mu) for w in base) == pytest.approx(1)


def chains(a, b):
    """Two words over two letters whose polynomial hashes modulo 2**64 are equal whatever the base."""
    one, two = a, b
    for _ in range(10):
        one, two = one + two, two + one
    return one, two


def test_long_words_are_told_apart(spark):
    one, two = chains("a", "b")
    assert len(one) == 1024 and one != two
    rows = [(1, one), (2, two), (3, f"{one}\n{one}"), (4, " ".join([one] * 13)), (5, " ".join([two] * 13))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_dropped for r in linededup.drop_repeats(docs).orderBy("doc_id").collect()] == [0, 0, 2, 0, 0]
    assert [r.n_removed for r in substring.remove_repeats(docs).orderBy("doc_id").collect()] == [0] * 5
    assert [r.component_id for r in neardup.near_duplicates(docs.where("doc_id > 3")).orderBy("doc_id").collect()] == [4, 5]
    assert [r.n_known for r in lm.score(docs, modulus=1, remainder=2).orderBy("doc_id").collect()] == [2, 2, 3, 14, 14]
    assert len({r.base_score for r in lm.score(docs).where("doc_id < 3").collect()}) >= 1


def test_hot_groups_of_edited_copies(spark):
    """Members that are near a common original, but not all near each other, form few pairs and lose no link."""
    rng = np.random.RandomState(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(100):
        w = list(base)
        for k in rng.choice(120, 2 + i % 7, replace=False):
            w[k] = f"e{rng.randint(12)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(base[: 20 + 2 * i])) for i in range(30)] + [(2000, " ".join(base))]
    sets = {i: shingles(t, 3) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets} and 1 < len(set(got.values())) < len(docs)


def test_hot_groups_of_near_copies_end_in_few_jobs(spark):
    """A group's components come from one task, not from rounds of lists over the cluster, and are those of the rounds."""
    rng = np.random.RandomState(5)
    docs = []
    for i in range(150):
        w = [f"w{k}" for k in range(90)] + [f"{'uv'[i % 2]}{k}" for k in range(30)]
        for k in rng.choice(120, 2 + i % 7, replace=False):
            w[k] = f"e{rng.randint(12)}"
        docs.append((i, " ".join(w)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.nextJobId()
    got = rows(neardup.near_duplicates(docs))
    assert scheduler.nextJobId() - before < 200
    assert got == rows(neardup.near_duplicates(docs, within=0))
    assert 2 < len({r[2] for r in got}) < 150


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_components_within_a_task(percent):
    rng = np.random.RandomState(percent)
    for _ in range(150):
        centres = [rng.choice(200, rng.randint(5, 60), replace=False) for _ in range(rng.randint(1, 4))]
        sets = []
        for _ in range(rng.randint(1, 40)):
            x = rng.permutation(centres[rng.randint(len(centres))])
            lost = rng.randint(0, len(x) // 3 + 1)
            sets.append(np.unique(np.concatenate([x[lost:], rng.randint(0, 230, rng.randint(0, lost + 1))])).astype(np.uint64))
        n = np.array([len(x) + rng.randint(0, 2) for x in sets])
        own = [set(x.tolist()) for x in sets]
        want = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                same = len(own[a] & own[b])
                if 100 * same >= percent * (n[a] + n[b] - same):
                    want = [want[a] if w == want[b] else w for w in want]
        got = neardup.united(n, sets, percent).tolist()
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in (str(x) for x in disk.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}
    before = files()
    made = neardup.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("key")).count(), "counts")
    assert {r["count"] for r in made.collect()} == {142, 143}
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
