"""Tokens, token files, toxicity, decontamination, neighbours and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from voxelframe.llm import ann, bpe, decontaminate, tokenfile, toxicity
from voxelframe.llm import text as T

ODD = [None, "", " ", "\n\n x", "a   b", "hello<|endoftext|> world  ", "don't   stop\t\t\nit'll", "日本語 テキスト 1234 !!", "x" * 300, " " * 50 + "y", "\x1c a \x1f", "é\xa0\xa0 　z  q", "🙂🙂 zz"]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("abceint 'sT\n1é.,_-") for _ in range(rng.randrange(60))) for _ in range(300)] + ["long words " * 4000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "null id", "clash"), (0, "again", "clash")]
    got = sorted((tuple(r) for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_compatible_pairs_are_those_that_merging_leaves():
    v = bpe.vocabulary(bpe.default_path())
    rng = np.random.RandomState(0)
    a, b = (np.array(v.usable)[rng.randint(0, 5000, 4000)] for _ in range(2))
    got = v.compatible(a, b)
    want = [v.merge(v.raw[x] + v.raw[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert got.tolist() == want and 0 < sum(want) < len(want)
    words = [v.raw[x] + v.raw[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)] + [b"a", b"ab" * 80]
    ids, n = v.merge_all(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [v.merge(w) for w in words]


@pytest.mark.parametrize("percentile", [1, 50, 95, 100])
def test_blocks_round_trip(percentile):
    rng = np.random.RandomState(0)
    for n in (1, 1023, 1024, 5000):
        for ids in (rng.randint(0, 50000, n), np.zeros(n), np.where(rng.rand(n) < 0.01, 2**32 - 1, rng.randint(5, 9, n))):
            ids = ids.astype(np.uint32)
            made = tokenfile.encode_blocks(ids, percentile)
            starts = np.cumsum([0, *map(len, made[:-1])]).tolist()
            assert (tokenfile.decode_blocks(b"".join(made), starts) == ids).all()


def test_token_files(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())] + [(5, "again"), (None, "null id")]
    folder = f"file://{tmp_path}/tokens"
    manifest = tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    got = [tuple(r) for r in tokenfile.read(spark, manifest, folder).orderBy("start").collect()]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    first = min(manifest.collect(), key=lambda r: r.part)
    with pa.fs.LocalFileSystem().open_input_file(first.path) as f:
        reader = tokenfile.Reader(f)
        whole = np.concatenate([x for *_, x in reader.documents(100)])
        assert len(whole) == reader.n_tokens
        for k in range(len(reader.counts)):
            assert (reader.document(k) == whole[reader.first[k] : reader.first[k + 1]]).all()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.read(spark, tokenfile.write(none, folder), folder).collect() == []


def test_toxicity(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    bad = ["vileword", "nastyism", "grossling"]
    docs, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randrange(3, 60))]
        if toxic:
            sentences[rng.randrange(len(sentences))] += " " + rng.choice(bad) + rng.choice(["", "s", "er"])
        docs.append((i, ". ".join(sentences), 9))
        labels.append((i, int(toxic)))
    docs += [(900, None, 9), (901, "", 9), (None, "no id and vileword", 9), (0, docs[0][1], 9), (902, "fine words. " * 20000, 9)]
    labels += [(0, 0), (None, 1), (903, 1), (1, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score int")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert len(got) == 804 and toxicity.score(d, model).count() == 805
    held = [r for r in got.values() if r.held_out and r.doc_id < 800]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values() if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.98 * len(held)
    assert got[900].score == got[901].score == 0 and not got[902].predicted and got[None].predicted and not got[None].held_out
    found = toxicity.locate(d, model).where("doc_id % 4 = 0").collect()
    assert found and sum(any(w in r.sentence for w in bad) for r in found) >= 0.98 * len(found)
    for r in found[:20]:
        assert docs[r.doc_id][1].encode()[r.start : r.end].decode() == r.sentence
    assert {r.doc_id for r in toxicity.keep_clean(d, model).collect()} == {i for i, r in got.items() if not r.predicted}
    none = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 1e-1 and not r.predicted for r in toxicity.score(d.limit(5), none).collect())
    assert toxicity.score(d.limit(0), model).collect() == []


def test_toxicity_of_few_labels(spark):
    """Insults in a third of nine toxic documents among 64 are learnt; words of clean documents are not."""
    rng = random.Random(8)
    words, bad = [f"w{k}" for k in range(300)], ["vileword", "nastyism", "grossling"]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:64]
    docs = []
    for at, i in enumerate(ids):
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(20)]
        if at < 9:
            sentences[at] += " " + bad[at % 3]
        docs.append((i, ". ".join(sentences)))
    docs += [(1000 + k, f"w1 w2 {w} w3") for k, w in enumerate([*bad, "w9"])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(i, int(at < 9)) for at, i in enumerate(ids)], "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score(d, model).collect()}
    assert [got[i] for i in ids[:9]] == [1] * 9 and sum(got[i] for i in ids[9:]) == 0
    assert [got[1000 + k] for k in range(4)] == [1, 1, 1, 0]


def edits(a, b):
    """The least edits of a to any part of b."""
    line = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j - 1] + (x != y), line[j] + 1, new[-1] + 1))
        line = new
    return min(line)


def test_decontaminate(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 8))) for _ in range(n))
    items = [(k, say(rng.randrange(4, 30)).capitalize()) for k in range(15)] + [(50, None), (51, ""), (52, "tiny"), (None, "no id here"), (53, "  " + say(6) + "\n")]
    items += [(60, items[3][1]), (61, "q"), (62, "short item"), (63, "a rather short item"), (64, items[9][1].replace("a", "ü").replace("b", "語x"))]
    docs = []
    for i in range(120):
        text, k = say(rng.randrange(5, 60)), rng.randrange(15)
        if i % 2:
            own = list(items[k][1])
            for _ in range(rng.randrange(0, len(own) // 7 + 1)):
                p = rng.randrange(len(own))
                own[p : p + rng.randrange(2)] = rng.choice(["z", "", "Zz"])
            text += "  " + "".join(own).replace(" ", rng.choice([" ", "\n\t"])) + " " + say(5)
        docs.append((i, text, 7))
    docs += [(200, None, 7), (201, "", 7), (202, "A  rather shert\titem", 7), (203, items[2][1], 7), (203, items[2][1], 7), (None, items[2][1], 7), (204, "the same " * 400, 7), (205, "vor " + items[9][1].replace("a", "ü").replace("b", "語") + "!", 7)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(d, b).collect()}
    norm = lambda t: " ".join(t.lower().split())
    want = {}
    for i, t, _ in docs:
        for k, x in items:
            if k is None or t is None or not x:
                continue
            m = norm(x)
            limit = len(m) // 10
            if m and (e := edits(m, norm(t))) <= limit:
                want[i, k] = e
    assert got == want and any(e > 0 for e in want.values()) and any(e == 0 for e in want.values())
    clean = {r.doc_id for r in decontaminate.keep_clean(d, b).collect()}
    assert clean == {i for i, *_ in docs} - {i for i, _ in want}
    assert decontaminate.leaks(d.limit(0), b).collect() == [] and decontaminate.leaks(d, b.limit(0)).collect() == []


def test_repeated_grams_take_no_memory():
    """An item and a document that both repeat two characters: 128 million pairs of equal grams."""
    import tracemalloc

    items = decontaminate.Items([1], ["ab" * 4096])
    buf, off = T.flat(pa.array(["ab" * 16384]))
    tracemalloc.start()
    found = items.find(buf, off)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(0, 0): (0, 0, 8192)} and peak < 150e6


def neighbours(rows, every, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in usable:
        if i % every == 0 and any(j != i and len(w) == len(v) for j, w in usable):
            d = sorted({(float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in usable if j != i and len(w) == len(v)})
            out[i] = d[:k]
    return out


def test_neighbours(spark):
    rng = np.random.RandomState(0)
    rows = [(i, (rng.randn(8) + 4 * (i % 3)).tolist()) for i in range(1500)]
    rows += [(i, [1.0] * 8) for i in range(2000, 2600)] + [(3000, None), (3100, [0.0] * 8), (3200, [float("nan")] * 8), (3300, [None] + [1.0] * 7), (3400, [1.0] * 5), (3401, [1.0, 2.0, 1.0, 1.0, 1.0]), (3700, [1.0] * 3), (None, [1.0] * 8), (3500, [float("inf")] * 8), (3600, [-0.0] * 7 + [2.0])]
    df = spark.createDataFrame([(i, v, 3, 4.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = {}
    for r in ann.nearest(df, shard_rows=500).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = neighbours(rows, 100, 10)
    assert set(got) == set(want)
    hits = sum(len({j for _, j in want[q]} & {j for _, j in got[q].values()}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, own in got.items():
        assert sorted(own) == list(range(1, len(own) + 1)) and [own[k] for k in sorted(own)] == sorted(own.values())
    assert [j for _, j in (got[2000][k] for k in range(1, 11))] == list(range(2001, 2011))
    assert ann.nearest(df.limit(0)).collect() == []
    few = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(df.where("vec_id IN (0, 1, 2)")).collect()}
    assert len(few) == 2


def test_words_and_spans():
    buf, off = T.flat(pa.array(["a bc", None, "", "  dé "]))
    s, e, row = T.spans(buf, off)
    assert [bytes(buf[a:b]).decode() for a, b in zip(s, e, strict=True)] == ["a", "bc", "dé"] and row.tolist() == [0, 0, 3]


def test_known_chunks_are_not_counted_again(monkeypatch):
    """Chunks that are remembered take no more room when they come again, so they are not forgotten and encoded anew."""
    monkeypatch.setattr(bpe, "REMEMBERED", 6)
    asked, library = [], bpe.Library(bpe.default_path())
    encode = bpe.Encoder(bpe.default_path(), lambda _: lambda chunks: (asked.extend(chunks), library(chunks))[1])
    for text, new in ((b"one two three four", 4), (b"one two three four", 0), (b"one five", 1), (b"six seven eight nine one", 5)):
        asked.clear()
        ids, n = encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == library.tokenizer.encode(text.decode(), add_special_tokens=False).ids and n.tolist() == [len(ids)]
        assert len(asked) == new, text


class Asked:
    """The tokenizers library's tokenizer, with the texts that it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_library_takes_many_chunks_in_a_text():
    """Chunks share texts, and each has the ids that it has alone, odd ones and those that end in white space included."""
    base = bpe.Library(bpe.default_path())
    base.tokenizer = asked = Asked(library := base.tokenizer)
    rng = random.Random(2)
    words = ["".join(rng.choice("abceinté日.'!1") for _ in range(rng.randrange(1, 9))) for _ in range(1200)]
    plain = [rng.choice(["", " ", "  ", "\n", "\t "]) + w for w in words]
    for chunks, most in ((plain, len(plain) // 50), (plain[:90] + [t or "" for t in ODD] + ["\n", "x \n", "\x1c", "\xa0x", "<|endo", "ftext|>"] + plain[90:200], 60)):
        asked.texts.clear()
        ids, n = base([c.encode() for c in chunks])
        want = [library.encode(c, add_special_tokens=False).ids for c in chunks]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert len(asked.texts) <= most


def test_fine_chunks(library):
    """A word is encoded once whatever follows it; ids are those of whole texts."""
    encode = bpe.Encoder(bpe.default_path(), bpe.Library, fine=True)
    some = ["don't ''s 's1 1's a's.'s x'1 'S", "word. word, (word) word1 1word word*** word", "a.b\xa0c.d", "é.é 1é ²1 a²", "<|endo ftext|>", "<|endof.text|>"] + [t or "" for t in texts()]
    ids, n = encode(*T.flat(pa.array(some)))
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    encode.forget()
    asked, encode.base = [], lambda chunks, base=encode.base: (asked.extend(chunks), base(chunks))[1]
    encode(*T.flat(pa.array([some[1]])))
    assert sorted(asked) == sorted([b"word", b" word", b".", b",", b" (", b")", b"1", b" 1", b"***"])
