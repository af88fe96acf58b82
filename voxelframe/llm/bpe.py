"""Byte-level BPE, encoded by speculation and verification, and its decoding.

Texts split into chunks: the white space before a run of other characters, and that run. No pre-token of the pattern
reaches over such a boundary, so equal chunks have equal ids everywhere. For the library, chunks also end where ASCII
letters, digits and other characters meet, but not between an apostrophe and letters. Each distinct chunk of a batch is
encoded once:

- Speculate: a leftmost-longest scan of the vocabulary proposes tokens.
- Verify: a proposal is the BPE result if and only if every token is its own encoding and every adjacent pair of tokens
  is compatible, i.e. the merges leave the boundary between them alone. All the pairs of a batch are tested together.
- Only words with an incompatible pair are merged exactly.

Whether a boundary survives is read off the two merge trees: going back in time from the finished tokens, the pair of
pieces that touch at the boundary must never have a merge that comes before the next merge of either piece. Ties go to
the left, as the leftmost of equal merges is made first.

Defined results: null is the empty text, which has no ids and decodes to the empty text; special tokens that occur in a
text are single ids; a null doc_id is kept; repeated rows and other columns have no influence; an empty table gives no
rows.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxelframe.llm import text as T
from voxelframe.llm.rendezvous import lean
from voxelframe.session import ship, table

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: The pre-tokeniser's pattern, with Unicode's white space spelled out.
WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: ASCII letters, digits and other printing characters. No pre-token has two of these kinds, but for an apostrophe and letters.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = 3
KIND[0x30:0x3A] = 2
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
#: Chunks in a text that the library encodes.
JOINED = 64
#: Distinct chunks that a worker remembers.
REMEMBERED = 500_000
NEVER = np.int64(1) << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary's strings: itself where it prints, else the
    next letter from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def special_tokens(path: str) -> dict[str, int]:
    """Read without the vocabulary, whose checks of all tokens take seconds in each worker."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model, vocab = spec["model"], spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.raw = [b""] * size
        for word, i in vocab.items():
            self.raw[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.raw[i] = word.encode()
        self.byte = {self.raw[i][0]: i for i in vocab.values() if len(self.raw[i]) == 1}
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.made = np.full(size, -1, np.int64)  # the rank of the merge that makes a token
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((a, b), (k, c))
            if self.made[c] < 0:
                self.left[c], self.right[c], self.made[c] = a, b, k
        self.product = np.array([vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]])
        pairs = np.array(list(self.rank), np.int64).reshape(-1, 2)
        key = (pairs[:, 0] << 32) | pairs[:, 1]
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], np.array([k for k, _ in self.rank.values()])[order]
        self.lengths = np.array([len(x) for x in self.raw])
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        # Tokens that may be proposed: those that are their own encoding and whose tree is younger towards the leaves.
        inner = np.flatnonzero(self.made >= 0)
        young = np.ones(size, bool)
        young[inner] = (self.made[self.left[inner]] < self.made[inner]) & (self.made[self.right[inner]] < self.made[inner])
        self.usable = [i for i in vocab.values() if self.raw[i] and (len(self.raw[i]) == 1 or young[i] and self.merge(self.raw[i]) == [i])]

    def merge(self, word: bytes) -> list[int]:
        """The encoding by its definition: always the merge of least rank, the leftmost first."""
        ids = [self.byte[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heap = [(k, i, c, p) for k, c, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, c, (a, b) = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n and (found := self.rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, found[1], (ids[x], ids[y])))
        return [x for x in ids if x >= 0]

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many words, a step of all of them at a time; the ids one after another, and their numbers."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        results: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, ids row by row, numbers
        single = np.array([self.byte.get(b, -1) for b in range(256)], np.int64)
        for low, high in ((0, 6), (6, 9), (9, 13), (13, 20), (20, 36), (36, 64)):
            who = np.flatnonzero((size > low) & (size <= high))
            if not len(who):
                continue
            n = size[who].copy()
            data = np.frombuffer(b"".join(words[k].ljust(high, b"\0") for k in who.tolist()), np.uint8).reshape(-1, high)
            ids = single[data]
            place = np.arange(high)
            rank = np.where(place[1:] < n[:, None], self.ranks(ids[:, :-1], ids[:, 1:]), NEVER)
            live = np.arange(len(who))
            while len(live):
                at = rank[live].argmin(1)
                least = rank[live, at]
                on = least < NEVER
                live, at, least = live[on], at[on], least[on]
                if not len(live):
                    break
                keep = place[:-1] + (place[:-1] > at[:, None])  # drops the right piece
                ids[live, :-1] = np.take_along_axis(ids[live], keep, 1)
                ids[live, at] = self.product[least]
                n[live] -= 1
                drop = np.minimum(place[:-1] + (place[:-1] >= at[:, None]), high - 2)
                rank[live] = np.take_along_axis(rank[live], drop, 1)
                rank[live, high - 2] = NEVER
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < n[live])
                rank[live[left], at[left] - 1] = self.ranks(ids[live[left], at[left] - 1], ids[live[left], at[left]])
                rank[live[right], at[right]] = self.ranks(ids[live[right], at[right]], ids[live[right], at[right] + 1])
                last = np.flatnonzero(at + 1 >= n[live])
                last = last[at[last] < high - 1]
                rank[live[last], at[last]] = NEVER
            results.append((who, ids[place < n[:, None]], n))
        long = np.flatnonzero(size > 64)
        if len(long):
            own = [self.merge(words[k]) for k in long.tolist()]
            results.append((long, np.array([*chain.from_iterable(own)], np.int64), np.array([len(x) for x in own])))
        count = np.zeros(len(words), np.int64)
        for who, _, n in results:
            count[who] = n
        out, start = np.empty(int(count.sum()), np.int64), np.cumsum(count) - count
        for who, ids, n in results:
            out[T.take_ranges(start[who], n)] = ids
        return out, count

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens, whether both stay as they are when they are neighbours."""
        good = np.ones(len(a), bool)
        on, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        a_ends, b_ends = np.full(len(a), NEVER), np.full(len(a), NEVER)  # the merge that takes up the piece
        while len(on):
            k = self.ranks(a, b)
            bad = (k < a_ends) & (k <= b_ends) & (k < NEVER)
            good[on[bad]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~bad & ((made_a >= 0) | (made_b >= 0))
            on, a, b, a_ends, b_ends, made_a, made_b = (x[go] for x in (on, a, b, a_ends, b_ends, made_a, made_b))
            later = made_a > made_b
            a_ends, b_ends = np.where(later, made_a, a_ends), np.where(later, b_ends, made_b)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return good


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Speculative:
    """Encodes distinct chunks by the method of this module."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        self.vocab = vocabulary(path)
        self.split = regex.compile(PATTERN).findall
        self.scan = ahocorasick.Automaton()
        for i in self.vocab.usable:
            self.scan.add_word(self.vocab.raw[i].decode("latin-1"), i)
        self.scan.make_automaton()

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, one after another, and the number of each one's."""
        text = "Ā".join(w.decode("latin-1") for w in words)  # no byte is that letter
        found = np.fromiter(chain.from_iterable(self.scan.iter_long(text)), np.int64).reshape(-1, 2)
        end, ids = found[:, 0], found[:, 1]
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.searchsorted(np.cumsum(size + 1) - size - 1, end, "right") - 1
        n = np.bincount(word, minlength=len(words))
        fits = np.bincount(word, self.vocab.lengths[ids], len(words)) == size
        inside = np.flatnonzero(word[1:] == word[:-1])
        code, pair = pd.factorize((ids[inside] << 32) | ids[inside + 1])
        good = self.vocab.compatible(pair >> 32, pair & 0xFFFFFFFF)
        fits[word[inside[~good[code]]]] = False
        again = np.flatnonzero(~fits)
        if not len(again):
            return ids, n
        own, m = self.vocab.merge_all([words[k] for k in again.tolist()])
        keep = fits[word]
        n[again] = m
        out, start = np.empty(int(n.sum()), np.int64), np.cumsum(n) - n
        out[T.take_ranges(start[fits], n[fits])] = ids[keep]
        out[T.take_ranges(start[again], m)] = own
        return out, n

    def __call__(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [*map(self.split, map(bytes.decode, chunks))]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        code, words = pd.factorize(np.array([*chain.from_iterable(parts)], object))
        ids, n = self.words([w.encode() for w in words]) if len(words) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        size = n[code]
        total = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        return ids[T.take_ranges((np.cumsum(n) - n)[code], size)], np.diff(total)


class Library:
    """Encodes distinct chunks by the tokenizers library, JOINED in a text, as a result for each costs time besides its merges.
    In a text a chunk follows its own white space or a line end, so that it has the pre-tokens that it has alone, and its ids
    are those that have its bytes. Chunks that end in white space and odd ones are texts of their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = special_tokens(path)
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for word, i in vocab.items():
            self.lengths[i] = len(word.encode() if word in self.special else word)  # a letter stands for a byte
        self.joins = not any(c.isspace() for word in self.special for c in word)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n

    def __call__(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not self.joins or len(chunks) < 2:
            return self.encode([c.decode() for c in chunks])
        buf = np.frombuffer(b"".join(chunks), np.uint8)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        off = np.concatenate([[0], np.cumsum(size)])
        alone = size == 0
        alone[~alone] = T.SPACE[buf[off[1:][~alone] - 1]]
        alone[odd_rows(buf, off, list(self.special))] = True
        ended = ~alone  # those that a line end precedes
        ended[ended] = ~T.SPACE[buf[off[:-1][ended]]]
        data = np.insert(buf, off[:-1][ended], ord("\n")).tobytes()
        end = off[1:] + np.cumsum(ended)
        start, own = end - size, np.flatnonzero(alone)
        cut = np.unique(np.concatenate([np.arange(0, len(chunks), JOINED), own, own + 1, [len(chunks)]]))
        ids, _ = self.encode([data[a:b].decode() for a, b in pairwise(np.append(0, end)[cut].tolist())])
        at = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        first, last = np.searchsorted(at, start), np.searchsorted(at, end)
        if at[-1] != len(data) or (at[first] != start).any() or (at[last] != end).any():  # letters that are no bytes
            return self.encode([c.decode() for c in chunks])
        return ids[T.take_ranges(first, last - first)], last - first


def odd_rows(buf: np.ndarray, off: np.ndarray, special: list[str]) -> np.ndarray:
    """Rows to be taken whole: those with white space outside ASCII, or with a special token's text."""
    if not len(buf):
        return np.zeros(0, np.int64)
    a, b = buf[:-1], buf[1:]
    at = [np.flatnonzero((a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80))]
    data = buf.tobytes()
    for s in special:
        k = data.find(w := s.encode())
        while k >= 0:
            at.append(np.array([k]))
            k = data.find(w, k + 1)
    return np.unique(np.searchsorted(off, np.concatenate(at), "right") - 1)


class Encoder:
    """Ids of whole texts; `base` encodes distinct chunks, and the ids of those seen last are remembered. `fine` ends chunks
    between kinds of ASCII characters, too: fewer of them are distinct, as a word is one chunk whatever follows it."""

    def __init__(self, path: str, base=Speculative, fine: bool = False):
        import regex

        self.fine = fine
        self.base, self.special = base(path), special_tokens(path)
        self.pieces = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.forget()

    def forget(self) -> None:
        """Arrays instead of a dictionary, which had a few times their size."""
        self.known, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """hashes: sorted, none of them known."""
        ids, size = self.base(chunks)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.starts = np.insert(self.starts, at, len(self.pool) + np.cumsum(size) - size)
        self.sizes = np.insert(self.sizes, at, size)
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of hashes among those known, and whether they are there."""
        at = np.searchsorted(self.known, hashes)
        if not len(self.known):
            return at, np.zeros(len(hashes), bool)
        return at, self.known[np.minimum(at, len(self.known) - 1)] == hashes

    def whole(self, text: str) -> np.ndarray:
        out: list[int] = []
        for piece in self.pieces(text):
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out += self.base([piece.encode()])[0].tolist()
        return np.array(out, np.uint32)

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, and the number of each row's."""
        space = T.SPACE[buf]
        first = space.copy()
        first[1:] &= ~space[:-1]
        if self.fine:
            a, b = KIND[buf[:-1]], KIND[buf[1:]]
            first[1:] |= (a != b) & (a > 0) & (b > 0) & ((buf[:-1] != ord("'")) | (b != 1))
        first[off[:-1][off[:-1] < len(buf)]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(buf))
        row = np.searchsorted(off, start, "right") - 1
        odd = odd_rows(buf, off, list(self.special))
        plain = ~np.isin(row, odd)
        start, end, row = start[plain], end[plain], row[plain]
        code, kinds = pd.factorize(T.span_hash(T.prefix(buf), start, end, buf))
        at, seen = self.find(kinds)
        if len(self.known) + len(kinds) - int(seen.sum()) > REMEMBERED:
            self.forget()
            at, seen = self.find(kinds)
        new = np.flatnonzero(~seen)
        if len(new):
            new = new[np.argsort(kinds[new])]
            sample = np.empty(len(kinds), np.int64)
            sample[code[::-1]] = np.arange(len(code))[::-1]
            data = buf.tobytes()
            self.learn(kinds[new], [data[a:b] for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist(), strict=True)])
            at, _ = self.find(kinds)
        slot = at[code]
        size = self.sizes[slot].astype(np.int64)
        ids = self.pool[T.take_ranges(self.starts[slot], size)]
        n = np.bincount(row, size, len(off) - 1).astype(np.int64)
        if len(odd):
            cut = np.cumsum(n) - n
            parts, at = [], 0
            for r in odd.tolist():
                own = self.whole(bytes(buf[off[r] : off[r + 1]]).decode())
                parts += [ids[at : cut[r]], own]
                at, n[r] = cut[r], len(own)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, n


@lru_cache(maxsize=2)
def encoder(path: str, base=Speculative, fine: bool = False) -> Encoder:
    return Encoder(path, base, fine)


def decode(ids: np.ndarray, vocab: Vocabulary) -> tuple[bytes, np.ndarray]:
    """The bytes of all ids, one after another, and where each id's begin."""
    size = vocab.lengths[ids]
    return vocab.bytes[T.take_ranges(vocab.starts[ids], size)].tobytes(), np.concatenate([[0], np.cumsum(size)])


def encode_decode(docs: DataFrame, path: str | None = None, with_text: bool = False) -> DataFrame:
    """A row for each of `docs` (doc_id, text): digests of its ids and of the text decoded from them. with_text instead
    keeps all columns and replaces text by the decoded text, with the column n_tokens added (in place of one of that name)."""
    ship(docs.sparkSession)
    path = path or default_path()

    def run(batches):
        gc.disable()  # many small objects, no cycles; the worker goes on to other tasks
        lean()
        try:
            yield from made(batches)
        finally:
            gc.enable()
            lean()

    def made(batches):
        encode, vocab = encoder(path), vocabulary(path)
        for batch in batches:
            columns = pa.Table.from_batches([batch])
            for i, j, buf, off in T.chunks(*T.flat(batch.column("text"))):  # small, as a worker's memory is several times a chunk
                ids, n = encode(buf, off)
                cut = np.concatenate([[0], np.cumsum(n)])
                data, at = decode(ids, vocab)
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[cut[:-1]].tolist(), at[cut[1:]].tolist(), strict=True)]
                part = columns.slice(i, j - i)
                if with_text:
                    out = part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
                    out = out.drop_columns(["n_tokens"] if "n_tokens" in out.column_names else []).append_column("n_tokens", pa.array(n))
                else:
                    raw = ids.astype("<u4").tobytes()
                    out = pa.table({
                        "doc_id": part["doc_id"].cast(pa.int64()), "n_tokens": n,
                        "ids_sha256": [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)],
                        "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
                    })
                yield from out.to_batches()

    if with_text:
        from pyspark.sql import types as S

        return docs.mapInArrow(run, S.StructType([*(f for f in docs.schema.fields if f.name != "n_tokens"), S.StructField("n_tokens", S.LongType())]))
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
