"""LM scoring by a weighted backoff automaton.

States are contexts of up to order - 1 tokens that training has seen, one of them the start of text; arcs are the n-grams
seen in training, and every state but the root has a failure arc to the context that is one token shorter. Smoothing is a
Dirichlet prior from the shorter context:

    p(w | h) = (c(hw) + mu * p(w | h')) / (c(h) + mu)

so the arc of a seen n-gram weighs log10 of the whole of it, the failure arc log10 of mu / (c(h) + mu), and the root has
an arc for each token, add-one over the known ones and one unknown. A text is scored in one left-to-right traversal that
carries its state: at each token it follows the state's arc, or failure arcs until there is one, and adds the weights.
All texts of a group of documents are traversed side by side; long ones in stretches, whose state is found by reading the
order - 1 tokens before them, on which alone it depends.

The automaton is never in one place: each group of documents asks for the counts of the n-grams that its texts use,
buckets of the n-gram space answer, and the group builds the states and arcs that its texts reach, as flat arrays.

Defined results: null and empty texts are one end token; a null doc_id is not held out and trains; repeated rows count
each time; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxelframe.llm import text as T
from voxelframe.llm.rendezvous import Rendezvous, merge, pack, unpack
from voxelframe.session import table

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_ids: list, modulus: int, remainder: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i in doc_ids], bool)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, one end token after each row, and where each row begins and ends."""
    low = T.LOWER[buf]
    start, end, row = T.spans(low, off)
    n = np.bincount(row, minlength=len(off) - 1)
    last = np.cumsum(n + 1) - 1
    out = np.empty(len(start) + len(n), np.uint64)
    out[np.arange(len(start)) + row] = T.span_hash(T.prefix(low), start, end, low)
    out[last] = END
    return out, last - n, last


def ngrams(seq: np.ndarray, first: np.ndarray, last: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the n-grams that end at each token, by length; those of length 1 are even, longer ones odd. Entries that
    would reach past the start of text are those of the longest that doesn't. Also each token's place in its row."""
    place = np.arange(len(seq)) - np.repeat(first, last - first + 1)
    before, keys = seq, [seq & ~np.uint64(1)]
    acc = seq.copy()
    for k in range(2, order + 1):
        before = np.concatenate([[START], before[:-1]])
        before[first] = START
        longer = T.mix(acc * T.FOLD + before)
        acc = np.where(place >= k - 2, longer, acc)
        keys.append(acc | np.uint64(1))
    return keys, place


def _keys(docs: pa.Table, order: int):
    for i, j, buf, off in T.chunks(*T.flat(docs["text"])):
        seq, first, last = tokens(buf, off)
        yield i, j, first, last, *ngrams(seq, first, last, order)


class Automaton:
    """States and tokens are the numbers of n-grams; ROOT is the empty context. An n-gram's arc leads from its context, by
    its last token, to `to`; `shorter` is where a state's failure arc leads."""

    ROOT, STRETCH = -1, 256

    def __init__(self, n: int, order: int, context_counts: np.ndarray, mu: float):
        """n n-grams; state n is the start of text. context_counts tells how often training has seen each state."""
        self.order, self.start = order, n if context_counts[n] > 0 else self.ROOT
        self.weight, self.to = np.zeros(n), np.full(n, self.ROOT)
        self.context, self.token, self.shorter = np.full(n, self.ROOT), np.zeros(n, np.int64), np.full(n + 1, self.ROOT)
        self.failure = np.log10(mu / (context_counts + mu))
        self.arcs: T.Index | None = None

    @staticmethod
    def _key(state: np.ndarray, token: np.ndarray) -> np.ndarray:
        return T.mix((state.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64))

    def close(self) -> None:
        """All arcs are put in; those of states other than the root are found by their state and token."""
        own = np.flatnonzero(self.context >= 0)
        key = self._key(self.context[own], self.token[own])
        order = np.argsort(key)
        self.arcs, self.arc = T.Index(key[order]), own[order]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a token, and the weights of the arcs to them."""
        out, weight = np.full(len(state), self.ROOT), np.zeros(len(state))
        state, left = state.copy(), np.flatnonzero(state != self.ROOT)
        root = state == self.ROOT
        while len(left):
            at = self.arcs.look(self._key(state[left], token[left]))
            hit = at >= 0
            arc, there = self.arc[at[hit]], left[hit]
            weight[there] += self.weight[arc]
            out[there] = self.to[arc]
            left = left[~hit]
            weight[left] += self.failure[state[left]]
            state[left] = self.shorter[state[left]]
            root[left] = state[left] == self.ROOT
            left = left[~root[left]]
        weight[root] += self.weight[token[root]]
        out[root] = self.to[token[root]]
        return out, weight

    def scores(self, tokens: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each text, from the place of its first token to that of its last, the sum of the weights."""
        size, before = last - first + 1, self.order - 1
        many = -(-size // self.STRETCH)
        text = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        warm = np.where(nth > 0, before, 0)
        begin = first[text] + nth * self.STRETCH - warm
        length = np.minimum(self.STRETCH, size[text] - nth * self.STRETCH) + warm
        order = np.argsort(-length, kind="stable")
        text, warm, begin, length = text[order], warm[order], begin[order], length[order]
        state = np.where((nth[order] > 0) | (before == 0), self.ROOT, self.start)
        total = np.zeros(len(text))
        live = len(text)
        for k in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length[:live], -k, "left"))
            state[:live], weight = self.step(state[:live], tokens[begin[:live] + k])
            total[:live] += np.where(warm[:live] <= k, weight, 0.0)
        return np.bincount(text, total, len(size))


def score(docs: DataFrame, order: int = 2, mu: float = 50.0, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """A row for each of `docs` (doc_id, text), scored by a model of those not held out: crc32(doc_id) % modulus is
    not remainder."""
    r = Rendezvous(docs)

    def ask(docs, _):
        docs = T.rows_in_order(docs)
        out = held_out(docs["doc_id"].to_pylist(), modulus, remainder)
        seen, trained = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for i, j, first, last, keys, place in _keys(docs, order):
            train = np.repeat(~out[i:j], last - first + 1)
            seen += [np.unique(k) for k in keys]
            trained += [k[train & (place >= n - 1)] for n, k in enumerate(keys)]
        keys = np.unique(np.concatenate(seen))
        known, n = np.unique(np.concatenate(trained), return_counts=True)
        counts = np.zeros(len(keys), np.uint64)
        counts[np.searchsorted(keys, known)] = n
        return keys, counts

    def answer(_, asked):
        groups, ends, index, (n, keys) = merge(asked)
        total = np.zeros(len(keys), np.uint64)
        np.add.at(total, index, n)
        words = total[(keys & np.uint64(1)) == 0]
        sums = np.array([words.sum(), (words > 0).sum()], np.uint64)
        for g, a, b in zip(groups, ends[:-1], ends[1:], strict=True):
            yield g, pack(total[index[a:b]], sums, rising=False)

    def finish(docs, answers):
        docs = T.rows_in_order(docs)
        got = [unpack(p, rising=False) for p in answers.values()]
        counts, sums = np.concatenate([x[0] for x in got]).astype(float), np.sum([x[1] for x in got], axis=0)
        size, kinds = float(sums[0]), float(sums[1])
        index = T.Index(np.unique(np.concatenate([np.unique(k) for *_, keys, _ in _keys(docs, order) for k in keys])))
        known = np.append(counts, counts[index.find(np.array([END & ~np.uint64(1)]))][0])  # a text starts as often as one ends
        n = len(counts)
        model, parts = Automaton(n, order, known, mu), []
        for *_, first, last, keys, place in _keys(docs, order):
            at = [index.find(k) for k in keys]
            p = (counts[at[0]] + 1) / (size + 1 * (kinds + 1))
            base = np.log10(p)
            model.weight[at[0]] = base
            if order > 1:
                model.to[at[0]] = np.where(counts[at[0]] > 0, at[0], model.ROOT)
            for k in range(2, order + 1):
                context = np.concatenate([[n], at[k - 2][:-1]])
                context[first] = n
                c = counts[at[k - 1]]
                p = np.where(place >= k - 2, (c + mu * p) / (known[context] + mu), p)
                seen = np.flatnonzero((place >= k - 2) & (c > 0))
                arc = at[k - 1][seen]
                model.weight[arc], model.context[arc], model.token[arc] = np.log10(p[seen]), context[seen], at[0][seen]
                model.to[arc] = arc if k < order else at[order - 2][seen]
                model.shorter[arc] = at[k - 2][seen]
            parts.append((at[0], first, last, (counts[at[0]] > 0).astype(np.int64), base))
        model.close()
        made = [(last - first + 1, np.add.reduceat(seen, first), np.add.reduceat(base, first), model.scores(tok, first, last)) for tok, first, last, seen, base in parts]
        n, known, base, mine = (np.concatenate(x) for x in zip(*made, strict=True))
        ids = docs["doc_id"]
        return pa.table({"doc_id": ids.cast(pa.int64()), "held_out": held_out(ids.to_pylist(), modulus, remainder), "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), int(sums[0])), "base_score": base, "score": mine})

    return r.finish(finish, r.answer(r.ask(ask), answer), SCHEMA)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
