"""Suffix-array dedup: bytes covered by a string of `width` bytes that also starts elsewhere.

Every window of `width` bytes has an anchor that its own bytes fix: the leftmost least hash of its `gram`-byte strings.
Equal windows have their anchors at equal offsets, and the windows of one anchor are consecutive, so the suffix array is
sparse: of the suffixes at anchors, not at all bytes. Suffixes whose first gram occurs once are dropped at once. The
others are sorted with the text that their windows reach, forwards from the anchor and, mirrored, backwards:

- shallow: multikey quicksort on 8-byte characters, all groups of equal prefixes at a time, down to `SHALLOW` bytes;
- deep: each group that is still tied goes to a blind trie, which compares a suffix with one leaf only and yields the
  order and the common prefixes of neighbours.

A window that starts d bytes before its anchor recurs if another suffix agrees on width - d bytes forwards and d bytes
backwards. Both arrays' common prefixes give the classes of agreement at each depth, and equal pairs of classes are the
repeated windows. This is exact for all pairs, not only for neighbours.

Suffixes of a gram that is found very often are not compared in one place: each of their windows is dealt out by a hash of
its own (two independent ones, folded), and merged with equal ones before it is shuffled, so that a passage that a third
of all documents hold is one entry a group, whatever surrounds it.

Defined results: null and empty texts have no bytes; every row is a text of its own, also under a repeated or null
doc_id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxelframe.llm import text as T
from voxelframe.llm.rendezvous import Rendezvous, cuts, merge, pack, unpack
from voxelframe.session import table

GRAM, SHALLOW = 64, 96
#: A gram is very frequent from so many suffixes on.
FREQUENT = 2_000
#: Suffixes whose contexts are handled at a time.
SLICE = 2048
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, by minima from both ends of blocks of w."""
    n = len(v)
    if n < w:
        return v[:0]
    padded = np.concatenate([v, np.full(-n % w, v.max(), v.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(padded, axis=1).reshape(-1)
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(buf: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors with their gram's hash, first and last window start and row."""
    none = np.zeros(0, np.int64)
    n = len(buf) - width + 1
    if n <= 0:
        return none, none.astype(np.uint64), none, none, none
    sums, (_, down) = T.prefix(buf), T.powers(len(buf) + 1)
    h = T.mix((sums[gram:] - sums[:-gram]) * down[: len(buf) - gram + 1])
    place = np.arange(len(h), dtype=np.uint64)
    least = sliding_min((h & np.uint64(0xFFFFFFFF00000000)) | place, width - gram + 1)[:n]
    row = np.repeat(np.arange(len(off) - 1), np.maximum(0, np.diff(off)))
    start = np.flatnonzero(row[:n] == row[width - 1 :])
    if not len(start):
        return none, none.astype(np.uint64), none, none, none
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero((at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(start)]]) - 1
    p = at[first]
    return p, h[p], start[first], start[last], row[p]


def blind_trie(values: list[int], bits: int) -> tuple[list[int], list[int]]:
    """The order of equally long strings given as integers, and the number of leading bits that each shares with the
    one before it (the first: 0). A node is [bit, zero, one]; a leaf is a list of equal strings' places."""
    leaves: list[list[int]] = [[0]]
    bit, child, root = [], [], ~0  # node k tests bit[k]; children below 0 are leaves
    for k in range(1, len(values)):
        x, node = values[k], root
        while node >= 0:
            node = child[node][x >> (bits - 1 - bit[node]) & 1]
        differ = x ^ values[leaves[~node][0]]
        if not differ:
            leaves[~node].append(k)
            continue
        at = bits - differ.bit_length()
        side = x >> (bits - 1 - at) & 1
        up, node = None, root
        while node >= 0 and bit[node] < at:
            up, node = node, child[node][x >> (bits - 1 - bit[node]) & 1]
        leaves.append([k])
        leaf = ~(len(leaves) - 1)
        bit.append(at)
        child.append([leaf, node] if side == 0 else [node, leaf])
        if up is None:
            root = len(bit) - 1
        else:
            child[up][x >> (bits - 1 - bit[up]) & 1] = len(bit) - 1
    order, shared, stack = [], [], [(root, 0)]
    while stack:
        node, common = stack.pop()
        if node < 0:
            own = leaves[~node]
            order += own
            shared += [common] + [bits] * (len(own) - 1)
        else:
            stack.append((child[node][1], bit[node]))
            stack.append((child[node][0], common))
    return order, shared


def deep_shallow(rows: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of equally long byte strings within given groups, and the number of bytes that each shares with the
    one before it (0 at a group's first)."""
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8")
    order = np.argsort(group, kind="stable")
    g = group[order]
    head = np.ones(n, bool)
    head[1:] = g[1:] != g[:-1]
    lcp = np.zeros(n, np.int64)
    for k in range(min(words.shape[1], -(-shallow // 8))):
        part = np.cumsum(head)
        size = np.bincount(part)
        tied = np.flatnonzero(size[part] > 1)
        if not len(tied):
            return order, np.minimum(lcp, width)
        w = words[order[tied], k].astype(np.uint64)
        s = np.lexsort((w, part[tied]))
        order[tied], w, p = order[tied][s], w[s], part[tied]
        cut = np.flatnonzero((w[1:] != w[:-1]) & (p[1:] == p[:-1])) + 1
        if len(cut):
            x = w[cut] ^ w[cut - 1]
            zeros = np.zeros(len(x), np.int64)
            for step in (32, 16, 8):
                zero = (x >> np.uint64(64 - step)) == 0
                zeros += zero * (step // 8)
                x = np.where(zero, x << np.uint64(step), x)
            lcp[tied[cut]] = 8 * k + zeros
            head[tied[cut]] = True
    part = np.flatnonzero(head)
    end = np.append(part[1:], n)
    for a, b in zip(part[end - part > 1].tolist(), end[end - part > 1].tolist(), strict=True):
        own = order[a:b]
        values = [int.from_bytes(x.tobytes(), "big") for x in rows[own]]
        if b - a == 2:  # a trie of one node
            x = values[0] ^ values[1]
            s, shared = ([0, 1] if values[0] <= values[1] else [1, 0]), [0, 8 * width - x.bit_length()]
        else:
            s, shared = blind_trie(values, 8 * width)
        order[a:b] = own[s]
        lcp[a + 1 : b] = np.array(shared[1:]) // 8
    return order, np.minimum(lcp, width)


def repeated(before: np.ndarray, after: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """For suffixes with the bytes before and after their anchors, whether the window that starts d bytes before the
    anchor recurs in the group, for d from low to high; suffixes × (before's width + 1)."""
    n, reach = before.shape
    out = np.zeros((n, reach + 1), bool)
    f, lcp_f = deep_shallow(after, group, SHALLOW)
    b, lcp_b = deep_shallow(np.ascontiguousarray(before[:, ::-1]), group, SHALLOW)
    rank_f, rank_b = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_f[f], rank_b[b] = np.arange(n), np.arange(n)
    edge_b = np.ones(n, bool)
    edge_b[1:] = group[b][1:] != group[b][:-1]
    best_f = np.maximum(lcp_f, np.append(lcp_f[1:], 0))[rank_f]
    best_b = np.maximum(lcp_b, np.append(lcp_b[1:], 0))[rank_b]
    low, high = np.maximum(low, width - best_f), np.minimum(high, best_b)
    live = np.flatnonzero(low <= high)
    for d in range(reach + 1):
        on = live[(low[live] <= d) & (d <= high[live])]
        if len(on) < 2:
            continue
        pair = np.cumsum(lcp_f < width - d)[rank_f[on]] * (n + 1) + np.cumsum(edge_b | (lcp_b < d))[rank_b[on]]
        s = np.argsort(pair)
        same = pair[s[1:]] == pair[s[:-1]]
        out[on[s[1:]][same], d] = True
        out[on[s[:-1]][same], d] = True
    return out


def runs(group: np.ndarray):
    """Places of whole groups, about 2 * SLICE at a time; of groups of one nothing."""
    order = np.argsort(group, kind="stable")
    size = np.bincount(group)
    order = order[size[group[order]] > 1]
    edge = np.flatnonzero(np.diff(group[order])) + 1
    ends, at = np.append(edge, len(order)), 0
    while at < len(order):
        stop = int(ends[min(np.searchsorted(ends, at + 2 * SLICE), len(ends) - 1)])
        yield np.sort(order[at:stop])
        at = stop


class _Suffixes:
    def __init__(self, docs: pa.Table, width: int):
        self.docs, self.width, self.reach = docs, width, width - GRAM
        self.buf, self.off = T.flat(docs["text"])
        parts = [(i, anchors(buf, off, width, GRAM)) for i, _, buf, off in T.chunks(self.buf, self.off)]
        move = [self.off[i] for i, _ in parts]
        self.p, self.a, self.b = (T.joined([x[k] + m for (_, x), m in zip(parts, move, strict=True)], np.int64) for k in (0, 2, 3))
        # Anchors have small hashes by their nature; mixed again, they are spread over all buckets.
        self.key = T.mix(T.joined([x[1] for _, x in parts], np.uint64) + T.STEP)
        self.row = T.joined([x[4] + i for i, x in parts], np.int64)

    def first_round(self) -> tuple[np.ndarray, np.ndarray]:
        keys, self.index, n = np.unique(self.key, return_inverse=True, return_counts=True)
        return keys, n.astype(np.uint32)

    def second_round(self, kind: np.ndarray) -> tuple[np.ndarray, ...]:
        """Keys in order, least and greatest distance of a window, whether there are several like it, and contexts, of
        distinct suffixes; self.use and self.entry tell whose they are."""
        kind = kind[self.index]
        use = np.flatnonzero(kind == 1)
        self.many = np.flatnonzero(kind == 2)
        key, low, high = self.key[use], self.p[use] - self.b[use], self.p[use] - self.a[use]
        span = self.reach + self.width
        context = np.zeros((len(use), span), np.uint8)
        first, end = self.off[self.row[use]], self.off[self.row[use] + 1]
        for k in range(0, len(use), SLICE):
            at = self.p[use[k : k + SLICE], None] + np.arange(-self.reach, self.width)
            inside = (at >= first[k : k + SLICE, None]) & (at < end[k : k + SLICE, None])
            context[k : k + SLICE][inside] = self.buf[at[inside]]
        factors = np.multiply.accumulate(np.full(-(-span // 8), T.STEP)) | np.uint64(1)
        one, two = np.zeros(len(use), np.uint64), np.zeros(len(use), np.uint64)
        for k in range(0, len(use), SLICE):
            words = np.zeros((len(context[k : k + SLICE]), len(factors)), np.uint64)
            words.view(np.uint8)[:, :span] = context[k : k + SLICE]
            one[k : k + SLICE], two[k : k + SLICE] = ((T.mix(words + np.uint64(x)) * factors).sum(1) for x in (0, 1))
        record = np.stack([key, low.astype(np.uint64), high.astype(np.uint64), one, two], axis=1)
        _, at, self.entry, n = np.unique(record, axis=0, return_index=True, return_inverse=True, return_counts=True)
        self.entry, self.use = self.entry.reshape(-1), use
        return key[at], low[at].astype(np.uint16), high[at].astype(np.uint16), (n > 1).astype(np.uint8), context[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, in order, of the windows of very frequent suffixes, and whether there are several of each;
        self.start and self.window tell whose they are."""
        self.start = T.take_ranges(self.a[self.many], self.b[self.many] - self.a[self.many] + 1)
        hashes = [np.zeros(0, np.uint64)]
        for i, j, buf, off in T.chunks(self.buf, self.off):
            at = self.start[(self.start >= self.off[i]) & (self.start < self.off[j])] - self.off[i]
            if len(at):
                _, down = T.powers(len(buf) + 1)
                one, two = ((x[at + self.width] - x[at]) * down[at] for x in (T.prefix(buf), T.prefix(T.TURN[buf])))
                hashes.append(T.mix(T.mix(one) + two))
        keys, self.window, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        self.window = self.window.reshape(-1)
        return keys, (n > 1).astype(np.uint8)

    def covered(self, marks: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Bytes under the windows that are marked for each entry, and under repeated ones of very frequent suffixes."""
        d = np.zeros(len(self.buf) + 1, np.int32)
        start = self.start[repeated[self.window]]
        np.add.at(d, start, 1)
        np.subtract.at(d, start + self.width, 1)
        for i in range(0, len(self.use), SLICE):
            s, k = np.nonzero(marks[self.entry[i : i + SLICE]])
            start = self.p[self.use[i + s]] - k
            np.add.at(d, start, 1)
            np.subtract.at(d, start + self.width, 1)
        return np.cumsum(d[:-1], dtype=np.int32) > 0


def remove_repeats(docs: DataFrame, width: int = 400, frequent: int = FREQUENT, with_text: bool = False) -> DataFrame:
    """A row for each of `docs` (doc_id, text); with_text adds the remaining bytes."""
    if width <= GRAM:
        raise ValueError(f"strings have more than {GRAM} bytes")
    r = Rendezvous(docs, group_bytes=4 << 20)
    n, reach = r.n, width - GRAM
    span = reach + width

    def ask_grams(docs, _):
        return _Suffixes(T.rows_in_order(docs), width).first_round()

    def count(_, asked):
        groups, ends, index, (m, keys) = merge(asked)
        total = np.bincount(index, m, len(keys))
        kind = (total > 1).astype(np.uint8) + (total > frequent)
        for g, a, b in zip(groups, ends[:-1], ends[1:], strict=True):
            yield g, kind[index[a:b]].tobytes()

    def kinds(answers):
        return T.joined([np.frombuffer(p, np.uint8) for b, p in answers.items() if b < 1 << 24], np.uint8)

    def ask_suffixes(docs, answers):
        s = _Suffixes(T.rows_in_order(docs), width)
        s.first_round()
        key, *rest, context = s.second_round(kinds(answers))
        window, several = s.windows()
        at, to = cuts(key, n), cuts(window, n)
        for k in range(n):
            a, b, own = at[k], at[k + 1], slice(to[k], to[k + 1])
            yield k, pack(key[a:b], *(x[a:b] for x in rest), context[a:b].reshape(-1), np.diff(window[own], prepend=np.uint64(0)), several[own])

    def compare(_, asked):
        parts = {g: unpack(asked.pop(g)) for g in list(asked)}
        window, more = (np.concatenate(x) for x in zip(*((np.cumsum(x[5], dtype=np.uint64), x[6]) for x in parts.values()), strict=True))
        _, same, count = np.unique(window, return_inverse=True, return_counts=True)
        again = (more > 0) | (count > 1)[same.reshape(-1)]
        key, low, high, several, context = (np.concatenate(x) for x in zip(*(x[:5] for x in parts.values()), strict=True))
        context, sizes = context.reshape(-1, span), {g: (len(x[0]), len(x[5])) for g, x in parts.items()}
        del parts
        _, group = np.unique(key, return_inverse=True)
        out = np.zeros((len(key), reach + 1), bool)
        for own in runs(group.reshape(-1)):
            out[own] = repeated(context[own, :reach], context[own, reach:], group.reshape(-1)[own], low[own].astype(np.int64), high[own].astype(np.int64), width)
        d = np.arange(reach + 1)
        out |= (several[:, None] > 0) & (d >= low[:, None]) & (d <= high[:, None])
        at = to = 0
        for g, (size, many) in sizes.items():
            yield g, pack(np.packbits(out[at : at + size], axis=1).reshape(-1), again[to : to + many].view(np.uint8), rising=False)
            at, to = at + size, to + many

    def finish(docs, answers):
        docs = T.rows_in_order(docs)
        s = _Suffixes(docs, width)
        s.first_round()
        s.second_round(kinds(answers))
        s.windows()
        got = [unpack(p, rising=False) for b, p in answers.items() if b >= 1 << 24]
        packed = T.joined([x[0] for x in got], np.uint8).reshape(-1, -(-(reach + 1) // 8))
        gone = s.covered(np.unpackbits(packed, axis=1, count=reach + 1).astype(bool), T.joined([x[1] for x in got], np.uint8) > 0)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        first = s.off[:-1][s.off[:-1] < len(gone)]
        edge[first] = gone[first]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[s.off])
        removed = total(gone)
        data, kept = s.buf[~gone].tobytes(), np.concatenate([[0], np.cumsum(np.diff(s.off) - removed)]).tolist()
        rest = [data[a:b] for a, b in zip(kept[:-1], kept[1:], strict=True)]
        made = {"doc_id": docs["doc_id"].cast(pa.int64()), "n_bytes": np.diff(s.off), "n_removed": removed, "n_spans": total(edge), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in rest]}
        return pa.table(made | ({"kept": pa.array(rest, pa.binary())} if with_text else {}))

    first = r.answer(r.ask(ask_grams), count)
    second = r.answer(r.ask(ask_suffixes, first), compare, tag=1)
    return r.finish(finish, first.unionByName(second), SCHEMA + (", kept binary" if with_text else ""))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
