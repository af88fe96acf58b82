"""Vectorised kernels over many texts at once: words, hashes and byte windows of one flat buffer.

A batch of texts is one uint8 buffer and its offsets. Hashes of short spans are 64-bit polynomials over random byte
values, finished by a mixer; they wrap modulo 2**64. Long spans, of which such polynomials have systematic collisions,
are hashed by BLAKE2b.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute

U64 = np.uint64
#: Space and tab to carriage return separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | U64(1)
#: Another order of the bytes, for a second hash.
TURN = _RNG.permutation(256).astype(np.uint8)
STEP = U64(0x9E3779B97F4A7C15 | 1)
STEP_BACK = U64(pow(int(STEP), -1, 2**64))
FOLD = U64(0xD6E8FEB86659FD93)
CHUNK = 1 << 20
#: Bytes from which on a span is long. Two words over two letters have equal polynomials whatever the base from 512 on.
LONG = 128

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and STEP**-i for i from 0 to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * CHUNK)
        for k, base in enumerate((STEP, STEP_BACK)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(buf: np.ndarray, off: np.ndarray, size: int = CHUNK):
    """Runs of whole rows of about `size` bytes: (first row, end row, bytes, offsets)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; space tells the bytes that separate words."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    space = space[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    first = off[:-1]
    before[first[first < n]] = True
    last = off[1:] - 1
    after[last[last >= 0]] = True
    word = ~space
    start, end = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def prefix(buf: np.ndarray) -> np.ndarray:
    """Sums from which span_hash takes the hash of any span."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(VALUE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Hashes of spans of buf, whose prefix() is given."""
    _, down = powers(len(sums))
    out = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * FOLD)
    for k in np.flatnonzero(end - start >= LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(buf[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive items, rows disregarded; length len(h) - k + 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= FOLD
        acc += h[j : j + n]
    return mix(acc)


def take_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+length[0]-1, start[1] .. and so on."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def rows_in_order(table: pa.Table) -> pa.Table:
    """Sorted by doc_id, nulls last, then by text: equal input gives equal positions when a task runs again."""
    return table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


class Index:
    """Positions in sorted distinct keys that are hashes: spread evenly, so that their top bits nearly give the place."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length())
        self.table = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << U64(64 - self.bits))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key; all are present."""
        at = self.table[wanted >> U64(64 - self.bits)]
        behind = np.flatnonzero(self.keys[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < wanted[behind]]
        return at

    def look(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, -1 where it is not present."""
        at, last = self.table[wanted >> U64(64 - self.bits)], len(self.keys) - 1
        if last < 0:
            return np.full(len(wanted), -1)
        at = np.minimum(at, last)
        behind = np.flatnonzero((self.keys[at] < wanted) & (at < last))
        while len(behind):
            at[behind] += 1
            behind = behind[(self.keys[at[behind]] < wanted[behind]) & (at[behind] < last)]
        return np.where(self.keys[at] == wanted, at, -1)


def joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def bits_of(answers: dict[int, bytes], sizes: np.ndarray) -> np.ndarray:
    """Answers of one bit a key, bucket after bucket, as booleans."""
    return joined([np.unpackbits(np.frombuffer(answers[b], np.uint8), count=n).astype(bool) for b, n in enumerate(sizes) if n], bool)
