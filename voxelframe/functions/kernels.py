"""numpy kernels for what has no sensible SQL form: spatial filters, and PNG and TIFF files."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def _windows(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Windows along an axis, from size // 2 places before; beyond the edges the value is mirrored, edge included."""
    pad = [(0, 0)] * x.ndim
    pad[axis] = (size // 2, size - 1 - size // 2)
    x = np.pad(x, pad, mode="symmetric")
    return np.lib.stride_tricks.sliding_window_view(x, size, axis)


def sizes(size, ndim: int) -> list[int]:
    """Of a filter along each axis; a third size of 0 leaves planes on their own."""
    out = [size] * ndim if np.isscalar(size) else list(size)
    if len(out) != ndim:
        raise ValueError(f"{len(out)} sizes for {ndim} dimensions")
    return out


def uniform_filter(x: np.ndarray, size) -> np.ndarray:
    for axis, s in enumerate(sizes(size, x.ndim)):
        if s > 1:
            mean = _windows(x, int(s), axis).mean(-1)
            x = np.trunc(mean).astype(x.dtype) if x.dtype.kind in "iu" else mean
    return x


def median_filter(x: np.ndarray, size) -> np.ndarray:
    kind, n = x, 1
    for axis, s in enumerate(sizes(size, x.ndim)):
        s = max(1, int(s))
        kind, n = _windows(kind, s, axis), n * s
    flat = kind.reshape(*x.shape, n)
    return np.partition(flat, n // 2, axis=-1)[..., n // 2]


def gaussian_weights(sigma: float, order: int) -> np.ndarray:
    """Sampled Gaussian within 4 sigma, scaled to sum 1, or its derivative."""
    r = int(4 * sigma + 0.5)
    t = np.arange(-r, r + 1, dtype=float)
    w = np.exp(-(t**2) / (2 * sigma**2))
    w /= w.sum()
    poly = np.polynomial.Polynomial([1.0])  # d/dt of poly * w is (poly' - t / sigma**2 * poly) * w
    for _ in range(order):
        poly = poly.deriv() - np.polynomial.Polynomial([0.0, 1 / sigma**2]) * poly
    return w * poly(t)


def gaussian_filter(x: np.ndarray, sigma, order: int = 0) -> np.ndarray:
    for axis, s in enumerate(sizes(sigma, x.ndim)):
        if s > 1e-15:
            w = gaussian_weights(float(s), order)
            y = _windows(x, len(w), axis) @ w[::-1]
            x = np.trunc(y).astype(x.dtype) if x.dtype.kind in "iu" else y
    return x


def by_plane(fn, x: np.ndarray, size) -> np.ndarray:
    """A filter of a 2-d or 3-d value; of a volume with third size 0, plane by plane."""
    s = sizes(size, x.ndim)
    if x.ndim == 3 and s[2] == 0:
        return np.stack([fn(x[:, :, z], s[:2]) for z in range(x.shape[2])], axis=2)
    return fn(x, s)


PNG = b"\x89PNG\r\n\x1a\n"


def png_encode(x: np.ndarray) -> bytes:
    """8- or 16-bit grey, or RGB(A) if there is a third axis of 3 or 4."""
    x = np.asarray(x)
    if x.ndim not in (2, 3) or x.ndim == 3 and x.shape[2] not in (3, 4):
        raise ValueError(f"no PNG holds an image of shape {x.shape}")
    depth = 16 if x.dtype.itemsize > 1 else 8
    raw = x.astype(">u2" if depth == 16 else "u1")
    rows = raw.reshape(len(x), -1).view(np.uint8)
    data = np.concatenate([np.zeros((len(x), 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    colour = 0 if x.ndim == 2 else {3: 2, 4: 6}[x.shape[2]]
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def _png_pass(data: bytes, at: int, h: int, w: int, bits: int) -> tuple[np.ndarray, int]:
    """The bytes of h rows of w pixels of so many bits with their filters undone, and where the data goes on."""
    width, step = -(-w * bits // 8), max(1, bits // 8)
    rows = np.frombuffer(data, np.uint8, h * (1 + width), at).reshape(h, 1 + width)
    out = np.zeros((h + 1, width + step), np.int64)  # a row and a pixel of zeros before the first
    for y in range(h):
        kind, line, up = int(rows[y, 0]), rows[y, 1:].astype(np.int64), out[y]
        own = out[y + 1]
        if kind in (0, 2):
            own[step:] = (line + (up[step:] if kind == 2 else 0)) & 255
        elif kind == 1:
            own[step:] = (np.cumsum(line.reshape(-1, step), axis=0) & 255).reshape(-1)
        else:
            for k in range(step, len(own)):
                a, b, c = own[k - step], up[k], up[k - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                own[k] = (line[k - step] + guess) & 255
    return np.ascontiguousarray(out[1:, step:].astype(np.uint8)), at + h * (1 + width)


#: First row and column and their steps of the seven passes of an interlaced PNG.
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


def png_decode(data: bytes) -> np.ndarray:
    """Grey, grey with alpha, RGB, RGBA and palettes of all depths, also interlaced. Grey of under 8 bits is brought to 8."""
    if data[:8] != PNG:
        raise ValueError("not a PNG file")
    at, body, palette = 8, [], None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    channels, raw, at = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour], zlib.decompress(b"".join(body)), 0
    x = np.zeros((h, w, channels), np.uint16 if depth == 16 else np.uint8)
    for y0, x0, dy, dx in PASSES if interlaced else [(0, 0, 1, 1)]:
        rows, columns = len(range(y0, h, dy)), len(range(x0, w, dx))
        if rows and columns:
            part, at = _png_pass(raw, at, rows, columns, channels * depth)
            if depth == 16:
                part = part.view(">u2")
            elif depth < 8:
                bits = np.unpackbits(part, axis=1)[:, : columns * depth].reshape(rows, columns, depth)
                part = (bits << np.arange(depth - 1, -1, -1)).sum(2)
            x[y0::dy, x0::dx] = part.reshape(rows, columns, channels)
    x = x if channels > 1 else x[:, :, 0]
    if colour == 3:
        return palette[x]
    return x * np.uint8(255 // (2**depth - 1)) if depth < 8 else x


def tif_encode(x: np.ndarray) -> bytes:
    """Uncompressed little-endian TIFF, a page for each plane along the third axis."""
    x = np.asarray(x)
    if x.ndim not in (2, 3):
        raise ValueError(f"no TIFF holds an image of shape {x.shape}")
    pages = [x] if x.ndim == 2 else [x[k] for k in range(x.shape[0])]
    kind = {"u": 1, "i": 2, "f": 3, "b": 1}[x.dtype.kind]
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in pages:
        raw = np.ascontiguousarray(page.astype(page.dtype.newbyteorder("<"))).tobytes()
        start = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        struct.pack_into("<I", out, link, len(out))
        tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, 8 * page.itemsize), (259, 3, 1), (262, 3, 1), (273, 4, start), (277, 3, 1), (278, 4, page.shape[0]), (279, 4, len(raw)), (339, 3, kind)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, before, acc, have, out = list(first), 9, b"", 0, 0, []
    for byte in data:
        acc, have = (acc << 8 | byte) & 0xFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = acc >> have & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = list(first), 9, b""
            continue
        word = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + word[:1])
        out.append(word)
        before = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def _packbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        out.append(data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
        at += n + 2 if n < 128 else 2 if n > 128 else 1
    return b"".join(out)


#: The numbers of TIFF's compressions.
UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def tif_decode(data: bytes) -> np.ndarray:
    """Pages of one shape in strips or tiles, uncompressed or packed by deflate, LZW or PackBits, with samples of one kind side
    by side; pages × rows × columns."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    (at,), pages = struct.unpack_from(order + "I", data, 4), []
    while at:
        (n,), tags = struct.unpack_from(order + "H", data, at), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            code, width = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("B", 1))
            place = at + 10 + 12 * k
            if width * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
        bits, samples = tags.get(258, (1,))[0], tags.get(277, (1,))[0]
        dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(339, (1,))[0]]}{bits // 8}")
        packed, ahead = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
        if packed not in UNPACK or bits % 8 or ahead > 2 or samples > 1 and tags.get(284, (1,))[0] != 1:
            raise ValueError(f"TIFF files of compression {packed}, {bits} bits, predictor {ahead} in this layout are not read")
        h, w = tags[257][0], tags[256][0]
        tiled = 324 in tags
        rows, columns = (tags[323][0], tags[322][0]) if tiled else (min(h, tags.get(278, (h,))[0]), w)
        page, across = np.zeros((h, w, samples), dtype), -(-w // columns)
        for k, (a, c) in enumerate(zip(*(tags[t] for t in ((324, 325) if tiled else (273, 279))), strict=True)):
            y, x = k // across * rows, k % across * columns
            n_rows = rows if tiled else min(rows, h - y)
            part = np.frombuffer(UNPACK[packed](data[a : a + c]), dtype, n_rows * columns * samples).reshape(n_rows, columns, samples)
            if ahead == 2:
                part = np.cumsum(part, axis=1, dtype=dtype)
            page[y : y + rows, x : x + columns] = part[: h - y, : w - x]
        pages.append((page if samples > 1 else page[:, :, 0]).astype(dtype.newbyteorder("=")))
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return np.stack(pages)
