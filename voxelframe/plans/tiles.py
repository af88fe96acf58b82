"""Tiling: how large tiles are, which tiles a coordinate lies in, and row-major arithmetic."""

from __future__ import annotations

from math import floor, prod

import numpy as np


def strides(shape: tuple[int, ...]) -> list[int]:
    return [prod(shape[i + 1 :]) for i in range(len(shape))]


def tile_sizes(size, shape: tuple[int, ...], dtype) -> tuple[int, ...]:
    """Tile of a value of this shape: given as a tuple or an int for all dimensions, or as kilobytes in a string. For a
    budget, leading dimensions shrink to one until what remains fits, and the next takes as many rows as fit."""
    if isinstance(size, int):
        size = (size,) * len(shape)
    if isinstance(size, tuple):
        if len(size) != len(shape) or any(s < 1 for s in size):
            raise ValueError(f"tile {size} does not suit values of shape {shape}")
        return size
    if not isinstance(size, str):
        raise ValueError("a tile is a tuple, an int, or kilobytes as a string")
    budget, item = 1000.0 * float(size), np.dtype(dtype).itemsize
    if budget <= item:
        return (1,) * len(shape)
    out = list(shape)
    for axis, n in enumerate(shape):
        row = item * prod(shape[axis + 1 :])
        if row < budget:
            out[axis] = int(min(n, floor(budget / row)))
            break
        out[axis] = 1
    return tuple(out)


def paddings(padding, tile: tuple[int, ...], shape: tuple[int, ...]) -> tuple[int, ...]:
    if padding is None:
        padding = 0
    if isinstance(padding, int):
        padding = (padding,) * len(tile)
    if any(t + p > n for t, p, n in zip(tile, padding, shape, strict=True)):
        raise ValueError(f"tile {tile} and padding {padding} exceed the value shape {shape}")
    if any(p > t for t, p in zip(tile, padding, strict=True)):
        raise ValueError(f"padding {padding} exceeds the tile {tile}")
    return tuple(padding)


def grid(tile: tuple[int, ...], shape: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(-(-n // t) for t, n in zip(tile, shape, strict=True))


def bounds(at: tuple[int, ...], tile, padding, shape) -> list[tuple[int, int]]:
    """First and end coordinate of a padded tile along each axis."""
    return [(max(0, b * t - p), min(n, (b + 1) * t + p)) for b, t, p, n in zip(at, tile, padding, shape, strict=True)]
