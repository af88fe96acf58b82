"""Blocks: tiles of a sequence of images, each over all images, with or without padding.

A row is a tile: its coordinates in the grid, and the elements of all images in it, image by image and row-major.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.operators.frame import from_arrow, to_arrow
from voxelframe.operators.images import Images
from voxelframe.operators.series import Series
from voxelframe.plans.meta import Meta, spark_type
from voxelframe.plans.tiles import bounds, grid, paddings, strides, tile_sizes
from voxelframe.session import ship


class Blocks:
    def __init__(self, df: DataFrame, images: int, dims: tuple[int, ...], tile: tuple[int, ...], padding: tuple[int, ...], dtype):
        self.df, self.nimages, self.dims, self.tile, self.padding, self.dtype = df, images, dims, tile, padding, np.dtype(dtype)

    @property
    def keys(self) -> list[str]:
        return [f"b{i}" for i in range(len(self.dims))]

    @property
    def grid(self) -> tuple[int, ...]:
        return grid(self.tile, self.dims)

    @property
    def blockshape(self) -> tuple[int, ...]:
        return (self.nimages, *self.tile)

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.nimages, *self.dims)

    @classmethod
    def of_images(cls, images: Images, chunk_size="auto", padding=None) -> Blocks:
        """'auto' makes tiles of about 100 MB over all images."""
        dims = images.value_shape
        size = str(max(int(1e5 / images.shape[0]), 1)) if chunk_size == "auto" else chunk_size
        tile = tile_sizes(size, dims, images.dtype)
        pad = paddings(padding, tile, dims)
        ship(images.df.sparkSession)
        keys, every = [f"b{i}" for i in range(len(dims))], grid(tile, dims)
        size, dtype = images.meta.size, images.dtype

        def cut(batches):  # a row for each tile and image, so that whole pieces are shuffled and not elements
            for b in batches:
                if b.num_rows:
                    x = from_arrow(b.column("values"), size).reshape(-1, *dims)
                    for at in np.ndindex(*every):
                        piece = x[(slice(None), *(slice(a, z) for a, z in bounds(at, tile, pad, dims)))].reshape(len(x), -1)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)) for k in at] + [b.column("k0"), to_arrow(piece, dtype)], [*keys, "k0", "piece"])

        pieces = images.df.select("k0", "values").mapInArrow(cut, ", ".join([f"{k} int" for k in keys] + [f"k0 long, piece array<{spark_type(dtype)}>"]))
        rows = pieces.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k0", "piece"))), lambda s: s.piece)).alias("values"))
        return cls(rows, images.shape[0], dims, tile, pad, images.dtype)

    def _extent(self, axis: int) -> tuple[Column, Column]:
        """First and end coordinate of a row's tile along an axis."""
        b, t, p, n = F.col(self.keys[axis]), self.tile[axis], self.padding[axis], self.dims[axis]
        return F.greatest(b * t - p, F.lit(0)), F.least((b + 1) * t + p, F.lit(n))

    def cells(self, core: bool = True) -> DataFrame:
        """A row for each element: tile, image k0, flat place px in the image, value; core leaves out padding."""
        at = self.df.select(*self.keys, *[x.alias(f"{name}{i}") for i in range(len(self.dims)) for name, x in zip(("lo", "hi"), self._extent(i), strict=True)], F.posexplode("values").alias("pos", "value"))
        rest, px, keep = F.col("pos"), F.lit(0), F.lit(True)
        for i in reversed(range(len(self.dims))):
            n = F.col(f"hi{i}") - F.col(f"lo{i}")
            c = F.pmod(rest, n) + F.col(f"lo{i}")
            rest = F.floor(rest / n)
            px = px + c * strides(self.dims)[i]
            keep = keep & (F.floor(c / self.tile[i]) == F.col(self.keys[i]))
        cells = at.select(*self.keys, rest.cast("long").alias("k0"), px.cast("long").alias("px"), "value", keep.alias("core"))
        return (cells.where("core") if core and any(self.padding) else cells).drop("core")

    def count(self) -> int:
        return prod(self.grid)

    def first(self) -> np.ndarray:
        return self._arrays(self.df.orderBy(*self.keys).limit(1))[0][1]

    def _arrays(self, df: DataFrame) -> list[tuple[tuple[int, ...], np.ndarray]]:
        out = []
        for row in df.select(*self.keys, "values").toArrow().to_pylist():
            at = tuple(row[k] for k in self.keys)
            shape = [z - a for a, z in bounds(at, self.tile, self.padding, self.dims)]
            out.append((at, np.array(row["values"], self.dtype).reshape(self.nimages, *shape)))
        return out

    def collect_blocks(self) -> list[np.ndarray]:
        """All blocks in the order of the grid."""
        return [b for _, b in sorted(self._arrays(self.df), key=lambda x: x[0])]

    def _each(self, fn: Callable, column: pa.DataType | None, schema: str, dtype) -> DataFrame:
        ship(self.df.sparkSession)
        keys, tile, padding, dims, n, old = self.keys, self.tile, self.padding, self.dims, self.nimages, self.dtype

        def run(batches):
            for b in batches:
                for r in range(b.num_rows):
                    one = b.slice(r, 1)
                    at = tuple(one.column(k)[0].as_py() for k in keys)
                    shape = [z - a for a, z in bounds(at, tile, padding, dims)]
                    x = from_arrow(one.column("values"), n * prod(shape)).astype(old).reshape(n, *shape)
                    y = fn(x, shape)
                    value = pa.array([y], column) if column is not None else to_arrow(np.asarray(y).reshape(1, -1), dtype)
                    yield pa.RecordBatch.from_arrays([one.column(k) for k in keys] + [value], [*keys, "values"])

        return self.df.select(*keys, "values").mapInArrow(run, ", ".join([f"{k} int" for k in keys] + [schema]))

    def map(self, fn: Callable, nimages: int | None = None, dtype=None) -> Blocks:
        """fn of each block (images × tile). It may change the number of images, not the tile."""
        n, dtype = nimages or self.nimages, np.dtype(dtype or self.dtype)

        def checked(x, shape):
            y = np.asarray(fn(x))
            if y.shape != (n, *shape):
                raise ValueError(f"a block of {x.shape} became {y.shape}, not {(n, *shape)}")
            return y

        return Blocks(self._each(checked, None, f"values array<{spark_type(dtype)}>", dtype), n, self.dims, self.tile, self.padding, dtype)

    def map_generic(self, fn: Callable) -> np.ndarray:
        """Any object of each block, in an array of the grid's shape on the driver."""
        rows = self._each(lambda x, shape: pickle.dumps(fn(x)), pa.binary(), "values binary", None).collect()
        out = np.empty(self.grid, object)
        for row in rows:
            out[tuple(row[k] for k in self.keys)] = pickle.loads(row["values"])
        return out

    def toimages(self) -> Images:
        ship(self.df.sparkSession)
        keys, tile, padding, dims, n, dtype = self.keys, self.tile, self.padding, self.dims, self.nimages, self.dtype
        step, kind = strides(self.grid), spark_type(self.dtype)

        def cut(batches):  # a row for each tile and image, without padding
            for b in batches:
                for r in range(b.num_rows):
                    one = b.slice(r, 1)
                    at = tuple(one.column(k)[0].as_py() for k in keys)
                    edge = bounds(at, tile, padding, dims)
                    x = from_arrow(one.column("values"), n * prod(z - a for a, z in edge)).reshape(n, *(z - a for a, z in edge))
                    core = tuple(slice(k * t - a, min(n_, (k + 1) * t) - a) for k, t, n_, (a, _) in zip(at, tile, dims, edge, strict=True))
                    piece = x[(slice(None), *core)].reshape(n, -1)
                    number = sum(k * t for k, t in zip(at, step, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, number)), to_arrow(piece, dtype)], ["k0", "tile", "piece"])

        def place(batches):
            every = [tuple(slice(a, z) for a, z in bounds(at, tile, (0,) * len(dims), dims)) for at in np.ndindex(*grid(tile, dims))]
            for b in batches:
                out = np.zeros((b.num_rows, *dims), dtype)
                for k, own in enumerate(b.column("pieces")):
                    numbers, pieces = own.values.field("tile").to_numpy(), own.values.field("piece")
                    for i, number in enumerate(numbers.tolist()):
                        where = every[number]
                        out[(k, *where)] = pieces[i].values.to_numpy(zero_copy_only=False).reshape([w.stop - w.start for w in where])
                yield pa.RecordBatch.from_arrays([b.column("k0"), to_arrow(out.reshape(len(out), -1), dtype)], ["k0", "values"])

        pieces = self.df.select(*keys, "values").mapInArrow(cut, f"k0 long, tile long, piece array<{kind}>")
        whole = pieces.groupBy("k0").agg(F.collect_list(F.struct("tile", "piece")).alias("pieces"))
        return Images(whole.mapInArrow(place, f"k0 long, values array<{kind}>"), Meta((n,), dims, dtype))

    def toseries(self) -> Series:
        """Within a tile, so that no cell leaves it."""
        ship(self.df.sparkSession)
        keys, tile, padding, dims, n, dtype = self.keys, self.tile, self.padding, self.dims, self.nimages, self.dtype
        names = [f"k{i}" for i in range(len(dims))]

        def run(batches):
            for b in batches:
                for r in range(b.num_rows):
                    one = b.slice(r, 1)
                    at = tuple(one.column(k)[0].as_py() for k in keys)
                    edge = bounds(at, tile, padding, dims)
                    x = from_arrow(one.column("values"), n * prod(z - a for a, z in edge)).astype(dtype).reshape(n, -1).T
                    where = np.indices([z - a for a, z in edge]).reshape(len(dims), -1) + np.array([a for a, _ in edge])[:, None]
                    core = np.all([(w // t) == k for w, t, k in zip(where, tile, at, strict=True)], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(w[core].astype(np.int64)) for w in where] + [to_arrow(x[core], dtype)], [*names, "values"])

        rows = self.df.select(*keys, "values").mapInArrow(run, ", ".join([f"{k} long" for k in names] + [f"values array<{spark_type(dtype)}>"]))
        return Series(rows, Meta(dims, (n,), dtype))

    def toarray(self) -> np.ndarray:
        return self.toimages().toarray()

    def __repr__(self) -> str:
        return f"Blocks(shape={self.shape}, tile={self.tile}, padding={self.padding}, grid={self.grid})"
