"""Images: a sequence of two- or three-dimensional values of one shape, row-major in the array column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxelframe.functions import exprs as X
from voxelframe.functions import kernels as K
from voxelframe.operators.frame import ArrayFrame, from_arrow, to_arrow
from voxelframe.operators.series import Series
from voxelframe.plans.meta import Meta, spark_type
from voxelframe.plans.tiles import strides
from voxelframe.session import ship, shuffle_partitions


class Images(ArrayFrame):
    def reshape(self, *shape: int) -> Images:
        shape = tuple(shape[0]) if len(shape) == 1 and not np.isscalar(shape[0]) else shape
        if prod(shape) != prod(self.shape):
            raise ValueError(f"{shape} has not as many elements as {self.shape}")
        if shape[0] != self.shape[0]:
            raise ValueError("reshaping leaves the number of images as it is")
        if len(shape) not in (3, 4):
            raise ValueError("images have two or three dimensions")
        return Images(self.df, replace(self.meta, value=tuple(shape[1:])))

    def squeeze(self) -> Images:
        left = tuple(n for n in self.value_shape if n > 1) or (1,)
        return Images(self.df, replace(self.meta, value=left))

    def subsample(self, factor) -> Images:
        """Every factor-th element along each dimension."""
        steps = [factor] * len(self.value_shape) if np.isscalar(factor) else list(factor)
        if len(steps) != len(self.value_shape) or any(s <= 0 for s in steps):
            raise ValueError(f"factors {factor} do not suit {self.value_shape}")
        at = [range(0, n, s) for n, s in zip(self.value_shape, steps, strict=True)]
        return self._new(X.gather_nd(self.v, self.value_shape, at), value=tuple(map(len, at)))

    def _projection(self, axis: int, fn) -> Images:
        if not 0 <= axis < len(self.value_shape):
            raise ValueError(f"images of {len(self.value_shape)} dimensions have no axis {axis}")
        left = self.value_shape[:axis] + self.value_shape[axis + 1 :]
        return self._new(X.along(self.v, self.value_shape, axis, fn), value=left)

    def max_projection(self, axis: int = 2) -> Images:
        return self._projection(axis, F.array_max)

    def max_min_projection(self, axis: int = 2) -> Images:
        """The sum of the greatest and the least."""
        least = X.smallest if self.dtype.kind == "f" else F.array_min
        return self._projection(axis, lambda x: F.array_max(x) + least(x))

    def subtract(self, val) -> Images:
        if np.isscalar(val):
            return self._new(F.transform(self.v, lambda x: x - F.lit(val)), dtype=np.result_type(self.dtype, np.asarray(val).dtype if self.dtype.kind != "f" else self.dtype))
        val = np.asarray(val)
        if val.shape != self.value_shape:
            raise ValueError(f"an image of {val.shape} does not fit images of {self.value_shape}")
        dtype = np.result_type(self.dtype, val.dtype)
        one = self.df.sparkSession.createDataFrame(pa.table({"picture": to_arrow(val.reshape(1, -1), dtype)}))
        kind = f"array<{spark_type(dtype)}>"
        beside = self.df.crossJoin(F.broadcast(one))  # one row, as long as a record is
        return Images(beside, self.meta)._new(F.zip_with(self.v.cast(kind), "picture", lambda x, y: x - y), dtype=dtype)

    # filters

    def _filter(self, fn: Callable, size, dtype=None) -> Images:
        if len(self.value_shape) not in (2, 3):
            raise ValueError("images have two or three dimensions")
        K.sizes(size, len(self.value_shape))
        dtype = dtype or self.dtype
        return self._batches(lambda k, x: np.stack([K.by_plane(fn, i, size) for i in x]), self.value_shape, dtype)

    def gaussian_filter(self, sigma=2, order: int = 0) -> Images:
        return self._filter(lambda x, s: K.gaussian_filter(x, s, order), sigma)

    def uniform_filter(self, size=2) -> Images:
        return self._filter(K.uniform_filter, size)

    def median_filter(self, size=2) -> Images:
        return self._filter(K.median_filter, size)

    def localcorr_frame(self, size=2) -> Series:
        """For each pixel the correlation of its sequence with that of its neighbourhood's mean; one number a record."""
        if len(self.value_shape) not in (2, 3):
            raise ValueError("images have two or three dimensions")
        K.sizes(size, len(self.value_shape))
        ship(self.df.sparkSession)
        n, dtype, shape = self.meta.size, self.dtype, self.value_shape

        def run(batches):  # each image and its blurred form from one pass
            for b in batches:
                if b.num_rows:
                    x = from_arrow(b.column("values"), n).astype(dtype)
                    y = np.stack([K.by_plane(K.uniform_filter, i, size) for i in x.reshape(-1, *shape)]).reshape(len(x), n)
                    yield pa.RecordBatch.from_arrays([to_arrow(x, "float64"), to_arrow(y, "float64")], ["a", "b"])

        both = self.df.select("values").mapInArrow(run, "a array<double>, b array<double>")
        cells = both.select(F.posexplode(F.arrays_zip("a", "b")).alias("px", "ab")).select("px", "ab.a", "ab.b")
        # corr() refuses constant sequences in ANSI mode; its parts don't.
        parts = cells.groupBy("px").agg(F.covar_pop("a", "b").alias("c"), (F.stddev_pop("a") * F.stddev_pop("b")).alias("s"))
        r = X.safe_div(F.col("c"), F.col("s"))
        keys = [F.pmod(F.floor(F.col("px") / s), F.lit(n)).cast("long").alias(f"k{i}") for i, (s, n) in enumerate(zip(strides(self.value_shape), self.value_shape, strict=True))]
        return Series(parts.select(*keys, F.array(r).alias("values")), Meta(self.value_shape, (1,), np.dtype("float64")))

    def localcorr(self, size=2) -> np.ndarray:
        return self.localcorr_frame(size).toarray()

    # other types

    def toseries(self, chunk_size=None) -> Series:
        """A record for each pixel. Tiles over all images are shuffled, a piece of an image at a time, and transposed; they
        have the given size (as for toblocks), else as many bytes as give each shuffle partition one, 100 MB at most."""
        if chunk_size is None:
            whole = prod(self.shape) * self.dtype.itemsize / 1000
            chunk_size = str(min(1e5, whole / shuffle_partitions(self.df.sparkSession)) / self.shape[0])
        return self.toblocks(chunk_size).toseries()

    def toblocks(self, chunk_size="auto", padding=None):
        from voxelframe.operators.blocks import Blocks

        return Blocks.of_images(self, chunk_size, padding)

    def map_as_series(self, fn: Callable, value_size: int | None = None, dtype=None, chunk_size="auto") -> Images:
        """fn of every pixel's sequence, by blocks; sequences may change their length."""
        if value_size is None or dtype is None:
            one = np.asarray(fn(self.toseries().first()))
            value_size, dtype = value_size or len(one), dtype or one.dtype
        return self.toblocks(chunk_size).map(lambda b: np.apply_along_axis(fn, 0, b), nimages=value_size, dtype=dtype).toimages()

    # files

    def tobinary(self, path: str, prefix: str = "image", overwrite: bool = False) -> None:
        from voxelframe.sources import sinks

        sinks.images(self, path, prefix, "bin", overwrite)

    def topng(self, path: str, prefix: str = "image", overwrite: bool = False) -> None:
        from voxelframe.sources import sinks

        sinks.images(self, path, prefix, "png", overwrite)

    def totif(self, path: str, prefix: str = "image", overwrite: bool = False) -> None:
        from voxelframe.sources import sinks

        sinks.images(self, path, prefix, "tif", overwrite)

    def toparquet(self, path: str, overwrite: bool = False) -> None:
        from voxelframe.sources import sinks

        sinks.parquet(self, path, overwrite)
