"""Series: records of one-dimensional arrays with a common index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions import exprs as X
from voxelframe.operators.frame import ArrayFrame, from_arrow, to_arrow
from voxelframe.plans.meta import Meta, spark_type
from voxelframe.plans.tiles import strides
from voxelframe.session import ship, shuffle_partitions


class Series(ArrayFrame):
    @property
    def length(self) -> int:
        return self.meta.value[0]

    @property
    def index(self) -> list:
        return list(range(self.length)) if self.meta.index is None else list(self.meta.index)

    def with_index(self, index) -> Series:
        index = [tuple(i) if isinstance(i, (list, tuple, np.ndarray)) else i.item() if isinstance(i, np.generic) else i for i in (range(index) if isinstance(index, int) else index)]
        if len(index) != self.length:
            raise ValueError(f"an index of {len(index)} does not fit records of {self.length}")
        return Series(self.df, replace(self.meta, index=tuple(index)))

    def _made(self, values: Column, n: int, index=None, dtype="float64") -> Series:
        return self._new(values, value=(n,), index=None if index is None else tuple(index), dtype=np.dtype(dtype))

    # keys

    def flatten(self) -> Series:
        if len(self.base_shape) == 1:
            return self
        flat = sum((F.col(k) * s for k, s in zip(self.keys, strides(self.base_shape), strict=True)), F.lit(0))
        label = ["label"] if self.meta.labelled else []
        return Series(self.df.select(flat.cast("long").alias("k0"), *label, "values"), replace(self.meta, base=(prod(self.base_shape),)))

    def reshape(self, *shape: int) -> Series:
        shape = tuple(shape[0]) if len(shape) == 1 and not np.isscalar(shape[0]) else shape
        if prod(shape) != prod(self.shape):
            raise ValueError(f"{shape} has not as many elements as {self.shape}")
        if shape[-1] != self.length:
            raise ValueError("reshaping leaves the last axis as it is")
        flat = self.flatten()
        keys = [F.pmod(F.floor(F.col("k0") / s), F.lit(n)).cast("long").alias(f"k{i}") for i, (s, n) in enumerate(zip(strides(shape[:-1]), shape[:-1], strict=True))]
        label = ["label"] if self.meta.labelled else []
        return Series(flat.df.select(*keys, *label, "values"), replace(self.meta, base=shape[:-1]))

    # positions by index

    def _at(self, places: list[int]) -> Series:
        index = [self.index[p] for p in places]
        return self._made(X.gather(self.v, X.places(places)), len(places), index, self.dtype)

    def select(self, criterion) -> Series:
        """Positions by a value, a list of values, or a test of the index."""
        if callable(criterion):
            places = [p for p, i in enumerate(self.index) if criterion(i)]
        else:
            wanted = [tuple(c) if isinstance(c, list) else c for c in (criterion if isinstance(criterion, (list, np.ndarray)) else [criterion])]
            places = [p for p, i in enumerate(self.index) if i in wanted]
        if not places:
            raise ValueError("nothing in the index is selected")
        return self if len(places) == self.length else self._at(places)

    def between(self, left, right) -> Series:
        return self.select(lambda i: left <= i < right)

    def _groups(self, level) -> tuple[list, list[list[int]]]:
        """The combinations of index values at the levels that occur, sorted, and the positions of each."""
        levels = [level] if np.isscalar(level) else list(level)
        rows = [i if isinstance(i, tuple) else (i,) for i in self.index]
        if any(not 0 <= x < len(rows[0]) for x in levels):
            raise ValueError(f"the index has no level {level}")
        found: dict[tuple, list[int]] = {}
        for p, row in enumerate(rows):
            found.setdefault(tuple(row[x] for x in levels), []).append(p)
        keys = sorted(found)
        return [k[0] if len(levels) == 1 else k for k in keys], [found[k] for k in keys]

    def select_by_index(self, val, level=0, squeeze: bool = False, filter: bool = False, return_mask: bool = False):
        """Positions whose levels have one of the given values each."""
        levels = [level] if np.isscalar(level) else list(level)
        if len(levels) == 1:
            val = [val] if np.isscalar(val) or np.isscalar(val[0]) else val
        val = [[x] if np.isscalar(x) else list(x) for x in val]
        if len(levels) != len(val):
            raise ValueError("as many lists of values as levels are asked for")
        rows = [i if isinstance(i, tuple) else (i,) for i in self.index]
        self._groups(levels)
        wanted = set(product(*val))
        mask = np.array([(tuple(row[x] for x in levels) in wanted) != filter for row in rows])
        places = np.flatnonzero(mask).tolist()
        gone = {x for x, v in zip(levels, val, strict=True) if squeeze and not filter and len(v) == 1}
        left = [tuple(x for k, x in enumerate(rows[p]) if k not in gone) for p in places]
        out = self._at(places)
        size = len(rows[0]) - len(gone)
        index = None if size == 0 else tuple(i[0] if size == 1 else i for i in left)
        out = Series(out.df, replace(out.meta, index=index))
        return (out, mask) if return_mask else out

    def _by_group(self, level, fn: Callable[[Column], Column]) -> Series:
        index, groups = self._groups(level)
        values = X.let(lambda v: F.array(*[fn(F.transform(X.places(g), lambda p: F.get(v, p))) for g in groups]), self.d)
        return self._made(values, len(groups), index)

    def aggregate_by_index(self, fn: Callable, level=0) -> Series:
        """A number by fn of the array of each group's elements."""
        index, groups = self._groups(level)
        return self._batches(lambda k, x: [[fn(r[g]) for g in groups] for r in x], (len(groups),), "float64", index=tuple(index))

    def stat_by_index(self, stat: str, level=0) -> Series:
        known = {"sum": X.total, "mean": X.mean, "median": lambda v: X.percentile(v, 0.5), "stdev": X.std, "max": F.array_max, "min": X.smallest, "count": lambda v: F.size(v).cast("double")}
        return self._by_group(level, known[stat])

    def sum_by_index(self, level=0):
        return self.stat_by_index("sum", level)

    def mean_by_index(self, level=0):
        return self.stat_by_index("mean", level)

    def median_by_index(self, level=0):
        return self.stat_by_index("median", level)

    def std_by_index(self, level=0):
        return self.stat_by_index("stdev", level)

    def max_by_index(self, level=0):
        return self.stat_by_index("max", level)

    def min_by_index(self, level=0):
        return self.stat_by_index("min", level)

    def count_by_index(self, level=0):
        return self.stat_by_index("count", level)

    def _mean_of(self, starts: list[int], n: int) -> Series:
        """The mean of the stretches of n elements from each of the starts."""
        values = X.let(lambda v: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: X.total(F.transform(X.places(starts), lambda s: F.get(v, s + j))) / len(starts)), self.d)
        return self._made(values, n)

    def mean_by_panel(self, length: int) -> Series:
        if self.length % length or length == self.length:
            raise ValueError(f"panels of {length} do not divide {self.length}")
        return self._mean_of(list(range(0, self.length, length)), length)

    def mean_by_window(self, indices, window: int) -> Series:
        starts = [c - window // 2 for c in np.atleast_1d(indices).tolist()]
        if any(s < 0 or s + window > self.length for s in starts):
            raise ValueError(f"a window of {window} reaches over the ends")
        return self._mean_of(starts, window)

    def subsample(self, factor: int = 2) -> Series:
        if factor <= 0:
            raise ValueError("the factor is positive")
        return self._at(list(range(0, self.length, factor)))

    def downsample(self, factor: int = 2) -> Series:
        if factor <= 0:
            raise ValueError("the factor is positive")
        n = self.length // factor
        values = X.let(lambda v: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda g: X.total(F.slice(v, g * factor + 1, factor)) / factor), self.d)
        return self._made(values, n)

    # scaling

    def _scaled(self, axis: int, fn: Callable[[Column, Column, Column], Column]) -> Series:
        """fn of an element, and of the mean and standard deviation of its record (axis 1) or position (axis 0)."""
        if axis == 1:
            values = X.let(lambda v, m, s: F.transform(v, lambda x: fn(x, m, s)), self.d, X.mean(self.d), X.std(self.d))
            return self._made(values, self.length, self.meta.index)
        if axis != 0:
            raise ValueError("the axis is 0 or 1")
        both = self._numbers().groupBy("pos").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
        both = both.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))), lambda x: F.struct(x.m.alias("m"), x.s.alias("s"))).alias("stats"))
        beside = self.df.crossJoin(F.broadcast(both))  # one row of two numbers a position
        values = F.zip_with(self.d, F.col("stats"), lambda x, t: fn(x, t.m, t.s))
        return Series(beside, self.meta)._made(values, self.length, self.meta.index)

    def center(self, axis: int = 1) -> Series:
        return self._scaled(axis, lambda x, m, s: x - m)

    def standardize(self, axis: int = 1) -> Series:
        return self._scaled(axis, lambda x, m, s: X.safe_div(x, s))

    def zscore(self, axis: int = 1) -> Series:
        return self._scaled(axis, lambda x, m, s: X.safe_div(x - m, s))

    def squelch(self, threshold: float) -> Series:
        values = F.when(F.array_max(self.d) < threshold, F.transform(self.d, lambda x: F.lit(0.0))).otherwise(self.d)
        return self._made(values, self.length, self.meta.index, self.dtype)

    def correlate(self, signal) -> Series:
        signal = np.asarray(signal, float)
        if signal.ndim > 2:
            raise ValueError("signals are one- or two-dimensional")
        if signal.shape[-1] != self.length:
            raise ValueError(f"signals of {signal.shape[-1]} do not fit records of {self.length}")
        rows = np.atleast_2d(signal)
        return self._made(F.array(*[X.correlation(self.d, s) for s in rows]), len(rows), [1] if signal.ndim == 1 else None)

    def normalize(self, method: str = "percentile", window: int | None = None, perc: float = 20, offset: float = 0.1) -> Series:
        """(x - b) / (b + offset) for a baseline b."""
        if method in ("window", "window-exact") and window is None:
            raise ValueError("this baseline needs a window")
        if method in ("mean", "percentile"):
            base = X.mean(self.d) if method == "mean" else X.percentile(self.d, perc / 100)
            values = X.let(lambda v, b: F.transform(v, lambda x: X.safe_div(x - b, b + offset)), self.d, base)
        elif method in ("window", "window-exact"):
            base = (X.rank_baseline if method == "window" else X.exact_baseline)(self.d, window, perc)
            values = F.zip_with(self.d, base, lambda x, b: X.safe_div(x - b, b + offset))
        else:
            raise ValueError(f"no baseline is called {method}")
        return self._made(values, self.length, self.meta.index)

    def detrend(self, method: str = "linear", order: int = 5) -> Series:
        """Subtract the least-squares polynomial without its constant."""
        if method not in ("linear", "nonlinear"):
            raise ValueError(f"no trend is called {method}")
        k = 1 if method == "linear" else order
        t = np.vander(np.arange(self.length, dtype=float), k + 1, increasing=True)
        solve, powers = np.linalg.pinv(t)[1:], t[:, 1:]
        values = X.let(lambda v, c: F.zip_with(v, X.literal(powers), lambda x, p: x - X.dot(c, p)), self.d, F.array(*[X.dot(self.d, X.literal(r)) for r in solve]))
        return self._made(values, self.length, self.meta.index)

    # signals

    def fourier(self, freq: int) -> Series:
        """Coherence and phase of one frequency of the mean-free record. The power of all frequencies below half the
        length follows from the sum of squares (Parseval) less the highest one's."""
        n = self.length
        half = n // 2
        if not 0 <= freq < half:
            raise ValueError(f"frequencies of {n} positions are 0 to {half - 1}")
        t = 2 * np.pi * np.arange(n) / n

        def body(y):
            part = lambda f: (X.dot(y, X.literal(np.cos(f * t))), X.dot(y, X.literal(-np.sin(f * t))))
            (re, im), (hr, hi) = part(freq), part(half)
            top = hr * hr + hi * hi
            power = (X.dot(y, y) * n - (top if n % 2 == 0 else 2 * top)) / 2
            phase = -np.pi / 2 - F.atan2(im, re)
            return F.array(X.safe_div(F.sqrt(re * re + im * im), F.sqrt(power)), F.when(phase < 0, phase + 2 * np.pi).otherwise(phase))

        values = X.let(lambda v, m: X.let(body, F.transform(v, lambda x: x - m)), self.d, X.mean(self.d))
        return self._made(values, 2, ["coherence", "phase"])

    def convolve(self, signal, mode: str = "full") -> Series:
        s = np.asarray(signal, float)
        n, m = self.length, len(s)
        size = {"full": n + m - 1, "same": max(n, m), "valid": max(n, m) - min(n, m) + 1}[mode]
        return self._made(X.convolution(self.d, n, s, mode), size)

    def crosscorr(self, signal, lag: int = 0) -> Series:
        """Correlation with a signal that is shifted by up to lag positions either way, zeros beyond its ends."""
        s = np.asarray(signal, float)
        if len(s) != self.length:
            raise ValueError(f"a signal of {len(s)} does not fit records of {self.length}")
        s = s - s.mean()
        s = s / np.linalg.norm(s)
        shifts = list(range(-lag, lag + 1))
        rows = np.zeros((len(shifts), len(s)))
        for r, k in zip(rows, shifts, strict=True):
            r[max(0, k) : len(s) + min(0, k)] = s[max(0, -k) : len(s) - max(0, k)]

        def shifted(y):  # of the record less its mean, bound once for all shifts
            return X.let(lambda y, q: F.transform(X.literal(rows), lambda r: F.when(q == 0, F.lit(0.0)).otherwise(X.safe_div(X.dot(y, r), F.sqrt(q)))), y, X.dot(y, y))

        values = X.let(lambda v, m: X.let(shifted, F.transform(v, lambda x: x - m)), self.d, X.mean(self.d))
        return self._made(values, len(shifts), shifts)

    # matrices

    def times(self, other) -> Series:
        """Right product with a matrix, a vector or a number."""
        if isinstance(other, ArrayFrame):
            raise NotImplementedError("the right factor is on the driver")
        if np.isscalar(other):
            return self._made(F.transform(self.d, lambda x: x * float(other)), self.length, self.meta.index)
        m = np.asarray(other, float)
        m = m[:, None] if m.ndim == 1 else m
        if m.shape[0] != self.length:
            raise ValueError(f"a matrix of {m.shape} does not fit records of {self.length}")
        return self._batches(lambda k, x: x.astype(float) @ m, (m.shape[1],), "float64", index=None)

    def gramian(self) -> Series:
        """The records' matrix, transposed, times itself: partitions' products, added up by cell."""
        ship(self.df.sparkSession)
        n = self.length

        def partial(batches):
            acc = np.zeros((n, n))
            for b in batches:
                x = from_arrow(b.column("values"), n).astype(float)
                acc += x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), n)), pa.array(acc.reshape(-1))], ["k0", "pos", "value"])

        cells = self.df.select("values").mapInArrow(partial, "k0 long, pos int, value double").groupBy("k0", "pos").agg(F.sum("value").alias("value"))
        rows = cells.groupBy("k0").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s.value).alias("values"))
        return Series(rows, Meta((n,), (n,), np.dtype("float64"), self.meta.index))

    def cov(self) -> Series:
        n = prod(self.base_shape)
        return self.center(axis=0).gramian().times(1.0 / (n - 1))

    # other types

    def toimages(self):
        from voxelframe.operators.images import Images

        ship(self.df.sparkSession)
        dims, n, keys, dtype, kind = self.base_shape, self.length, self.keys, self.dtype, spark_type(self.dtype)
        size, step = prod(dims), strides(self.base_shape)
        # Images are put together some at a time: as many bytes as give each shuffle partition some, 100 MB at most.
        some = max(1, int(min(1e8, size * n * dtype.itemsize / shuffle_partitions(self.df.sparkSession)) / (size * dtype.itemsize)))

        def cut(batches):  # a row for each batch of records and run of images
            for b in batches:
                if b.num_rows:
                    x = from_arrow(b.column("values"), n)
                    px = sum(b.column(k).to_numpy() * s for k, s in zip(keys, step, strict=True))
                    for first in range(0, n, some):
                        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([px], pa.list_(pa.int64())), to_arrow(x[:, first : first + some].reshape(1, -1), dtype)], ["first", "px", "piece"])

        def place(key, t):
            first = key[0].as_py()
            out = np.zeros((min(some, n - first), size), dtype)
            for px, piece in zip(t["px"], t["piece"], strict=True):
                px = px.values.to_numpy()
                out[:, px] = piece.values.to_numpy(zero_copy_only=False).reshape(len(px), -1).T
            return pa.table({"k0": np.arange(first, first + len(out)), "values": to_arrow(out, dtype)})

        pieces = self.df.select(*keys, "values").mapInArrow(cut, f"first long, px array<long>, piece array<{kind}>")
        return Images(pieces.groupBy("first").applyInArrow(place, f"k0 long, values array<{kind}>"), Meta((n,), dims, dtype))

    def tobinary(self, path: str, prefix: str = "series", overwrite: bool = False) -> None:
        from voxelframe.sources import sinks

        sinks.series_binary(self, path, prefix, overwrite)

    def toparquet(self, path: str, overwrite: bool = False) -> None:
        from voxelframe.sources import sinks

        sinks.parquet(self, path, overwrite)


def of_cells(cells: DataFrame, base: tuple[int, ...], length: int, dtype="float64") -> Series:
    """Records from a row for each element (k0.., pos, value); elements that have no row are zero."""
    keys = [f"k{i}" for i in range(len(base))]
    at = F.map_from_entries(F.collect_list(F.struct("pos", "value")))
    rows = cells.groupBy(*keys).agg(at.alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0)))
    return Series(rows.select(*keys, values.alias("values")), Meta(base, (length,), np.dtype(dtype)))
