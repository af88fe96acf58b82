"""What series and images have in common: a DataFrame of records, and what the driver knows of them.

A record is a row of key columns k0.., an optional label, and its value as one row-major array column. Built-in
operators are native array expressions or aggregates; callables run over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelframe.functions import exprs as X
from voxelframe.plans.meta import Meta, spark_type
from voxelframe.plans.tiles import strides
from voxelframe.session import keep, ship


def to_arrow(rows: np.ndarray, dtype) -> pa.Array:
    """Rows of equal length as a list array; dtypes that Spark lacks become the next wider one."""
    kind = {"uint8": "int16", "uint16": "int32", "uint32": "int64", "float16": "float32"}.get(np.dtype(dtype).name, np.dtype(dtype).name)
    rows = np.ascontiguousarray(np.asarray(rows).astype(dtype).astype(kind))
    n, m = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(rows.reshape(-1)))


def from_arrow(column, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The rows of `df` with their place k0 in the order of its partitions, and their number. The rows are written to
    shared storage first, so that places and rows come from one evaluation."""
    placed = keep(df.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moves = keep(sizes.withColumn("move", before - F.col("low")).select("part", "move", "n"), f"{name}-parts")  # a row a partition
    total = moves.agg(F.sum("n")).first()[0] or 0
    return placed.join(moves.select("part", "move"), "part").withColumn("k0", (F.col("at") + F.col("move")).cast("long")).drop("part", "at", "move"), int(total)


@dataclass
class Local:
    """A collection on the driver."""

    values: np.ndarray
    labels: np.ndarray | None
    meta: Meta
    kind: type

    @property
    def shape(self) -> tuple[int, ...]:
        return self.values.shape

    def tospark(self, spark: SparkSession, npartitions: int | None = None) -> ArrayFrame:
        base = self.values.shape[: len(self.meta.base)]
        keys = np.indices(base).reshape(len(base), -1)
        t = pa.table([pa.array(k.astype(np.int64)) for k in keys] + [to_arrow(self.values.reshape(prod(base), -1), self.values.dtype)], names=[*(f"k{i}" for i in range(len(base))), "values"])
        df = spark.createDataFrame(t)
        made = self.kind(df.repartition(npartitions) if npartitions else df, replace(self.meta, base=base, labelled=False))
        return made if self.labels is None else made.with_labels(self.labels)


class ArrayFrame:
    def __init__(self, df: DataFrame, meta: Meta):
        self.df, self.meta = df, meta

    # metadata

    @property
    def keys(self) -> list[str]:
        return [f"k{i}" for i in range(len(self.meta.base))]

    @property
    def shape(self) -> tuple[int, ...]:
        return self.meta.shape

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.meta.dtype)

    @property
    def base_shape(self) -> tuple[int, ...]:
        return self.meta.base

    @property
    def value_shape(self) -> tuple[int, ...]:
        return self.meta.value

    def __repr__(self) -> str:
        return f"{type(self).__name__}(shape={self.shape}, dtype={self.dtype.name})"

    def _new(self, values: Column, **meta) -> ArrayFrame:
        """The same records with other values."""
        m = replace(self.meta, **meta)
        label = ["label"] if m.labelled else []
        return type(self)(self.df.select(*self.keys, *label, values.cast(f"array<{spark_type(m.dtype)}>").alias("values")), m)

    @property
    def v(self) -> Column:
        return F.col("values")

    @property
    def d(self) -> Column:
        return X.doubles(F.col("values"))

    # labels

    def with_labels(self, labels: np.ndarray) -> ArrayFrame:
        labels = np.asarray(labels)
        if labels.shape != self.base_shape:
            raise ValueError(f"labels of shape {labels.shape} do not fit records of shape {self.base_shape}")
        spark = self.df.sparkSession
        rows = pa.table({k: c.reshape(-1) for k, c in zip(self.keys, np.indices(labels.shape), strict=True)} | {"label": labels.reshape(-1)})
        return type(self)(self.df.drop("label").join(spark.createDataFrame(rows), self.keys), replace(self.meta, labelled=True))

    def labels(self) -> np.ndarray | None:
        if not self.meta.labelled:
            return None
        rows = self.df.select(*self.keys, "label").toArrow()
        out = np.empty(self.base_shape, rows["label"].to_numpy().dtype)
        out[tuple(rows[k].to_numpy() for k in self.keys)] = rows["label"].to_numpy()
        return out

    # execution

    def cells(self) -> DataFrame:
        """A row for each element: keys, pos and value."""
        return self.df.select(*self.keys, F.posexplode("values").alias("pos", "value"))

    def toarray(self, squeeze: bool = True) -> np.ndarray:
        """All of it on the driver, in key order; axes of length one vanish."""
        rows = self.df.select(*self.keys, "values").toArrow()
        out = np.zeros((prod(self.base_shape), self.meta.size), self.dtype)
        at = sum((rows[k].to_numpy().astype(np.int64) * s for k, s in zip(self.keys, strides(self.base_shape), strict=True)), np.zeros(rows.num_rows, np.int64))
        if rows.num_rows:
            out[at] = from_arrow(rows["values"], self.meta.size)
        out = out.reshape(self.shape)
        return np.squeeze(out) if squeeze else out

    def todf(self) -> DataFrame:
        return self.df

    def first(self) -> np.ndarray:
        row = self.df.orderBy(*self.keys).select("values").limit(1).toArrow()
        return from_arrow(row["values"], self.meta.size).astype(self.dtype).reshape(self.value_shape)

    def count(self) -> int:
        return self.df.count()

    def compute(self) -> None:
        self.df.write.format("noop").mode("overwrite").save()

    def cache(self) -> ArrayFrame:
        self.df.persist()
        return self

    def uncache(self) -> ArrayFrame:
        self.df.unpersist()
        return self

    def iscached(self) -> bool:
        return self.df.is_cached

    def npartitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    def coalesce(self, n: int) -> ArrayFrame:
        if n > self.npartitions():
            raise ValueError(f"{n} is more than the {self.npartitions()} partitions")
        return type(self)(self.df.coalesce(n), self.meta)

    def repartition(self, n: int) -> ArrayFrame:
        return type(self)(self.df.repartition(n, *self.keys), self.meta)

    # per record

    def _batches(self, fn: Callable, value: tuple[int, ...], dtype, **meta) -> ArrayFrame:
        """fn takes keys (records × base axes) and values (records × value shape) of an Arrow batch to new values."""
        ship(self.df.sparkSession)
        m = replace(self.meta, value=tuple(value), dtype=np.dtype(dtype), **meta)
        old, keys = self.meta, self.keys
        label = ["label"] if m.labelled else []

        def run(batches):
            for b in batches:
                if b.num_rows:
                    k = np.stack([b.column(c).to_numpy() for c in keys], axis=1)
                    x = from_arrow(b.column("values"), old.size).astype(old.dtype).reshape(-1, *old.value)
                    y = np.asarray(fn(k, x)).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([b.column(c) for c in [*keys, *label]] + [to_arrow(y, m.dtype)], [*keys, *label, "values"])

        kept = self.df.select(*keys, *label, "values")
        schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"values array<{spark_type(dtype)}>"])
        return type(self)(kept.mapInArrow(run, schema), m)

    def map(self, fn: Callable, value_shape=None, dtype=None, with_keys: bool = False, index=None) -> ArrayFrame:
        """fn of each record's array, or of (key, array). Shape and dtype are taken from one record unless given."""
        if isinstance(value_shape, int):
            value_shape = (value_shape,)
        if value_shape is None or dtype is None:
            one = self.first()
            made = np.asarray(fn(((0,) * len(self.base_shape), one)) if with_keys else fn(one))
            value_shape, dtype = value_shape or made.shape or (1,), dtype or made.dtype
        apply = (lambda k, x: [fn((tuple(a.tolist()), b)) for a, b in zip(k, x, strict=True)]) if with_keys else (lambda k, x: [fn(b) for b in x])
        keep_index = index if index is not None else self.meta.index if tuple(value_shape) == self.value_shape else None
        return self._batches(apply, value_shape, dtype, index=None if keep_index is None else tuple(keep_index))

    def foreach(self, fn: Callable) -> None:
        """fn of (key, array), for what it does."""
        size, dtype, shape, keys = self.meta.size, self.dtype, self.value_shape, self.keys

        def run(batches):
            for b in batches:
                for k, x in zip(zip(*(b.column(c).to_pylist() for c in keys), strict=True), from_arrow(b.column("values"), size), strict=True):
                    fn((k, x.astype(dtype).reshape(shape)))
            yield from ()

        self.df.select(*keys, "values").mapInArrow(run, "done int").count()

    def filter(self, fn: Callable | None = None, where: Callable[[Column], Column] | None = None) -> ArrayFrame:
        """Records for which fn of the array holds, numbered anew in the order of their keys. A predicate on the value's
        Column, given as `where` instead, stays native."""
        if (fn is None) == (where is None):
            raise ValueError("one of fn and where is given")
        if where is not None:
            return self._renumber(self.df.where(where(self.v)))
        ship(self.df.sparkSession)
        size, dtype, shape = self.meta.size, self.dtype, self.value_shape

        def run(batches):
            for b in batches:
                if b.num_rows:
                    x = from_arrow(b.column("values"), size).astype(dtype).reshape(-1, *shape)
                    yield b.filter(pa.array([bool(fn(one)) for one in x], pa.bool_()))

        label = ["label"] if self.meta.labelled else []
        kept = self.df.select(*self.keys, *label, "values")
        return self._renumber(kept.mapInArrow(run, kept.schema))

    def _renumber(self, df: DataFrame) -> ArrayFrame:
        """Keys 0, 1, .. in the order of the old ones."""
        label = ["label"] if self.meta.labelled else []
        rows, total = numbered(df.orderBy(*self.keys), "renumber")
        return type(self)(rows.select("k0", *label, "values"), replace(self.meta, base=(total,)))

    def concatenate(self, *others: ArrayFrame) -> ArrayFrame:
        """These records and those of the others after them along the first axis; other axes agree."""
        every = [self, *others]
        if any(x.shape[1:] != self.shape[1:] or type(x) is not type(self) for x in others):
            raise ValueError(f"shapes {[x.shape for x in every]} cannot be joined along the first axis")
        dtype = np.result_type(*[x.dtype for x in every])
        labelled = all(x.meta.labelled for x in every)
        label, before, parts = ["label"] if labelled else [], 0, []
        for x in every:
            parts.append(x.df.select((F.col("k0") + before).alias("k0"), *x.keys[1:], *label, x.v.cast(f"array<{spark_type(dtype)}>").alias("values")))
            before += x.base_shape[0]
        return type(self)(reduce(DataFrame.unionByName, parts), replace(self.meta, base=(before, *self.base_shape[1:]), dtype=dtype, labelled=labelled))

    def tolocal(self) -> Local:
        """All of it on the driver, with index and labels; axes of length one stay."""
        return Local(self.toarray(squeeze=False), self.labels(), self.meta, type(self))

    def sample(self, n: int = 100, seed: int = 42) -> ArrayFrame:
        """n records without replacement, those of least hash."""
        if n < 1:
            raise ValueError(f"cannot sample {n} records")
        return self._renumber(self.df.orderBy(F.xxhash64(*self.keys, F.lit(seed)), *self.keys).limit(n))

    @property
    def mode(self) -> str:
        return "spark"

    @property
    def values(self) -> DataFrame:
        return self.df

    def clip(self, low=None, high=None) -> ArrayFrame:
        def one(x):
            y = F.greatest(x, F.lit(float(low))) if low is not None else x
            y = F.least(y, F.lit(float(high))) if high is not None else y
            return F.when(F.isnan(x), x).otherwise(y)

        if all(b is None or np.isscalar(b) for b in (low, high)):
            return self._new(F.transform(self.d, one))
        lo, hi = (None if b is None else np.broadcast_to(b, self.value_shape) for b in (low, high))
        return self._batches(lambda k, x: np.clip(x, lo, hi), self.value_shape, self.dtype)

    def astype(self, dtype, casting: str = "unsafe") -> ArrayFrame:
        dtype = np.dtype(dtype)
        if not np.can_cast(self.dtype, dtype, casting):
            raise TypeError(f"cannot cast {self.dtype} to {dtype} by the rule {casting!r}")
        if np.can_cast(self.dtype, dtype, "safe") and dtype.name != "float16":
            return self._new(self.v, dtype=dtype)
        return self._batches(lambda k, x: x.astype(dtype), self.value_shape, dtype)

    # two collections

    def element_wise(self, other, op: Callable) -> ArrayFrame:
        """op of two Columns, element by element; other is a collection of equal shape or a number."""
        if not isinstance(other, ArrayFrame):
            return self._new(F.transform(self.d, lambda x: op(x, F.lit(float(other)))), dtype=np.dtype("float64") if op in (_divide,) or not isinstance(other, int) else self.dtype)
        if self.shape != other.shape:
            raise ValueError(f"shapes {self.shape} and {other.shape} differ")
        dtype = np.dtype("float64") if op is _divide else np.result_type(self.dtype, other.dtype)
        exact = dtype.kind in "iu"
        kind = f"array<{spark_type(dtype)}>" if exact else "array<double>"
        both = self.df.join(other.df.select(*other.keys, F.col("values").alias("other")), self.keys)
        return type(self)(both, self.meta)._new(F.zip_with(self.v.cast(kind), F.col("other").cast(kind), op), dtype=dtype)

    def plus(self, other):
        return self.element_wise(other, _add)

    def minus(self, other):
        return self.element_wise(other, _subtract)

    def dottimes(self, other):
        return self.element_wise(other, _multiply)

    def dotdivide(self, other):
        return self.element_wise(other, _divide)

    # across records

    def _across(self, agg: Callable[[Column], Column], dtype, df: DataFrame | None = None) -> ArrayFrame:
        each = (df if df is not None else self.cells()).groupBy("pos").agg(agg(F.col("value")).alias("value"))
        one = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s.value).alias("values"))
        base = (1,) * len(self.base_shape)
        dtype = np.dtype(dtype)
        values = F.col("values").cast(f"array<{spark_type(dtype)}>")
        return type(self)(one.select(*[F.lit(0).cast("long").alias(k) for k in self.keys], values.alias("values")), Meta(base, self.value_shape, dtype))

    def _numbers(self) -> DataFrame:
        return self.cells().withColumn("value", F.col("value").cast("double"))

    def mean(self):
        return self._across(F.avg, "float64", self._numbers())

    def var(self):
        return self._across(F.var_pop, "float64", self._numbers())

    def std(self):
        return self._across(F.stddev_pop, "float64", self._numbers())

    def sum(self):
        return self._across(F.sum, "int64" if self.dtype.kind in "iub" else "float64", self.cells() if self.dtype.kind in "iu" else self._numbers())

    def max(self):
        return self._across(F.max, self.dtype)

    def min(self):
        if self.dtype.kind != "f":
            return self._across(F.min, self.dtype)
        return self._across(lambda x: F.when(F.max(F.isnan(x)), F.lit(float("nan"))).otherwise(F.min(x)), self.dtype)

    def reduce(self, fn: Callable) -> ArrayFrame:
        """Associative fn of two arrays: folds batches, then partitions, then the partitions' results."""
        ship(self.df.sparkSession)
        size, dtype, shape, n = self.meta.size, self.dtype, self.value_shape, len(self.keys)

        def fold(tables):
            acc = None
            for t in tables:
                for x in from_arrow(t.column("values"), size).astype(dtype).reshape(-1, *shape):
                    acc = x if acc is None else np.asarray(fn(acc, x))
            if acc is not None and acc.shape != shape:
                raise ValueError(f"reducing gave shape {acc.shape} from {shape}")
            return acc

        def run(batches):
            acc = fold(batches)
            if acc is not None:
                yield pa.RecordBatch.from_arrays([to_arrow(acc.reshape(1, -1), dtype)], ["values"])

        def last(t):
            return pa.table({f"k{i}": pa.array([0], pa.int64()) for i in range(n)} | {"values": to_arrow(fold([t]).reshape(1, -1), dtype)})

        kind = f"values array<{spark_type(dtype)}>"
        parts = self.df.select("values").mapInArrow(run, kind)
        while parts.rdd.getNumPartitions() > 64:
            parts = parts.coalesce(parts.rdd.getNumPartitions() // 8).mapInArrow(run, kind)
        out = parts.withColumn("whole", F.lit(True)).groupBy("whole").applyInArrow(last, ", ".join([f"k{i} long" for i in range(n)] + [kind]))
        return type(self)(out, Meta((1,) * n, shape, dtype))

    def _beside(self, one: ArrayFrame, name: str) -> DataFrame:
        """These records beside the single one of another collection: one row, as long as a record is."""
        return self.df.crossJoin(F.broadcast(one.df.select(F.col("values").alias(name))))

    # subscripts

    def __getitem__(self, item) -> ArrayFrame:
        """Slices, ints (which keep their axis) and lists along any axis, each axis on its own."""
        items = item if isinstance(item, tuple) else (item,)
        if Ellipsis in [i for i in items if i is Ellipsis]:
            at = next(k for k, i in enumerate(items) if i is Ellipsis)
            items = items[:at] + (slice(None),) * (len(self.shape) - len(items) + 1) + items[at + 1 :]
        if len(items) > len(self.shape):
            raise IndexError(f"{len(items)} subscripts for {len(self.shape)} axes")
        items += (slice(None),) * (len(self.shape) - len(items))
        taken = []
        for i, n in zip(items, self.shape, strict=True):
            if isinstance(i, slice):
                taken.append(range(*i.indices(n)))
            else:
                own = [int(x) for x in np.atleast_1d(np.flatnonzero(i) if np.asarray(i).dtype == bool else i)]
                if any(not -n <= x < n for x in own):
                    raise IndexError(f"{i} is outside of an axis of {n}")
                taken.append([x % n for x in own])
        base, value = taken[: len(self.base_shape)], taken[len(self.base_shape) :]
        df = self.df
        for k, own, n in zip(self.keys, base, self.base_shape, strict=True):
            if isinstance(own, range):
                if own != range(n):
                    key = F.col(k)
                    low, high = (own[0], own[-1]) if own.step > 0 and len(own) else (own[-1], own[0]) if len(own) else (0, -1)
                    df = df.where((key >= low) & (key <= high) & (F.pmod(key - (own[0] if len(own) else 0), F.lit(abs(own.step))) == 0))
                    df = df.withColumn(k, ((key - (own[0] if len(own) else 0)) / own.step).cast("long"))
            elif len(own) == 1:
                df = df.where(F.col(k) == own[0]).withColumn(k, F.lit(0).cast("long"))
            else:  # as many places as are given, also repeated ones
                at = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(own) - 1)), lambda i: F.when(F.get(X.places(own), i) == F.col(k), i.cast("long"))), F.isnotnull)
                df = df.where(F.col(k).isin(own)).withColumn(k, F.explode(at))
        out = type(self)(df, replace(self.meta, base=tuple(map(len, base)), index=None))
        shape = tuple(map(len, value))
        if shape == self.value_shape and all(isinstance(o, range) and o.step == 1 for o in value):
            return out
        if len(value) == 1:
            return out._new(X.gather(self.v, X.places(value[0])), value=shape)
        return out._new(X.gather_nd(self.v, self.value_shape, value), value=shape)


def _add(a, b):
    return a + b


def _subtract(a, b):
    return a - b


def _multiply(a, b):
    return a * b


def _divide(a, b):
    return X.safe_div(a.cast("double"), b.cast("double"))
