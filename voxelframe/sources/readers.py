"""Making collections: from arrays, lists, DataFrames, random numbers and files."""

from __future__ import annotations

import json
from collections.abc import Callable
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelframe.functions import kernels as K
from voxelframe.operators.frame import numbered, to_arrow
from voxelframe.operators.images import Images
from voxelframe.operators.series import Series
from voxelframe.plans.meta import Meta, spark_type
from voxelframe.session import keep, ship
from voxelframe.sources import listing


def _finished(made, index=None, labels=None):
    made = made.with_index(index) if index is not None else made
    return made.with_labels(labels) if labels is not None else made


def from_dataframe(df: DataFrame, kind: str, keys: list[str], values: str, base: tuple[int, ...] | None = None, value: tuple[int, ...] | None = None, dtype="float64", label: str | None = None, index=None):
    """Records of a table: key columns and an array column. Shapes that aren't given are found by one aggregate."""
    if base is None or value is None:
        row = df.agg(*[(F.max(k) + 1).alias(f"k{i}") for i, k in enumerate(keys)], F.max(F.size(values)).alias("n")).first()
        base = base or tuple(int(row[f"k{i}"]) for i in range(len(keys)))
        value = value or (int(row.n),)
    columns = [F.col(k).cast("long").alias(f"k{i}") for i, k in enumerate(keys)] + ([F.col(label).alias("label")] if label else [])
    rows = df.select(*columns, F.col(values).cast(f"array<{spark_type(dtype)}>").alias("values"))
    meta = Meta(tuple(base), tuple(value), np.dtype(dtype), None, bool(label))
    return _finished(Series(rows, meta), index) if kind == "series" else Images(rows, meta)


def _array(spark: SparkSession, kind, a: np.ndarray, base: tuple[int, ...], value: tuple[int, ...], npartitions: int | None):
    keys = np.indices(base).reshape(len(base), -1)
    t = pa.table([pa.array(k.astype(np.int64)) for k in keys] + [to_arrow(a.reshape(prod(base), prod(value)), a.dtype)], names=[*(f"k{i}" for i in range(len(base))), "values"])
    df = spark.createDataFrame(t)
    return kind(df.repartition(npartitions) if npartitions else df, Meta(base, value, a.dtype))


def series_from_array(spark: SparkSession, values, index=None, labels=None, npartitions: int | None = None) -> Series:
    a = np.asarray(values)
    a = a[None, :] if a.ndim == 1 else a
    return _finished(_array(spark, Series, a, a.shape[:-1], a.shape[-1:], npartitions), index, labels)


def images_from_array(spark: SparkSession, values, labels=None, npartitions: int | None = None) -> Images:
    if isinstance(values, (list, tuple)):
        if len({(np.asarray(v).shape, np.asarray(v).dtype) for v in values}) > 1:
            raise ValueError("images differ in shape or dtype")
    a = np.asarray(values)
    if a.ndim < 2:
        raise ValueError("images have two or three dimensions")
    a = a[None] if a.ndim == 2 else a
    return _finished(_array(spark, Images, a, a.shape[:1], a.shape[1:], npartitions), labels=labels)


def _stacked(spark: SparkSession, items: list, kind, npartitions: int | None, dims=None, dtype=None):
    a = np.stack([np.asarray(i, dtype) for i in items])
    if dims is not None and a.shape[1:] != tuple(dims):
        raise ValueError(f"items of shape {a.shape[1:]} are not of shape {dims}")
    return _array(spark, kind, a, a.shape[:1], a.shape[1:], npartitions)


def _accessed(spark: SparkSession, items: list, accessor: Callable, kind, npartitions: int | None, dims=None, dtype=None):
    from pyspark import cloudpickle

    ship(spark)
    if dims is None or dtype is None:
        one = np.asarray(accessor(items[0]))
        dims, dtype = dims or one.shape, dtype or one.dtype
    dims, dtype = tuple(dims), np.dtype(dtype)
    rows = spark.createDataFrame([(i, cloudpickle.dumps(x)) for i, x in enumerate(items)], "k0 long, item binary")

    def run(batches):
        for b in batches:
            made = [np.asarray(accessor(cloudpickle.loads(x))).astype(dtype).reshape(-1) for x in b.column("item").to_pylist()]
            if made:
                yield pa.RecordBatch.from_arrays([b.column("k0"), to_arrow(np.stack(made), dtype)], ["k0", "values"])

    made = rows.repartition(npartitions or min(len(items), spark.sparkContext.defaultParallelism)).mapInArrow(run, f"k0 long, values array<{spark_type(dtype)}>")
    return kind(made, Meta((len(items),), dims, dtype))


def series_from_list(spark: SparkSession, items: list, accessor: Callable | None = None, index=None, labels=None, npartitions: int | None = None) -> Series:
    made = _accessed(spark, items, accessor, Series, npartitions) if accessor else _stacked(spark, items, Series, npartitions)
    return _finished(made, index, labels)


def images_from_list(spark: SparkSession, items: list, accessor: Callable | None = None, keys=None, dims=None, dtype=None, labels=None, npartitions: int | None = None) -> Images:
    """An image of each item, in the order of `keys` if there are any. dims and dtype are those of the first one unless
    given."""
    if keys is not None:
        flat = [k[0] if isinstance(k, tuple) else k for k in keys]
        if len(flat) != len(items) or len(set(flat)) != len(flat):
            raise ValueError("as many different keys as items are asked for")
        items = [items[i] for i in np.argsort(flat, kind="stable")]
    made = _accessed(spark, items, accessor, Images, npartitions, dims, dtype) if accessor else _stacked(spark, items, Images, npartitions, dims, dtype)
    return _finished(made, labels=labels)


def from_rdd(spark: SparkSession, rdd, kind: str, shape=None, dtype=None, index=None, labels=None):
    """Records of an RDD of (key, array); a key is an int or a tuple of ints. Shapes that aren't given are found by one
    aggregate, the dtype and the values' shape of images from the first record."""
    key, one = rdd.first()
    n, one = len(key) if isinstance(key, tuple) else 1, np.asarray(one)
    dtype = np.dtype(dtype or one.dtype)
    number = int if dtype.kind in "iu" else bool if dtype.kind == "b" else float
    keys = [f"k{i}" for i in range(n)]
    rows = rdd.map(lambda kv: (*(int(k) for k in (kv[0] if isinstance(kv[0], tuple) else (kv[0],))), [number(x) for x in np.asarray(kv[1]).reshape(-1)]))
    df = spark.createDataFrame(rows, ", ".join([f"{k} long" for k in keys] + [f"values array<{spark_type(dtype)}>"]))
    base = None if shape is None else tuple(shape)[:n]
    made = from_dataframe(df, kind, keys, "values", base, one.shape, dtype, index=index)
    return made.with_labels(labels) if labels is not None else made


def _random(spark: SparkSession, kind, shape: tuple[int, ...], seed: int, npartitions: int):
    """Record i is the standard normal draw of the generator seeded with seed + i."""
    ship(spark)
    value = tuple(shape[1:])

    def run(batches):
        for b in batches:
            x = [np.random.RandomState((seed + i) % 2**32).randn(prod(value)) for i in b.column("k0").to_pylist()]
            if x:
                yield pa.RecordBatch.from_arrays([b.column("k0"), to_arrow(np.stack(x), "float64")], ["k0", "values"])

    rows = spark.range(0, shape[0], 1, npartitions).withColumnRenamed("id", "k0").mapInArrow(run, "k0 long, values array<double>")
    return kind(rows, Meta((shape[0],), value, np.dtype("float64")))


def series_from_random(spark: SparkSession, shape=(100, 10), npartitions: int = 1, seed: int = 42) -> Series:
    return _random(spark, Series, tuple(shape), hash(seed), npartitions)


def images_from_random(spark: SparkSession, shape=(10, 50, 50), npartitions: int = 1, seed: int = 42) -> Images:
    return _random(spark, Images, tuple(shape), seed, npartitions)


EXAMPLES = {"series": ("waves", "steps"), "images": ("waves", "steps")}


def from_example(spark: SparkSession, kind: str, name: str | None = None):
    """Small synthetic collections; without a name, the list of names."""
    if name is None:
        return list(EXAMPLES[kind])
    if name not in EXAMPLES[kind]:
        raise ValueError(f"examples are {EXAMPLES[kind]}, not {name!r}")
    t = np.linspace(0, 4 * np.pi, 240)
    row = np.sin(t) if name == "waves" else np.floor(t)
    if kind == "series":
        return series_from_array(spark, np.stack([row * (k + 1) for k in range(20)]))
    return images_from_array(spark, np.stack([np.outer(row[:24], row[:24]) + k for k in range(20)]))


def series_from_text(spark: SparkSession, path: str, ext: str = "txt", dtype="float64", skip: int = 0, shape=None, index=None, labels=None) -> Series:
    """A record for each line of numbers between white space, after `skip` leading ones; files in order of path. Files are
    read in splits: a line's place is its split's, by path and offset, and its place there."""
    lines = spark.read.text(listing.with_extension(path, ext)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    numbers = F.transform(F.slice(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+"), skip + 1, 1 << 30), lambda x: x.cast("double"))
    # Lines of a split follow each other in one partition.
    rows = keep(lines.where(r"value rlike '\\S'").withColumn("at", F.monotonically_increasing_id()).select("file", "block", "at", numbers.alias("values")), "text")
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max(F.size("values")).alias("width"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = keep(splits.select("file", "block", "n", "width", (before - F.col("low")).alias("move")), "splits")  # a small row a split
    total, n = splits.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("width"), F.lit(0))).first()
    flat = rows.join(splits.select("file", "block", "move"), ["file", "block"]).select((F.col("at") + F.col("move")).cast("long").alias("k0"), F.col("values").cast(f"array<{spark_type(dtype)}>").alias("values"))
    made = Series(flat, Meta((total,), (n,), np.dtype(dtype)))
    return _finished(made.reshape(*shape) if shape is not None else made, index, labels)


def series_from_binary(spark: SparkSession, path: str, ext: str = "bin", conf: str = "conf.json", dtype=None, shape=None, skip: int = 0, index=None, labels=None) -> Series:
    """Records of fixed size, in splits of whole records; arguments come before what the configuration says."""
    about = listing.config(spark, path, conf)
    shape, dtype = tuple(shape or about.get("shape") or ()), dtype or about.get("dtype")
    if not shape or dtype is None:
        raise ValueError("shape and dtype are neither given nor configured")
    ship(spark)
    dtype, n, base = np.dtype(dtype), shape[-1] + skip, shape[:-1]
    record, target = n * dtype.itemsize, listing.with_extension(path, ext)
    size = spark.read.format("binaryFile").load(target).agg(F.sum("length")).first()[0] or 0  # of the listing, not the content
    if size != record * prod(base):
        raise ValueError(f"{size} bytes do not have the shape {shape}")
    records = spark.sparkContext._jsc.binaryRecords(target, record).rdd()
    df = DataFrame(spark._jsparkSession.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype).reshape(-1, n)[:, skip:]
                yield pa.RecordBatch.from_arrays([to_arrow(x, dtype)], ["values"])

    rows, total = numbered(df.mapInArrow(run, f"values array<{spark_type(dtype)}>"), "records")
    flat = Series(rows.select("k0", "values"), Meta((total,), shape[-1:], dtype))
    return _finished(flat.reshape(*shape) if len(base) > 1 else flat, index, labels)


def images_from_path(spark: SparkSession, path: str, accessor: Callable, ext: str | None = None, start=None, stop=None, recursive: bool = False, npartitions: int | None = None, dims=None, dtype=None, labels=None) -> Images:
    """accessor turns (file number, bytes) into a list of arrays; images are numbered in order of file and place."""
    ship(spark)
    found = listing.files(spark, path, ext, start, stop, recursive).select("file", "content")
    if npartitions:
        found = found.repartition(npartitions, "file")
    if dims is None or dtype is None:
        row = found.orderBy("file").first()
        one = np.asarray(accessor(row.file, bytes(row.content))[0])
        dims, dtype = tuple(dims or one.shape), np.dtype(dtype or one.dtype)
    dtype, dims = np.dtype(dtype), tuple(dims)

    def run(batches):
        for b in batches:
            for f, data in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                made = accessor(f, data)
                if len(made):
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(made)), pa.array(np.arange(len(made))), to_arrow(np.stack([np.asarray(x).reshape(-1) for x in made]), dtype)], ["file", "at", "values"])

    rows = keep(found.mapInArrow(run, f"file long, at long, values array<{spark_type(dtype)}>"), "images")
    counts = {r.file: r.n for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()}  # a row for each file
    order = sorted(counts)
    before = spark.createDataFrame(list(zip(order, np.cumsum([0, *(counts[f] for f in order)]).tolist(), strict=False)), "file long, before long")
    rows = rows.join(before, "file").select((F.col("before") + F.col("at")).alias("k0"), "values")
    return _finished(Images(rows, Meta((sum(counts.values()),), dims, dtype)), labels=labels)


def images_from_binary(spark: SparkSession, path: str, shape=None, dtype=None, ext: str = "bin", start=None, stop=None, recursive: bool = False, nplanes: int | None = None, npartitions=None, labels=None, conf: str = "conf.json", order: str = "C") -> Images:
    """An image in each file; what the configuration says comes before arguments. nplanes cuts the last axis."""
    about = listing.config(spark, path, conf)
    shape = tuple(about.get("dims") or about.get("shape") or shape or ())
    dtype = np.dtype(about.get("dtype") or dtype or "int16")
    if not shape:
        raise ValueError("the shape is neither given nor configured")
    if nplanes is not None and (nplanes < 1 or shape[-1] % nplanes):
        raise ValueError(f"{nplanes} planes do not divide {shape[-1]}")

    def accessor(_, data):
        x = np.frombuffer(data, dtype, prod(shape)).reshape(shape, order=order)
        if nplanes is None:
            return [x]
        parts = np.split(x, shape[-1] // nplanes, axis=-1)
        return [p[..., 0] if nplanes == 1 else p for p in parts]

    dims = shape if nplanes is None else shape[:-1] + ((nplanes,) if nplanes > 1 else ())
    return images_from_path(spark, path, accessor, ext, start, stop, recursive, npartitions, dims, dtype, labels)


def images_from_tif(spark: SparkSession, path: str, ext: str = "tif", start=None, stop=None, recursive: bool = False, nplanes: int | None = None, npartitions=None, labels=None, discard_extra: bool = False) -> Images:
    """A file's pages are one image, or several of nplanes pages; a remainder is an error unless it is discarded."""

    def accessor(_, data):
        x = K.tif_decode(data)
        if nplanes is None:
            return [x[0] if len(x) == 1 else x]
        extra = len(x) % nplanes
        if extra and not discard_extra:
            raise ValueError(f"{nplanes} planes do not divide {len(x)} pages")
        x = x[: len(x) - extra]
        return [x[k] if nplanes == 1 else x[k : k + nplanes] for k in range(0, len(x), nplanes)]

    return images_from_path(spark, path, accessor, ext, start, stop, recursive, npartitions, labels=labels)


def images_from_png(spark: SparkSession, path: str, ext: str = "png", start=None, stop=None, recursive: bool = False, npartitions=None, labels=None) -> Images:
    return images_from_path(spark, path, lambda _, data: [K.png_decode(data)], ext, start, stop, recursive, npartitions, labels=labels)


def from_parquet(spark: SparkSession, path: str):
    """A collection written by toparquet."""
    about = json.loads(spark.read.text(f"{path.rstrip('/')}/meta").first().value)
    index = None if about["index"] is None else tuple(tuple(i) if isinstance(i, list) else i for i in about["index"])
    meta = Meta(tuple(about["base"]), tuple(about["value"]), np.dtype(about["dtype"]), index, about["labelled"])
    return {"Series": Series, "Images": Images}[about["kind"]](spark.read.parquet(f"{path.rstrip('/')}/records"), meta)

