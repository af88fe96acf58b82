"""Writing collections to files. Tasks write to storage that all executors share, under the final names."""

from __future__ import annotations

import json
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from voxelframe.functions import kernels as K
from voxelframe.operators.frame import from_arrow
from voxelframe.plans.tiles import strides
from voxelframe.session import ship


def open_folder(path: str, overwrite: bool) -> tuple[fs.FileSystem, str]:
    """An empty folder: made, or emptied if it may be overwritten."""
    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    kind = store.get_file_info(root).type
    if kind == fs.FileType.File:
        raise ValueError(f"{path} is a file")
    if kind == fs.FileType.Directory:
        if not overwrite:
            raise ValueError(f"{path} exists")
        store.delete_dir(root)
    store.create_dir(root, recursive=True)
    return store, root


def _put(store: fs.FileSystem, path: str, data: bytes) -> None:
    with store.open_output_stream(path) as out:
        out.write(data)


def _finish(store: fs.FileSystem, root: str, shape, dtype) -> None:
    _put(store, f"{root}/conf.json", json.dumps({"shape": list(shape), "dtype": np.dtype(dtype).name}, indent=2).encode())
    _put(store, f"{root}/SUCCESS", b"")


def series_binary(series, path: str, prefix: str = "series", overwrite: bool = False) -> None:
    """A file for each partition of the records in key order, named after its first key; shape and dtype beside them."""
    ship(series.df.sparkSession)
    store, root = open_folder(path, overwrite)
    size, dtype, keys = series.meta.size, series.dtype, series.keys
    digits = [max(5, len(str(n - 1))) for n in series.base_shape]  # readers take files in order of name

    def run(batches):
        name, parts = None, []
        for b in batches:
            if b.num_rows:
                name = name or "-".join(f"{b.column(k)[0].as_py():0{n}d}" for k, n in zip(keys, digits, strict=True))
                parts.append(from_arrow(b.column("values"), size).astype(dtype).tobytes())
        if name is not None:
            _put(store, f"{root}/{prefix}-{name}.bin", b"".join(parts))
        yield pa.RecordBatch.from_pydict({"done": pa.array([len(parts)], pa.int32())})

    n = max(1, min(prod(series.base_shape), series.npartitions()))
    series.df.select(*keys, "values").repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "done int").count()
    _finish(store, root, series.shape, dtype)


def _number(k: int) -> str:
    """Five digits; above 99,999 all digits after an underscore for each one more, as readers number images in order of
    name: 99999, _100000, __1000000."""
    return "_" * (len(str(k)) - 5) + f"{k:05d}"


def images(collection, path: str, prefix: str, ext: str, overwrite: bool = False) -> None:
    """A file for each image, as raw bytes, PNG or TIFF."""
    shape, dtype, size = collection.value_shape, collection.dtype, collection.meta.size
    if ext == "png" and not (len(shape) == 2 or len(shape) == 3 and shape[2] in (3, 4)) or ext == "tif" and len(shape) not in (2, 3):
        raise ValueError(f"no {ext} file holds an image of shape {shape}")
    ship(collection.df.sparkSession)
    store, root = open_folder(path, overwrite)
    encode = {"bin": lambda x: np.ascontiguousarray(x).tobytes(), "png": K.png_encode, "tif": K.tif_encode}[ext]

    def run(batches):
        for b in batches:
            x = from_arrow(b.column("values"), size).astype(dtype).reshape(-1, *shape)
            for k, one in zip(b.column("k0").to_pylist(), x, strict=True):
                _put(store, f"{root}/{prefix}-{_number(k)}.{ext}", encode(one))
            yield pa.RecordBatch.from_pydict({"done": pa.array([b.num_rows], pa.int32())})

    collection.df.select("k0", "values").mapInArrow(run, "done int").count()
    if ext == "bin":
        _finish(store, root, shape, dtype)


def parquet(collection, path: str, overwrite: bool = False) -> None:
    """Records as Parquet, and what the driver knows of them as one JSON row beside them."""
    mode = "overwrite" if overwrite else "errorifexists"
    m = collection.meta
    collection.df.write.mode(mode).parquet(f"{path.rstrip('/')}/records")
    about = json.dumps({"kind": type(collection).__name__, "base": m.base, "value": m.value, "dtype": np.dtype(m.dtype).name, "index": m.index, "labelled": m.labelled})
    collection.df.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode(mode).text(f"{path.rstrip('/')}/meta")


def flat_key(collection):
    return sum((F.col(k) * s for k, s in zip(collection.keys, strides(collection.base_shape), strict=True)), F.lit(0))
