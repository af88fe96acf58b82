"""Files of a path, by Spark's own file systems (local, HDFS and object stores alike)."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_extension(path: str, ext: str | None) -> str:
    """The path itself if it has a wildcard or an extension, else all files of this extension in it."""
    if ext is None or "*" in path or os.path.splitext(path.rstrip("/"))[1]:
        return path
    both = "{tif,tiff}" if ext in ("tif", "tiff") else ext
    return f"{path.rstrip('/')}/*.{both}"


def files(spark: SparkSession, path: str, ext: str | None = None, start: int | None = None, stop: int | None = None, recursive: bool = False) -> DataFrame:
    """(path, content, file) of the matching files; file counts them in order of path."""
    reader = spark.read.format("binaryFile")
    if recursive:
        glob = f"*.{'{tif,tiff}' if ext in ('tif', 'tiff') else ext}" if ext else "*"
        reader, target = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob), path
    else:
        target = with_extension(path, ext)
    found = reader.load(target).select("path", "content")
    names = sorted(r.path for r in found.select("path").collect())  # the listing, not the content
    if start or stop:
        names = names[start or 0 : stop or None]
    if not names:
        raise FileNotFoundError(f"no files at {target}")
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "path string, file long")
    return found.join(order, "path")


def config(spark: SparkSession, path: str, name: str = "conf.json") -> dict:
    """The JSON object in a file beside the data; empty if there is none."""
    folder = path if not os.path.splitext(path)[1] and "*" not in path else os.path.dirname(path)
    try:
        row = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{name}").select("content").first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return json.loads(bytes(row.content)) if row else {}


def single(spark: SparkSession, path: str) -> bytes:
    """The bytes of the one file at a path."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.length("content").alias("n")).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} files at {path}")
    return bytes(spark.read.format("binaryFile").load(rows[0].path).select("content").first().content)
