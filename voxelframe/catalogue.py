"""The array operators as queries over the test tables, each with DuckDB SQL of equal results.

Results are long: keys k0.. (bigint), pos (int) within the record, and value, rounded to 6 places on both sides because
sums of doubles depend on their order. Datasets: E, the embeddings as records of 64 numbers; I and V, the same as 8 × 8
images and 4 × 4 × 4 volumes; U, events' values summed by user and day, 30 days; M, lineitem's prices by supplier and
month, 83 months.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.operators.images import Images
from voxelframe.operators.series import Series, of_cells
from voxelframe.session import scratch, table
from voxelframe.sources import listing, objects, readers

DAYS, MONTHS, N = 30, 83, 64
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SIGNAL = [round(float(np.sin(t / 3) + 0.05 * t), 4) for t in range(N)]
SIGNAL2 = [round(float(np.cos(t / 5)), 4) for t in range(N)]
KERNEL = [0.5, 1.0, -0.25, 2.0, 0.75]
MATRIX = [[round(float(np.sin(i * (j + 1))), 4) for j in range(3)] for i in range(N)]
PICTURE = [round(float(np.cos(p)), 4) for p in range(N)]


def E(s: SparkSession, d: str) -> Series:
    return readers.from_dataframe(table(s, d, "embeddings"), "series", ["vec_id"], "embedding", label="label")


def I(s: SparkSession, d: str) -> Images:  # noqa: E743
    return readers.from_dataframe(table(s, d, "embeddings"), "images", ["vec_id"], "embedding", value=(8, 8))


def V(s: SparkSession, d: str) -> Images:
    return readers.from_dataframe(table(s, d, "embeddings"), "images", ["vec_id"], "embedding", value=(4, 4, 4))


def U(s: SparkSession, d: str) -> Series:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    events = table(s, d, "events").select(F.col("user_id").alias("k0"), day.alias("pos"), "value")
    cells = events.groupBy("k0", "pos").agg(F.sum("value").alias("value"))
    return of_cells(cells, (_within(events, DAYS),), DAYS).with_index([(p // 7, p % 7) for p in range(DAYS)])


def M(s: SparkSession, d: str) -> Series:
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    items = table(s, d, "lineitem").select(F.col("l_suppkey").alias("k0"), month.alias("pos"), F.col("l_extendedprice").alias("value"))
    cells = items.groupBy("k0", "pos").agg(F.sum("value").alias("value"))
    return of_cells(cells, (_within(items, MONTHS),), MONTHS)


def _within(cells: DataFrame, n: int) -> int:
    """The number of records; no row lies outside of the n positions."""
    low, high, last = cells.agg(F.min("pos"), F.max("pos"), F.max("k0")).first()
    if low is not None and (low < 0 or high >= n):
        raise ValueError(f"rows at positions {low} to {high} of {n}")
    return 0 if last is None else int(last) + 1


def long(frame) -> DataFrame:
    keys = [F.col(k).cast("bigint").alias(k) for k in frame.keys]
    return frame.cells().select(*keys, F.col("pos").cast("int").alias("pos"), (F.round(F.col("value").cast("double"), 6) + 0.0).alias("value"))


CTE = f"""WITH e AS (
  SELECT CAST(vec_id AS BIGINT) AS k0, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings
), u AS (
  SELECT k0, pos, coalesce(value, 0.0) AS value
  FROM (SELECT DISTINCT CAST(user_id AS BIGINT) AS k0 FROM events) CROSS JOIN (SELECT CAST(unnest(range({DAYS})) AS INTEGER) AS pos)
  LEFT JOIN (SELECT user_id AS k0, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS pos, sum(value) AS value FROM events GROUP BY ALL) USING (k0, pos)
), m AS (
  SELECT k0, pos, coalesce(value, 0.0) AS value
  FROM (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS k0 FROM lineitem) CROSS JOIN (SELECT CAST(unnest(range({MONTHS})) AS INTEGER) AS pos)
  LEFT JOIN (SELECT l_suppkey AS k0, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS pos, sum(l_extendedprice) AS value FROM lineitem GROUP BY ALL) USING (k0, pos)
)"""


def r(x: str) -> str:
    return f"ROUND({x}, 6) + 0.0 AS value"


def add(name: str, make, body: str | None = None, more: str = "") -> None:
    """A query that makes a collection (or a DataFrame), and SQL from the datasets above and further CTEs."""

    def run(s: SparkSession, d: str) -> DataFrame:
        made = make(s, d)
        return made if isinstance(made, DataFrame) else long(made)

    _QUERIES[name] = run
    if body is not None:
        _SQL[name] = f"{CTE}{more} {body}"


def cell(expr: str, source: str = "e") -> str:
    return f"SELECT k0, pos, {r(expr)} FROM {source}"


def lst(x) -> str:
    return f"[{', '.join(f'CAST({float(v)!r} AS DOUBLE)' for v in x)}]"


LISTS = ", rec AS (SELECT k0, list(value ORDER BY pos) AS v FROM e GROUP BY k0)"
NUMBERED = "CAST(vec_id AS BIGINT)"
REVERSED = "SELECT a.k0, a.pos, {} FROM e a JOIN e b ON a.k0 = b.k0 AND b.pos = 63 - a.pos"

# Sources and sinks.
add("scan_series", E, cell("value"))
add("scan_images", I, cell("value"))
add("dense_series_events", U, cell("value", "u"))
add("dense_series_lineitem", M, cell("value", "m"))


def _there_and_back(write, read):
    def run(s, d):
        path = scratch(s, "files")
        write(s, d, path)
        return read(s, path)

    return run


def _write_text(s, d, path):
    E(s, d).df.repartitionByRange(4, "k0").sortWithinPartitions("k0").select(F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias("line")).write.text(path)


def _bytes(s, d) -> Images:
    """Images as unsigned bytes."""
    return I(s, d)._new(F.transform("values", lambda x: F.floor(F.abs(x) * 20) % 256), dtype=np.dtype("uint8"))


BYTES = "CAST(CAST(floor(abs(value) * 20) AS BIGINT) % 256 AS DOUBLE)"
add("text_roundtrip", _there_and_back(_write_text, lambda s, p: readers.series_from_text(s, p)), cell("value"))
add("binary_roundtrip", _there_and_back(lambda s, d, p: E(s, d).tobinary(p), lambda s, p: readers.series_from_binary(s, p)), cell("value"))
add("images_binary_roundtrip", _there_and_back(lambda s, d, p: I(s, d).tobinary(p), lambda s, p: readers.images_from_binary(s, p, shape=(8, 8), conf="none.json", dtype="float64")), cell("value"))
add("png_roundtrip", _there_and_back(lambda s, d, p: _bytes(s, d).topng(p), lambda s, p: readers.images_from_png(s, p)), cell(BYTES))
add("tif_roundtrip", _there_and_back(lambda s, d, p: V(s, d).totif(p), lambda s, p: readers.images_from_tif(s, p)), cell("value"))
add("tif_planes", _there_and_back(lambda s, d, p: V(s, d).totif(p), lambda s, p: readers.images_from_tif(s, p, nplanes=2)), f"SELECT 2 * k0 + pos // 32 AS k0, CAST(pos % 32 AS INTEGER) AS pos, {r('value')} FROM e")
add("parquet_roundtrip", _there_and_back(lambda s, d, p: U(s, d).toparquet(p), readers.from_parquet), cell("value", "u"))
add("series_random", lambda s, d: readers.series_from_random(s, (100, 10), 4))
add("images_random", lambda s, d: readers.images_from_random(s, (10, 5, 5), 4))



def _local(kind):
    """Through an array on the driver, which is what these sources take."""
    return {
        "array": lambda s, x: readers.series_from_array(s, x.toarray(squeeze=False), npartitions=3),
        "images": lambda s, x: readers.images_from_array(s, x.toarray(squeeze=False), npartitions=3),
        "list": lambda s, x: readers.series_from_list(s, list(x.toarray(squeeze=False))),
        "keyed": lambda s, x: readers.images_from_list(s, list(x.toarray(squeeze=False)), accessor=lambda a: a + 1, keys=[-k for k in range(x.shape[0])], dims=x.value_shape, dtype=x.dtype),
        "rdd": lambda s, x: readers.from_rdd(s, x.df.rdd.map(lambda r: (r.k0, np.array(r["values"]))), "series"),
        "images_rdd": lambda s, x: readers.from_rdd(s, x.df.rdd.map(lambda r: ((r.k0,), np.array(r["values"]).reshape(8, 8))), "images"),
        "local": lambda s, x: x.tolocal().tospark(s, 3),
    }[kind]


def _first_record(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(p, float(x)) for p, x in enumerate(np.round(E(s, d).first(), 6) + 0.0)], "pos int, value double")


def _labels(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(k, int(x)) for k, x in enumerate(E(s, d).labels())], "k0 bigint, label bigint")


def _ranged(s: SparkSession, path: str) -> DataFrame:
    """The third record, by a read of its bytes alone."""
    name, size = objects.keys(s, f"{path}/*.bin")[0]
    with objects.Handle(s, name) as f:
        f.seek(2 * N * 8)
        one = np.frombuffer(f.read(N * 8))
    return s.createDataFrame([(p, float(x)) for p, x in enumerate(np.round(one, 6) + 0.0)], "pos int, value double")


def _by_path(s: SparkSession, path: str, **more) -> Images:
    return readers.images_from_path(s, path, lambda k, data: [np.frombuffer(data).reshape(8, 8)], **more)


def _nested(s, d, path):
    """Files in folders below, of the even and the odd images."""
    for k in (0, 1):
        I(s, d)[k::2].tobinary(f"{path}/part{k}")


def _by_tens(s: SparkSession, d: str) -> Series:
    """Rows of ten records; places of the last row that have no record stay empty."""
    x = E(s, d)
    rows = -(-x.shape[0] // 10)
    return Series(x.df, replace(x.meta, base=(10 * rows,))).reshape(rows, 10, N)


def _executed(s: SparkSession, d: str) -> Series:
    x = E(s, d).repartition(6).coalesce(2)
    if x.npartitions() > 2 or x.iscached():
        raise ValueError("two partitions at most, not cached, are asked for")
    x.cache()
    x.compute()
    return x.uncache()


def _listing(s: SparkSession, path: str) -> DataFrame:
    names = listing.files(s, path, "bin").orderBy("file").select("file", F.element_at(F.split("path", "/"), -1).alias("name"))
    return names.select(F.col("file").cast("bigint").alias("file"), "name")


def _refused(s: SparkSession, d: str) -> DataFrame:
    """Paths and options that are refused, by name."""
    tests = {
        "no files": (FileNotFoundError, lambda: listing.files(s, f"{d}/embeddings.parquet", start=1 << 40)),
        "two wildcards": (ValueError, lambda: objects.Place.parse("s3://b/*/*")),
        "host in a file URI": (ValueError, lambda: objects.uri_to_path("file://a/b")),
        "too many partitions": (ValueError, lambda: E(s, d).coalesce(1 << 20)),
        "unlike shapes": (ValueError, lambda: E(s, d).plus(E(s, d)[:, :3])),
        "matrix of records": (NotImplementedError, lambda: E(s, d).times(E(s, d))),
        "padding over the tile": (ValueError, lambda: I(s, d).toblocks((2, 2), padding=3)),
    }
    out = []
    for name, (kind, run) in tests.items():
        try:
            run()
        except kind:
            out.append((name,))
    return s.createDataFrame(out, "name string")


ALIKE = cell("value")
add("series_from_array", lambda s, d: _local("array")(s, E(s, d)), ALIKE)
add("images_from_array", lambda s, d: _local("images")(s, I(s, d)), ALIKE)
add("series_from_list", lambda s, d: _local("list")(s, E(s, d)), ALIKE)
add("images_from_list_keys", lambda s, d: _local("keyed")(s, I(s, d)), f"SELECT (SELECT max(k0) FROM e) - k0 AS k0, pos, {r('value + 1')} FROM e")
add("series_from_rdd", lambda s, d: _local("rdd")(s, E(s, d)), ALIKE)
add("images_from_rdd", lambda s, d: _local("images_rdd")(s, I(s, d)), ALIKE)
add("series_from_accessor", lambda s, d: readers.series_from_list(s, list(range(50)), accessor=lambda i: np.arange(4.0) * i), "SELECT i AS k0, CAST(p AS INTEGER) AS pos, CAST(i * p AS DOUBLE) AS value FROM (SELECT unnest(range(50)) AS i) CROSS JOIN (SELECT unnest(range(4)) AS p)")
add("series_from_example", lambda s, d: readers.from_example(s, "series", "waves"), f"SELECT i AS k0, CAST(p AS INTEGER) AS pos, {r('sin(p * 4 * pi() / 239) * (i + 1)')} FROM (SELECT unnest(range(20)) AS i) CROSS JOIN (SELECT unnest(range(240)) AS p)")
add("images_from_example", lambda s, d: readers.from_example(s, "images", "waves"), f"SELECT i AS k0, CAST(a * 24 + b AS INTEGER) AS pos, {r('sin(a * 4 * pi() / 239) * sin(b * 4 * pi() / 239) + i')} FROM (SELECT unnest(range(20)) AS i) CROSS JOIN (SELECT unnest(range(24)) AS a) CROSS JOIN (SELECT unnest(range(24)) AS b)")
add("local_roundtrip", lambda s, d: _local("local")(s, E(s, d)), ALIKE)
add("images_from_path", _there_and_back(lambda s, d, p: I(s, d).tobinary(p), lambda s, p: _by_path(s, p, ext="bin")), ALIKE)
add("images_from_path_part", _there_and_back(lambda s, d, p: I(s, d).tobinary(p), lambda s, p: _by_path(s, f"{p}/image-*.bin", start=3, stop=90)), f"SELECT k0 - 3 AS k0, pos, {r('value')} FROM e WHERE k0 BETWEEN 3 AND 89")
add("images_from_path_recursive", _there_and_back(_nested, lambda s, p: _by_path(s, p, ext="bin", recursive=True)), f"SELECT k0 // 2 + CASE k0 % 2 WHEN 0 THEN 0 ELSE ((SELECT max(k0) FROM e) + 2) // 2 END AS k0, pos, {r('value')} FROM e")
add("ranged_read", _there_and_back(lambda s, d, p: E(s, d).tobinary(p), _ranged), f"SELECT pos, {r('value')} FROM e WHERE k0 = 2")
add("listing_files", _there_and_back(lambda s, d, p: I(s, d).tobinary(p), _listing), "SELECT DISTINCT k0 AS file, 'image-' || lpad(CAST(k0 AS VARCHAR), 5, '0') || '.bin' AS name FROM e")
add("place_of_uri", lambda s, d: s.createDataFrame([(objects.uri_to_path("file:///a/b"), *objects.Place.parse("s3://bucket/some/key*.bin").__dict__.values())], "path string, scheme string, bucket string, prefix string, postfix string"), "SELECT '/a/b' AS path, 's3' AS scheme, 'bucket' AS bucket, 'some/key' AS prefix, '.bin' AS postfix")
add("refused", _refused, "SELECT unnest(['no files', 'two wildcards', 'host in a file URI', 'too many partitions', 'unlike shapes', 'matrix of records', 'padding over the tile']) AS name")
add("first_record", _first_record, f"SELECT pos, {r('value')} FROM e WHERE k0 = 0")
add("count_records", lambda s, d: s.createDataFrame([(E(s, d).count(), I(s, d).toblocks((3, 5)).count())], "n bigint, blocks bigint"), "SELECT count(DISTINCT k0) AS n, CAST(6 AS BIGINT) AS blocks FROM e")
add("labels", _labels, "SELECT CAST(vec_id AS BIGINT) AS k0, CAST(label AS BIGINT) AS label FROM embeddings")
add("execution", _executed, ALIKE)
add("squeeze", lambda s, d: (lambda x: x.reshape(x.shape[0], 1, N).squeeze())(I(s, d)), ALIKE)
add("concatenate", lambda s, d: E(s, d).concatenate(E(s, d)[:, ::-1]), f"SELECT k0, pos, {r('value')} FROM e UNION ALL SELECT k0 + (SELECT max(k0) + 1 FROM e), 63 - pos, {r('value')} FROM e")
add("sum_of_integers", lambda s, d: E(s, d).times(100.0).astype("int64").sum().cells().select(F.col("pos").cast("int").alias("pos"), "value"), "SELECT pos, CAST(sum(CAST(trunc(value * 100) AS BIGINT)) AS BIGINT) AS value FROM e GROUP BY pos")
add("numbered_after_sort", lambda s, d: (lambda x: x._renumber(x.df.withColumn("k0", -F.col("k0"))))(E(s, d)), f"SELECT (SELECT max(k0) FROM e) - k0 AS k0, pos, {r('value')} FROM e")
add("fixed_shape", lambda s, d: s.createDataFrame([(str(x.blockshape[1:]), str(x.padding), str(x.grid)) for x in [I(s, d).toblocks((3, 5), padding=(1, 2))]], "tile string, padding string, grid string"), "SELECT '(3, 5)' AS tile, '(1, 2)' AS padding, '(3, 2)' AS grid")

# Generic operators.
add("series_map", lambda s, d: E(s, d).map(lambda x: 2 * x + 1, value_shape=(N,), dtype="float64"), cell("2 * value + 1"))
add("series_map_with_keys", lambda s, d: E(s, d).map(lambda kx: kx[1] + kx[0][0], value_shape=(N,), dtype="float64", with_keys=True), cell("value + k0"))
add("series_filter", lambda s, d: E(s, d).filter(where=lambda v: F.array_max(v) > 0.28), f"SELECT kept.k AS k0, pos, {r('value')} FROM e JOIN kept USING (k0)", ", kept AS (SELECT k0, row_number() OVER (ORDER BY k0) - 1 AS k FROM e GROUP BY k0 HAVING max(value) > 0.28)")
add("series_filter_callable", lambda s, d: E(s, d).filter(lambda x: bool(x[x.argmax()] > 0.28)), f"SELECT kept.k AS k0, pos, {r('value')} FROM e JOIN kept USING (k0)", ", kept AS (SELECT k0, row_number() OVER (ORDER BY k0) - 1 AS k FROM e GROUP BY k0 HAVING max(value) > 0.28)")
add("series_reduce", lambda s, d: E(s, d).reduce(np.maximum), f"SELECT CAST(0 AS BIGINT) AS k0, pos, {r('max(value)')} FROM e GROUP BY pos")
for _name, _op, _sql in (("add", "plus", "a.value + b.value"), ("sub", "minus", "a.value - b.value"), ("mul", "dottimes", "a.value * b.value"), ("div", "dotdivide", "a.value / b.value")):
    add(f"element_wise_{_name}", lambda s, d, op=_op: getattr(E(s, d), op)(E(s, d)[:, ::-1]), REVERSED.format(r(_sql)))
add("scalar_plus", lambda s, d: E(s, d).plus(1.5), cell("value + 1.5"))
add("clip", lambda s, d: E(s, d).clip(-0.5, 0.5), cell("greatest(-0.5, least(0.5, value))"))
add("clip_array", lambda s, d: E(s, d).clip(-np.ones(N), np.linspace(0, 1, N)), cell("greatest(-1.0, least(pos / 63.0, value))"))
add("astype_int", lambda s, d: E(s, d).times(100.0).astype("int16"), cell("trunc(value * 100)"))
add("getitem_records", lambda s, d: E(s, d)[5:50:3], f"SELECT (k0 - 5) // 3 AS k0, pos, {r('value')} FROM e WHERE k0 BETWEEN 5 AND 49 AND (k0 - 5) % 3 = 0")
add("getitem_positions", lambda s, d: E(s, d)[:, [9, 1, 5]], f"SELECT k0, CAST(CASE pos WHEN 9 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS pos, {r('value')} FROM e WHERE pos IN (1, 5, 9)")
add("getitem_image_window", lambda s, d: I(s, d)[::2, 1:7:2, 3], f"SELECT k0 // 2 AS k0, CAST((pos // 8 - 1) // 2 AS INTEGER) AS pos, {r('value')} FROM e WHERE k0 % 2 = 0 AND pos % 8 = 3 AND pos // 8 IN (1, 3, 5)")
add("first", lambda s, d: E(s, d)[0], cell("value") + " WHERE k0 = 0")
add("count", lambda s, d: E(s, d).df.agg(F.count("*").alias("n")), "SELECT count(DISTINCT k0) AS n FROM e")
add("sample", lambda s, d: E(s, d).sample(20, seed=7))
add("labels_filter", lambda s, d: E(s, d).filter(where=lambda v: F.get(v, F.lit(0)) > 0).df.select("k0", F.col("label").cast("int").alias("label")), "SELECT row_number() OVER (ORDER BY k0) - 1 AS k0, label FROM e JOIN embeddings ON vec_id = k0 WHERE pos = 0 AND value > 0")
add("flatten_reshape", _by_tens, f"SELECT k0 // 10 AS k0, k0 % 10 AS k1, pos, {r('value')} FROM e")

# Across records.
STATS = {"mean": "avg(value)", "var": "var_pop(value)", "std": "stddev_pop(value)", "sum": "sum(value)", "max": "max(value)", "min": "min(value)"}
for _name, _sql in STATS.items():
    for _kind, _data in (("series", E), ("images", I)):
        add(f"{_kind}_{_name}", lambda s, d, n=_name, x=_data: getattr(x(s, d), n)(), f"SELECT CAST(0 AS BIGINT) AS k0, pos, {r(_sql)} FROM e GROUP BY pos")
add("gramian", lambda s, d: E(s, d).gramian(), f"SELECT CAST(a.pos AS BIGINT) AS k0, b.pos AS pos, {r('sum(a.value * b.value)')} FROM e a JOIN e b USING (k0) GROUP BY a.pos, b.pos")
add("cov", lambda s, d: E(s, d).cov(), f"SELECT CAST(a.pos AS BIGINT) AS k0, b.pos AS pos, {r('covar_samp(a.value, b.value)')} FROM e a JOIN e b USING (k0) GROUP BY a.pos, b.pos")
add("times_scalar", lambda s, d: E(s, d).times(3.0), cell("value * 3"))
add("times_vector", lambda s, d: E(s, d).times(SIGNAL), f"SELECT k0, CAST(0 AS INTEGER) AS pos, {r(f'list_dot_product(v, {lst(SIGNAL)})')} FROM rec", LISTS)
add("times_matrix", lambda s, d: E(s, d).times(MATRIX), " UNION ALL ".join(f"SELECT k0, CAST({j} AS INTEGER) AS pos, {r(f'list_dot_product(v, {lst([row[j] for row in MATRIX])})')} FROM rec" for j in range(3)), LISTS)

# Within records.
ROW, POS = "OVER (PARTITION BY k0)", "OVER (PARTITION BY pos)"
for _axis, _w in ((0, POS), (1, ROW)):
    add(f"center_{_axis}", lambda s, d, a=_axis: E(s, d).center(a), cell(f"value - avg(value) {_w}"))
    add(f"standardize_{_axis}", lambda s, d, a=_axis: E(s, d).standardize(a), cell(f"value / stddev_pop(value) {_w}"))
    add(f"zscore_{_axis}", lambda s, d, a=_axis: E(s, d).zscore(a), cell(f"(value - avg(value) {_w}) / stddev_pop(value) {_w}"))
add("center_1_series_mean", lambda s, d: E(s, d).center(1).mean(), f"SELECT CAST(0 AS BIGINT) AS k0, pos, {r('avg(x)')} FROM (SELECT pos, value - avg(value) {ROW} AS x FROM e) GROUP BY pos")
add("squelch", lambda s, d: E(s, d).squelch(0.28), cell(f"CASE WHEN max(value) {ROW} < 0.28 THEN 0.0 ELSE value END"))
PEARSON = f"SELECT k0, CAST({{}} AS INTEGER) AS pos, {r('corr(value, list_extract({}, CAST(pos + 1 AS BIGINT)))')} FROM e GROUP BY k0"
add("correlate_one", lambda s, d: E(s, d).correlate(SIGNAL), PEARSON.format(0, lst(SIGNAL)))
add("correlate_many", lambda s, d: E(s, d).correlate([SIGNAL, SIGNAL2]), PEARSON.format(0, lst(SIGNAL)) + " UNION ALL " + PEARSON.format(1, lst(SIGNAL2)))
add("normalize_mean", lambda s, d: U(s, d).normalize("mean"), cell(f"(value - avg(value) {ROW}) / (avg(value) {ROW} + 0.1)", "u"))
add("normalize_percentile", lambda s, d: U(s, d).normalize("percentile", perc=20), f"SELECT k0, pos, {r('(value - b) / (b + 0.1)')} FROM u JOIN (SELECT k0, quantile_cont(value, 0.2) AS b FROM u GROUP BY k0) USING (k0)")
add("normalize_window", lambda s, d: U(s, d).normalize("window", window=5, perc=20), f"SELECT k0, pos, {r('(value - b) / (b + 0.1)')} FROM u JOIN (SELECT a.k0, a.pos, list_sort(list(c.value))[2] AS b FROM u a CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS o) JOIN u c ON c.k0 = a.k0 AND c.pos = greatest(0, least({DAYS - 1}, a.pos + o)) GROUP BY a.k0, a.pos) USING (k0, pos)")
add("normalize_window_exact", lambda s, d: U(s, d).normalize("window-exact", window=6, perc=20), f"SELECT k0, pos, {r('(value - b) / (b + 0.1)')} FROM (SELECT k0, pos, value, quantile_cont(value, 0.2) OVER (PARTITION BY k0 ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS b FROM u)")
add("detrend_linear", lambda s, d: M(s, d).detrend("linear"), f"SELECT k0, pos, {r('value - b * pos')} FROM m JOIN (SELECT k0, regr_slope(value, pos) AS b FROM m GROUP BY k0) USING (k0)")
_POWERS = np.vander(np.arange(DAYS, dtype=float), 4, increasing=True)
add("detrend_nonlinear", lambda s, d: U(s, d).detrend("nonlinear", order=3), f"SELECT k0, pos, {r('value - (c1 * pos + c2 * pos * pos + c3 * pos * pos * pos)')} FROM u JOIN fit USING (k0)", ", fit AS (SELECT k0, " + ", ".join(f"list_dot_product(list(value ORDER BY pos), {lst(row)}) AS c{j + 1}" for j, row in enumerate(np.linalg.pinv(_POWERS)[1:])) + " FROM u GROUP BY k0)")

# By index.
add("select", lambda s, d: E(s, d).select([3, 7, 40]), f"SELECT k0, CAST(CASE pos WHEN 3 THEN 0 WHEN 7 THEN 1 ELSE 2 END AS INTEGER) AS pos, {r('value')} FROM e WHERE pos IN (3, 7, 40)")
add("select_callable", lambda s, d: E(s, d).select(lambda i: i % 16 == 5), f"SELECT k0, CAST((pos - 5) // 16 AS INTEGER) AS pos, {r('value')} FROM e WHERE pos % 16 = 5")
add("between", lambda s, d: E(s, d).between(10, 20), f"SELECT k0, CAST(pos - 10 AS INTEGER) AS pos, {r('value')} FROM e WHERE pos >= 10 AND pos < 20")
AGAIN = "SELECT k0, CAST(row_number() OVER (PARTITION BY k0 ORDER BY pos) - 1 AS INTEGER) AS pos, " + r("value") + " FROM u WHERE {}"
add("select_by_index", lambda s, d: U(s, d).select_by_index([2, 4], level=1), AGAIN.format("pos % 7 IN (2, 4)"))
add("select_by_index_filter", lambda s, d: U(s, d).select_by_index([2, 4], level=1, filter=True), AGAIN.format("pos % 7 NOT IN (2, 4)"))
add("select_by_index_levels", lambda s, d: U(s, d).select_by_index([[0, 2], [1, 3]], level=[0, 1]), AGAIN.format("pos // 7 IN (0, 2) AND pos % 7 IN (1, 3)"))
add("select_by_index_squeeze", lambda s, d: U(s, d).select_by_index([[1], [1, 3]], level=[0, 1], squeeze=True), AGAIN.format("pos // 7 = 1 AND pos % 7 IN (1, 3)"))
BY_INDEX = {"sum": "sum(value)", "mean": "avg(value)", "median": "quantile_cont(value, 0.5)", "std": "stddev_pop(value)", "max": "max(value)", "min": "min(value)", "count": "CAST(count(*) AS DOUBLE)"}
for _name, _sql in BY_INDEX.items():
    add(f"{_name}_by_index", lambda s, d, n=_name: getattr(U(s, d), f"{n}_by_index")(level=1), f"SELECT k0, CAST(pos % 7 AS INTEGER) AS pos, {r(_sql)} FROM u GROUP BY k0, pos % 7")
add("stat_by_index_levels", lambda s, d: U(s, d).stat_by_index("sum", level=[0, 1]), cell("value", "u"))
add("aggregate_by_index", lambda s, d: U(s, d).aggregate_by_index(lambda x: float(np.ptp(x)), level=0), f"SELECT k0, CAST(pos // 7 AS INTEGER) AS pos, {r('max(value) - min(value)')} FROM u GROUP BY k0, pos // 7")
add("mean_by_panel", lambda s, d: U(s, d).mean_by_panel(10), f"SELECT k0, CAST(pos % 10 AS INTEGER) AS pos, {r('avg(value)')} FROM u GROUP BY k0, pos % 10")
add("mean_by_window", lambda s, d: E(s, d).mean_by_window([10, 30, 50], 7), f"SELECT k0, CAST(pos - c + 3 AS INTEGER) AS pos, {r('avg(value)')} FROM e JOIN (SELECT unnest([10, 30, 50]) AS c) ON pos BETWEEN c - 3 AND c + 3 GROUP BY k0, pos - c + 3")
add("subsample", lambda s, d: E(s, d).subsample(3), f"SELECT k0, CAST(pos // 3 AS INTEGER) AS pos, {r('value')} FROM e WHERE pos % 3 = 0")
add("downsample", lambda s, d: M(s, d).downsample(4), f"SELECT k0, CAST(pos // 4 AS INTEGER) AS pos, {r('avg(value)')} FROM m WHERE pos < {MONTHS // 4 * 4} GROUP BY k0, pos // 4")

# Signals.
add("fourier", lambda s, d: E(s, d).fourier(3), f"""SELECT k0, CAST(p AS INTEGER) AS pos, {r('CASE p WHEN 0 THEN amp / sqrt(total) ELSE CASE WHEN ph < 0 THEN ph + 2 * pi() ELSE ph END END')}
FROM (SELECT k0, sqrt(sum(CASE WHEN f = 3 THEN re * re + im * im END)) AS amp, sum(re * re + im * im) AS total, -pi() / 2 - atan2(sum(CASE WHEN f = 3 THEN im END), sum(CASE WHEN f = 3 THEN re END)) AS ph
      FROM (SELECT k0, f, sum(y * cos(2 * pi() * f * pos / {N})) AS re, -sum(y * sin(2 * pi() * f * pos / {N})) AS im
            FROM (SELECT k0, pos, value - avg(value) {ROW} AS y FROM e) CROSS JOIN (SELECT unnest(range({N // 2})) AS f) GROUP BY k0, f) GROUP BY k0) CROSS JOIN (SELECT unnest([0, 1]) AS p)""")
CONVOLVED = f"SELECT k0, CAST(pos + k - {{0}} AS INTEGER) AS pos, {r(f'sum(value * list_extract({lst(KERNEL)}, k + 1))')} FROM e CROSS JOIN (SELECT unnest(range({len(KERNEL)})) AS k) WHERE pos + k BETWEEN {{0}} AND {{1}} GROUP BY k0, pos + k"
for _mode, _low, _high in (("full", 0, N + len(KERNEL) - 2), ("same", 2, N + 1), ("valid", len(KERNEL) - 1, N - 1)):
    add(f"convolve_{_mode}", lambda s, d, m=_mode: E(s, d).convolve(KERNEL, m), CONVOLVED.format(_low, _high))
_S = np.array(SIGNAL) - np.mean(SIGNAL)
_S = _S / np.linalg.norm(_S)
add("crosscorr", lambda s, d: E(s, d).crosscorr(SIGNAL, lag=4), f"SELECT k0, CAST(k + 4 AS INTEGER) AS pos, {r(f'sum(y * list_extract({lst(_S)}, CAST(pos - k + 1 AS BIGINT))) / any_value(norm)')} FROM (SELECT k0, pos, value - avg(value) {ROW} AS y, sqrt(var_pop(value) {ROW} * {N}) AS norm FROM e) CROSS JOIN (SELECT unnest(range(-4, 5)) AS k) WHERE pos - k BETWEEN 0 AND {N - 1} GROUP BY k0, k")

# Images.
add("max_projection", lambda s, d: V(s, d).max_projection(2), f"SELECT k0, CAST(pos // 4 AS INTEGER) AS pos, {r('max(value)')} FROM e GROUP BY k0, pos // 4")
add("max_min_projection", lambda s, d: V(s, d).max_min_projection(1), f"SELECT k0, CAST(pos // 16 * 4 + pos % 4 AS INTEGER) AS pos, {r('max(value) + min(value)')} FROM e GROUP BY k0, pos // 16 * 4 + pos % 4")
add("image_subsample", lambda s, d: I(s, d).subsample(3), f"SELECT k0, CAST(pos // 8 // 3 * 3 + pos % 8 // 3 AS INTEGER) AS pos, {r('value')} FROM e WHERE pos // 8 % 3 = 0 AND pos % 8 % 3 = 0")
add("image_subtract", lambda s, d: I(s, d).subtract(np.array(PICTURE).reshape(8, 8)), cell(f"value - list_extract({lst(PICTURE)}, CAST(pos + 1 AS BIGINT))"))
add("image_subtract_scalar", lambda s, d: I(s, d).subtract(0.5), cell("value - 0.5"))
add("image_reshape", lambda s, d: I(s, d).reshape(I(s, d).shape[0], 4, 16), cell("value"))
add("toseries", lambda s, d: I(s, d).toseries(), f"SELECT CAST(pos // 8 AS BIGINT) AS k0, CAST(pos % 8 AS BIGINT) AS k1, CAST(k0 AS INTEGER) AS pos, {r('value')} FROM e")
add("toseries_tiles", lambda s, d: I(s, d).toseries((4, 4)), f"SELECT CAST(pos // 8 AS BIGINT) AS k0, CAST(pos % 8 AS BIGINT) AS k1, CAST(k0 AS INTEGER) AS pos, {r('value')} FROM e")
add("toimages", lambda s, d: E(s, d).toimages(), f"SELECT CAST(pos AS BIGINT) AS k0, CAST(k0 AS INTEGER) AS pos, {r('value')} FROM e")
NEAR = """, w AS (SELECT unnest(range({0}, {1})) AS o), near AS (
  SELECT a.k0, a.pos, dr.o AS dr, dc.o AS dc, (((a.pos // 8 + dr.o) % 16) + 16) % 16 AS rr, (((a.pos % 8 + dc.o) % 16) + 16) % 16 AS cc FROM e a CROSS JOIN w dr CROSS JOIN w dc
), around AS (
  SELECT n.k0, n.pos, n.dr, n.dc, b.value FROM near n JOIN e b ON b.k0 = n.k0 AND b.pos = CASE WHEN rr < 8 THEN rr ELSE 15 - rr END * 8 + CASE WHEN cc < 8 THEN cc ELSE 15 - cc END
)"""
add("uniform_filter", lambda s, d: I(s, d).uniform_filter(3), f"SELECT k0, pos, {r('avg(value)')} FROM around GROUP BY k0, pos", NEAR.format(-1, 2))
add("uniform_filter_even", lambda s, d: I(s, d).uniform_filter(4), f"SELECT k0, pos, {r('avg(value)')} FROM around GROUP BY k0, pos", NEAR.format(-2, 2))
add("median_filter", lambda s, d: I(s, d).median_filter(3), f"SELECT k0, pos, {r('list_sort(list(value))[5]')} FROM around GROUP BY k0, pos", NEAR.format(-1, 2))
add("median_filter_even", lambda s, d: I(s, d).median_filter(2), f"SELECT k0, pos, {r('list_sort(list(value))[3]')} FROM around GROUP BY k0, pos", NEAR.format(-1, 1))
add("gaussian_filter", lambda s, d: I(s, d).gaussian_filter(1), f"SELECT k0, pos, {r('sum(value * exp(-(dr * dr + dc * dc) / 2.0)) / sum(exp(-(dr * dr + dc * dc) / 2.0))')} FROM around GROUP BY k0, pos", NEAR.format(-4, 5))
add("localcorr", lambda s, d: I(s, d).localcorr_frame(3), f"SELECT CAST(a.pos // 8 AS BIGINT) AS k0, CAST(a.pos % 8 AS BIGINT) AS k1, CAST(0 AS INTEGER) AS pos, {r('corr(a.value, b.value)')} FROM e a JOIN (SELECT k0, pos, avg(value) AS value FROM around GROUP BY k0, pos) b USING (k0, pos) GROUP BY a.pos", NEAR.format(-1, 2))


def _foreach(s: SparkSession, d: str) -> DataFrame:
    seen = s.sparkContext.accumulator(0)
    I(s, d).foreach(lambda kx: seen.add(1))
    return s.createDataFrame([(seen.value,)], "n bigint")


add("foreach", _foreach, "SELECT count(DISTINCT k0) AS n FROM e")
add("map_as_series", lambda s, d: I(s, d).map_as_series(lambda x: x - x.mean(), value_size=I(s, d).shape[0], dtype="float64", chunk_size=(4, 4)), cell(f"value - avg(value) {POS}"))

# Blocks.


def _tiles(b) -> DataFrame:
    keys = [F.col(k).cast("bigint").alias(k) for k in b.keys]
    return b.cells(core=False).select(*keys, "k0", F.col("px").cast("int").alias("pos"), (F.round(F.col("value").cast("double"), 6) + 0.0).alias("value"))


TILED = f"SELECT CAST(b0 AS BIGINT) AS b0, CAST(b1 AS BIGINT) AS b1, k0, pos, {r('value')} FROM e CROSS JOIN (SELECT unnest(range(3)) AS b0) CROSS JOIN (SELECT unnest(range(2)) AS b1) WHERE pos // 8 >= b0 * 3 - {{0}} AND pos // 8 < b0 * 3 + 3 + {{0}} AND pos % 8 >= b1 * 5 - {{1}} AND pos % 8 < b1 * 5 + 5 + {{1}}"
add("toblocks", lambda s, d: _tiles(I(s, d).toblocks((3, 5))), TILED.format(0, 0))
add("toblocks_padded", lambda s, d: _tiles(I(s, d).toblocks((3, 5), padding=(1, 2))), TILED.format(1, 2))
add("toblocks_budget", lambda s, d: (lambda x: _tiles(x.toblocks("0.2")))(I(s, d)), f"SELECT CAST(pos // 8 // 3 AS BIGINT) AS b0, CAST(0 AS BIGINT) AS b1, k0, pos, {r('value')} FROM e")
add("blocks_map", lambda s, d: I(s, d).toblocks((3, 5), padding=1).map(lambda b: b * 2 + 1).toimages(), cell("value * 2 + 1"))
add("blocks_toimages", lambda s, d: I(s, d).toblocks((3, 5), padding=(1, 2)).toimages(), cell("value"))
add("blocks_toseries", lambda s, d: I(s, d).toblocks((3, 5), padding=1).toseries(), f"SELECT CAST(pos // 8 AS BIGINT) AS k0, CAST(pos % 8 AS BIGINT) AS k1, CAST(k0 AS INTEGER) AS pos, {r('value')} FROM e")
add("collect_blocks", lambda s, d: s.createDataFrame([(i, float(round(b.sum(), 6)) + 0.0) for i, b in enumerate(I(s, d).toblocks((3, 5)).collect_blocks())], "b bigint, value double"), f"SELECT CAST(pos // 8 // 3 * 2 + pos % 8 // 5 AS BIGINT) AS b, {r('sum(value)')} FROM e GROUP BY 1")
add("blocks_map_generic", lambda s, d: s.createDataFrame([(i, j, int(n), float(round(x, 6)) + 0.0) for (i, j), (n, x) in np.ndenumerate(I(s, d).toblocks((3, 5)).map_generic(lambda b: (b.size, float(b.sum()))))], "b0 bigint, b1 bigint, n bigint, value double"), f"SELECT CAST(pos // 8 // 3 AS BIGINT) AS b0, CAST(pos % 8 // 5 AS BIGINT) AS b1, count(*) AS n, {r('sum(value)')} FROM e GROUP BY ALL")
add("series_index", lambda s, d: (lambda x: Series(x.df, replace(x.meta, index=None)).with_index([i * 10 for i in range(DAYS)]).between(50, 90))(U(s, d)), f"SELECT k0, CAST(pos - 5 AS INTEGER) AS pos, {r('value')} FROM u WHERE pos BETWEEN 5 AND 8")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
