import json
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe import catalogue
from voxelframe.functions import kernels as K
from voxelframe.sources import listing, objects, readers


def test_codecs():
    for t in ("uint8", "uint16"):
        for shape in ((4, 2), (5, 7, 3), (3, 3, 4)):
            x = np.random.RandomState(0).randint(0, np.iinfo(t).max, shape).astype(t)
            assert (K.png_decode(K.png_encode(x)) == x).all()
    for t in ("uint8", "uint16", "int16", "float32", "float64", "int32"):
        x = (np.random.RandomState(0).randn(2, 3, 4) * 50).astype(t)
        y = K.tif_decode(K.tif_encode(x))
        assert (y == x).all() and y.dtype == x.dtype
    with pytest.raises(ValueError):
        K.png_encode(np.zeros((2, 2, 2)))
    with pytest.raises(ValueError):
        K.png_decode(b"nothing")


def png_with_filters(x):
    """A grey PNG whose rows use filters 0 to 4 in turn."""
    import struct
    import zlib

    rows, before = [], np.zeros(x.shape[1] + 1, int)
    for y, line in enumerate(x.astype(int)):
        kind = y % 5
        own = np.concatenate([[0], line])
        out = []
        for k in range(1, len(own)):
            a, b, c = own[k - 1], before[k], before[k - 1]
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out.append((own[k] - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        rows.append(bytes([kind, *out]))
        before = own
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return K.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_png_filters():
    x = np.random.RandomState(0).randint(0, 256, (11, 9)).astype("uint8")
    assert (K.png_decode(png_with_filters(x)) == x).all()


def lzw_encoded(data):
    out, have, acc, table, width, word = bytearray(), 0, 0, {bytes([k]): k for k in range(256)}, 9, b""
    codes = [(256, 9)]
    size = 258
    for k in range(len(data)):
        c = data[k : k + 1]
        if word + c in table:
            word += c
            continue
        codes.append((table[word], width))
        table[word + c] = size
        size += 1
        if size > (1 << width) - 1:
            width += 1
        if size >= 4094:
            codes.append((256, width))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = c
    codes += [(table[word], width), (257, width)]
    for code, n in codes:
        acc, have = acc << n | code, have + n
        while have >= 8:
            have -= 8
            out.append(acc >> have & 255)
    out.append(acc << (8 - have) & 255)
    return bytes(out)


def tif(x, packed, pack, tile=None, ahead=1):
    """A little-endian TIFF of one page in strips of two rows, or in tiles."""
    import struct

    h, w = x.shape
    th, tw = tile or (2, w)
    parts = []
    for y in range(0, h, th):
        for c in range(0, w, tw):
            part = x[y : y + th, c : c + tw]
            if tile:
                part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1])))
            if ahead == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), x.dtype)).astype(x.dtype)
            parts.append(pack(part.tobytes()))
    out, places = bytearray(struct.pack("<2sHI", b"II", 42, 0)), []
    for part in parts:
        places.append(len(out))
        out += part + b"\0" * (len(part) % 2)
    lists = []
    for values in (places, [len(p) for p in parts]):
        lists.append(len(out) if len(values) > 1 else values[0])
        out += struct.pack(f"<{len(values)}I", *values)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8 * x.itemsize), (259, 3, 1, packed), (277, 3, 1, 1), (317, 3, 1, ahead), (339, 3, 1, {"u": 1, "i": 2}[x.dtype.kind])]
    n = len(parts)
    tags += [(322, 4, 1, tw), (323, 4, 1, th), (324, 4, n, lists[0]), (325, 4, n, lists[1])] if tile else [(273, 4, n, lists[0]), (278, 4, 1, th), (279, 4, n, lists[1])]
    struct.pack_into("<I", out, 4, len(out))
    out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags)) + struct.pack("<I", 0)
    return bytes(out)


@pytest.mark.parametrize("ahead", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16)])
def test_packed_tifs(tile, ahead):
    import zlib

    x = (np.random.RandomState(0).randint(0, 50, (21, 37)) ** 2).astype("uint16")
    packbits = lambda d: b"".join(bytes([len(d[k : k + 100]) - 1]) + d[k : k + 100] for k in range(0, len(d), 100))
    for packed, pack in ((1, bytes), (5, lzw_encoded), (8, zlib.compress), (32773, packbits)):
        assert (K.tif_decode(tif(x, packed, pack, tile, ahead))[0] == x).all(), packed
    big = np.random.RandomState(0).randint(0, 4, (300, 200)).astype("uint8")
    assert (K.tif_decode(tif(big, 5, lzw_encoded, (304, 208)))[0] == big).all()  # the table is full more than once
    assert K._packbits(bytes([254, 7, 128, 1, 8, 9])) == b"\x07\x07\x07\x08\x09"
    with pytest.raises(ValueError):
        K.tif_decode(tif(x, 7, bytes))


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
def test_interlaced_and_shallow_pngs(depth):
    import struct
    import zlib

    x = np.random.RandomState(0).randint(0, 2**depth, (11, 13))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def rows(part):
        bits = (part[:, :, None] >> np.arange(depth - 1, -1, -1) & 1).reshape(len(part), -1).astype(np.uint8)
        return b"".join(b"\0" + np.packbits(r).tobytes() for r in bits)

    for interlaced in (0, 1):
        parts = [x[a::c, b::d] for a, b, c, d in K.PASSES] if interlaced else [x]
        data = zlib.compress(b"".join(rows(p) for p in parts if p.size))
        for colour in (0, 3) if depth <= 8 else (0,):
            palette = np.random.RandomState(1).randint(0, 256, (2**depth, 3)).astype(np.uint8)
            made = K.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 13, 11, depth, colour, 0, 0, interlaced)) + (chunk(b"PLTE", palette.tobytes()) if colour else b"") + chunk(b"IDAT", data) + chunk(b"IEND", b"")
            want = palette[x] if colour else x * (255 // (2**depth - 1)) if depth < 8 else x
            assert (K.png_decode(made) == want).all()


def test_text(spark, tmp_path):
    for name, rows in (("b.txt", "7 8  9\n1 2 3"), ("a.txt", "1 1 1\n2 2 2\n\n3 3 3\n")):
        (tmp_path / name).write_text(rows)
    x = readers.series_from_text(spark, str(tmp_path))
    assert x.toarray().tolist() == [[1, 1, 1], [2, 2, 2], [3, 3, 3], [7, 8, 9], [1, 2, 3]]
    assert readers.series_from_text(spark, str(tmp_path), skip=1, index=["p", "q"]).select("q").toarray().tolist() == [1, 2, 3, 9, 3]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|no files"):
        readers.series_from_text(spark, str(tmp_path / "none")).toarray()


def test_series_binary(spark, tmp_path):
    a = np.arange(24, dtype="int16").reshape(2, 3, 4)
    p = str(tmp_path / "out")
    readers.series_from_array(spark, a).repartition(3).tobinary(p)
    names = sorted(os.listdir(p))
    assert {"conf.json", "SUCCESS"} < set(names) and "series-00000-00000.bin" in names
    assert json.load(open(p + "/conf.json")) == {"shape": [2, 3, 4], "dtype": "int16"}
    assert (readers.series_from_binary(spark, p).toarray() == a).all()
    assert (readers.series_from_binary(spark, p, shape=(2, 3, 3), skip=1).toarray() == a[:, :, 1:]).all()
    with pytest.raises(ValueError):
        readers.series_from_array(spark, a).tobinary(p)
    with pytest.raises(ValueError):
        readers.series_from_binary(spark, p, shape=(5, 4))
    readers.series_from_array(spark, a + 1).tobinary(p, overwrite=True)
    assert (readers.series_from_binary(spark, p).toarray() == a + 1).all()


def test_images_binary(spark, tmp_path):
    a = np.arange(48, dtype="int32").reshape(2, 3, 4, 2)
    p = str(tmp_path / "out")
    readers.images_from_array(spark, a).tobinary(p, prefix="im")
    assert sorted(os.listdir(p)) == ["SUCCESS", "conf.json", "im-00000.bin", "im-00001.bin"]
    got = readers.images_from_binary(spark, p, shape=(3, 4, 2), dtype="int32", conf="none.json")
    assert (got.toarray() == a).all()
    planes = readers.images_from_binary(spark, p, shape=(3, 4, 2), dtype="int32", conf="none.json", nplanes=1)
    assert (planes.toarray() == np.moveaxis(a, -1, 1).reshape(4, 3, 4)).all()
    with pytest.raises(ValueError):
        readers.images_from_binary(spark, p, shape=(3, 4, 2), conf="none.json", nplanes=3)
    fortran = tmp_path / "f"
    fortran.mkdir()
    a[0].ravel(order="F").tofile(fortran / "x.bin")
    assert (readers.images_from_binary(spark, str(fortran), shape=(3, 4, 2), dtype="int32", order="F").toarray() == a[0]).all()


def test_png_tif_parquet(spark, tmp_path):
    a = np.arange(24, dtype="uint8").reshape(3, 4, 2)
    x = readers.images_from_array(spark, a)
    x.topng(str(tmp_path / "png"))
    assert sorted(os.listdir(tmp_path / "png")) == [f"image-{k:05d}.png" for k in range(3)]
    y = readers.images_from_png(spark, str(tmp_path / "png"))
    assert (y.toarray() == a).all() and y.dtype == np.uint8
    assert (readers.images_from_png(spark, str(tmp_path / "png"), start=1, stop=3).toarray() == a[1:]).all()
    x.totif(str(tmp_path / "tif"))
    assert (readers.images_from_tif(spark, str(tmp_path / "tif")).toarray() == a).all()
    with pytest.raises(ValueError):
        readers.images_from_array(spark, np.zeros((1, 2, 2, 2))).topng(str(tmp_path / "bad"))
    pages = np.arange(2 * 5 * 3 * 4, dtype="int16").reshape(2, 5, 3, 4)
    readers.images_from_array(spark, pages).totif(str(tmp_path / "pages"))
    p = str(tmp_path / "pages")
    assert readers.images_from_tif(spark, p).shape == (2, 5, 3, 4)
    assert readers.images_from_tif(spark, p, nplanes=1).shape == (10, 3, 4)
    assert readers.images_from_tif(spark, p, nplanes=2, discard_extra=True).shape == (4, 2, 3, 4)
    with pytest.raises(Exception, match="do not divide"):
        readers.images_from_tif(spark, p, nplanes=2).toarray()
    s = readers.series_from_array(spark, np.arange(6).reshape(2, 3), index=["a", "b", "c"])
    s.toparquet(str(tmp_path / "pq"))
    back = readers.from_parquet(spark, str(tmp_path / "pq"))
    assert back.index == ["a", "b", "c"] and (back.toarray() == s.toarray()).all()


def test_listing(spark, tmp_path):
    assert listing.with_extension("/a/b", "tif") == "/a/b/*.{tif,tiff}"
    assert listing.with_extension("/a/*.bin", "txt") == "/a/*.bin"
    for name in ("c.tif", "a.tiff", "d/b.tif", "e.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")

    def names(**more):
        return [os.path.basename(r.path) for r in listing.files(spark, str(tmp_path), **more).orderBy("file").collect()]

    assert names(ext="tif") == ["a.tiff", "c.tif"]
    assert names(ext="tif", recursive=True) == ["a.tiff", "c.tif", "b.tif"]
    assert names(ext="tif", start=1) == ["c.tif"]
    assert listing.single(spark, str(tmp_path / "e.txt")) == b"x"
    with pytest.raises(ValueError):
        listing.single(spark, str(tmp_path / "*.tif*"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", ["images_binary_roundtrip", "png_roundtrip", "tif_roundtrip", "tif_planes"])
def test_whole_tables_come_back(spark, name):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    assert catalogue.queries()[name](spark, d).count() == n * 64


def test_splits(spark, tmp_path):
    """Files of many splits: records keep the order of files and of lines or bytes."""
    a = np.arange(3000 * 4, dtype="int32").reshape(3000, 4)
    for k, part in enumerate(np.split(a, [700, 701])):
        (tmp_path / f"{k}.txt").write_text("\n".join(" ".join(map(str, r)) for r in part) + "\n")
        part.tofile(tmp_path / f"{k}.bin")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        x = readers.series_from_text(spark, str(tmp_path))
        assert x.shape == (3000, 4) and (x.toarray() == a).all()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (readers.series_from_binary(spark, str(tmp_path), shape=(3000, 4), dtype="int32").toarray() == a).all()


def test_objects(spark, tmp_path):
    assert objects.uri_to_path("file:///a/b c") == "/a/b c" and objects.uri_to_path("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        objects.uri_to_path("file://a/b")
    p = objects.Place.parse("s3://bucket/some/key*.bin")
    assert (p.scheme, p.bucket, p.prefix, p.postfix) == ("s3", "bucket", "some/key", ".bin") and p.uri == "s3://bucket/some/key*.bin"
    assert objects.Place.parse("/a/b") == objects.Place("", "", "/a/b", None) and objects.Place.parse("/a/b").uri == "/a/b"
    with pytest.raises(ValueError):
        objects.Place.parse("gs://b/*/x*")
    data = bytes(range(256)) * 10
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name in ("d/a.bin", "d/b.bin", "d/e/c.bin"):
        (tmp_path / name).write_bytes(data)
    names = lambda *a, **k: [os.path.relpath(x.removeprefix("file:"), tmp_path) for x, _ in objects.keys(spark, *a, **k)]
    assert names(f"{tmp_path}/d") == ["d/a.bin", "d/b.bin"] and names(f"{tmp_path}/d/a*") == ["d/a.bin"]
    assert names(f"{tmp_path}/d", recursive=True) == ["d/a.bin", "d/b.bin", "d/e/c.bin"] and objects.keys(spark, f"{tmp_path}/none*") == []
    with objects.Handle(spark, f"file://{tmp_path}/d/a.bin") as f:
        assert f.size == 2560 and f.read(3) == data[:3] and f.tell() == 3
        f.seek(-4, 2)
        assert f.read() == data[-4:] and f.read() == b""
        f.seek(1000)
        f.seek(5, 1)
        assert f.read(7) == data[1005:1012]
        with pytest.raises(ValueError):
            f.seek(-1)
    with pytest.raises(ValueError):
        objects.Handle(spark, f"{tmp_path}/d/*.bin")
    with pytest.raises(FileNotFoundError):
        objects.Handle(spark, f"{tmp_path}/none.bin")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    objects.credentials(spark, "key", "secret")
    assert conf.get("fs.s3a.access.key") == "key" and "Simple" in conf.get("fs.s3a.aws.credentials.provider")
    objects.credentials(spark)
    assert conf.get("fs.s3a.access.key") is None and "Anonymous" in conf.get("fs.s3a.aws.credentials.provider")
    with pytest.raises(ValueError):
        objects.credentials(spark, "key")
    with pytest.raises(ValueError):
        objects.credentials(spark, scheme="ftp")


def test_more_images_than_five_digits(spark, tmp_path):
    images = readers.images_from_array(spark, np.arange(8.0).reshape(2, 2, 2))
    far = images._new(F.col("values"))
    far.df, far.meta = far.df.withColumn("k0", F.col("k0") + 99999), replace(far.meta, base=(100001,))
    far.tobinary(str(tmp_path / "far"))
    assert (readers.images_from_binary(spark, str(tmp_path / "far"), shape=(2, 2), conf="none.json", dtype="float64").toarray() == images.toarray()).all()


def test_more_series_than_five_digits(spark, tmp_path):
    a = np.arange(80.0).reshape(40, 2)
    series = readers.series_from_array(spark, a, npartitions=8)
    far = series._new(F.col("values"))
    far.df, far.meta = far.df.withColumn("k0", F.col("k0") + 99980), replace(far.meta, base=(100020,))
    far.tobinary(str(tmp_path / "far"))
    assert len([n for n in os.listdir(tmp_path / "far") if n.startswith("series-1")]) > 1
    assert (readers.series_from_binary(spark, str(tmp_path / "far"), shape=(40, 2)).toarray() == a).all()


def test_names_of_images(spark, tmp_path):
    """Five digits whatever the number of images, and names in order of the images."""
    at = [7, 9999, 10000, 99998, 99999, 100000, 100001, 999999, 1000000, 1000001]
    a = np.arange(40.0).reshape(10, 2, 2)
    images = readers.images_from_array(spark, a)
    far = images._new(F.col("values"))
    far.df, far.meta = far.df.withColumn("k0", F.element_at(F.array(*map(F.lit, at)), F.col("k0").cast("int") + 1).cast("long")), replace(far.meta, base=(1000002,))
    p = str(tmp_path / "far")
    far.tobinary(p)
    names = [r.path.rsplit("/", 1)[1] for r in listing.files(spark, p, "bin").orderBy("file").select("path").collect()]
    assert names[:5] == [f"image-{k:05d}.bin" for k in at[:5]] and [int(n[6:-4].strip("_")) for n in names] == at
    assert (readers.images_from_binary(spark, p, shape=(2, 2), conf="none.json", dtype="float64").toarray() == a).all()
    assert (readers.series_from_binary(spark, p, shape=(20, 2), dtype="float64").toarray() == a.reshape(20, 2)).all()
