import os

import numpy as np
import pytest
from numpy.testing import assert_allclose

from voxelframe import catalogue
from voxelframe.functions import kernels as K
from voxelframe.plans.tiles import tile_sizes
from voxelframe.sources import readers


def brute(x, size, fn):
    """Each element's window, mirrored at the edges, by explicit index arithmetic."""
    out = np.zeros(x.shape)
    sizes = [size] * x.ndim
    for at in np.ndindex(x.shape):
        own = []
        for off in np.ndindex(*sizes):
            p = []
            for c, o, s, n in zip(at, off, sizes, x.shape, strict=True):
                k = (c - s // 2 + o) % (2 * n)
                p.append(k if k < n else 2 * n - 1 - k)
            own.append(x[tuple(p)])
        out[at] = fn(own)
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("shape", [(4, 6), (3, 4, 2)])
def test_filters(size, shape):
    x = np.random.RandomState(1).randn(*shape)
    assert_allclose(K.uniform_filter(x, size), brute(x, size, np.mean))
    assert_allclose(K.median_filter(x, size), brute(x, size, lambda w: sorted(w)[len(w) // 2]))


def test_gaussian():
    x = np.zeros((21, 21))
    x[10, 10] = 1
    g = K.gaussian_filter(x, 1.5)
    assert_allclose(g.sum(), 1)
    w = K.gaussian_weights(1.5, 0)
    assert_allclose(g[4:17, 4:17], np.outer(w, w))
    ramp = np.tile(np.arange(30.0), (30, 1))
    assert_allclose(K.gaussian_filter(ramp, [0, 1.0], 1)[:, 8:-8], 1, atol=1e-3)


def test_filters_of_collections(spark):
    a = np.random.RandomState(0).randn(2, 4, 6)
    x = readers.images_from_array(spark, a)
    assert_allclose(x.uniform_filter(3).toarray(), [K.uniform_filter(i, 3) for i in a])
    assert_allclose(x.median_filter((2, 3)).toarray(), [K.median_filter(i, (2, 3)) for i in a])
    assert_allclose(x.gaussian_filter(2).toarray(), x.gaussian_filter((2, 2)).toarray())
    v = np.random.RandomState(0).randn(1, 3, 4, 2)
    planes = readers.images_from_array(spark, v).median_filter([2, 2, 0]).toarray()
    assert_allclose(planes, np.stack([K.median_filter(v[0, :, :, z], 2) for z in range(2)], axis=2))
    with pytest.raises(ValueError):
        x.uniform_filter((1, 2, 3))


def test_projection_subsample_subtract(spark):
    a = np.random.RandomState(0).randn(2, 3, 4, 5)
    x = readers.images_from_array(spark, a)
    for axis in range(3):
        assert_allclose(x.max_projection(axis).toarray(), a.max(axis + 1))
        assert_allclose(x.max_min_projection(axis).toarray(), a.max(axis + 1) + a.min(axis + 1))
    with pytest.raises(ValueError):
        readers.images_from_array(spark, a[0]).max_projection(2)
    assert_allclose(x.subsample((1, 2, 3)).toarray(), a[:, :, ::2, ::3])
    b = np.arange(24).reshape(1, 4, 6)
    assert readers.images_from_array(spark, b).subsample(2).toarray().tolist() == [[0, 2, 4], [12, 14, 16]]
    assert (readers.images_from_array(spark, b).subtract(1).toarray() == b[0] - 1).all()
    assert (readers.images_from_array(spark, b).subtract(np.ones((4, 6))).toarray() == b[0] - 1).all()
    with pytest.raises(ValueError):
        readers.images_from_array(spark, b).subtract(np.ones((6, 4)))


def test_shapes(spark):
    a = np.arange(72).reshape(2, 6, 6)
    x = readers.images_from_array(spark, a)
    assert (x.reshape(2, 4, 9).toarray() == a.reshape(2, 4, 9)).all()
    for bad in ((2, 36), (1, 72, 1), (3, 4, 6), (2, 6, 7)):
        with pytest.raises(ValueError):
            x.reshape(*bad)
    assert readers.images_from_array(spark, np.zeros((10, 1, 1))).squeeze().value_shape == (1,)
    s = x.toseries()
    assert s.shape == (6, 6, 2) and (s.toarray() == np.moveaxis(a, 0, -1)).all()
    assert (s.toimages().toarray() == a).all()


def test_localcorr(spark):
    a = np.random.RandomState(3).randn(6, 4, 5)
    b = np.stack([K.uniform_filter(i, 2) for i in a])
    want = [[np.corrcoef(a[:, i, j], b[:, i, j])[0, 1] for j in range(5)] for i in range(4)]
    assert_allclose(readers.images_from_array(spark, a).localcorr(2), want)


def test_tile_plan():
    assert tile_sizes((5, 5), (100, 100), "int16") == (5, 5)
    assert tile_sizes("1", (100, 100), "int16") == (5, 100)
    assert tile_sizes("0.001", (100, 100), "int16") == (1, 1)
    assert tile_sizes("100", (100, 100), "int16") == (100, 100)
    assert tile_sizes(7, (100, 100), "int16") == (7, 7)


@pytest.mark.parametrize("padding", [None, 1, (0, 1), (1, 1)])
def test_blocks(spark, padding):
    a = np.arange(60).reshape(2, 5, 6)
    x = readers.images_from_array(spark, a)
    b = x.toblocks((2, 3), padding=padding)
    assert b.count() == 6 and b.blockshape == (2, 2, 3)
    assert (b.toimages().toarray() == a).all() and (b.toarray() == a).all()
    assert (b.toseries().toarray() == np.moveaxis(a, 0, -1)).all()
    shapes = [c.shape for c in b.collect_blocks()]
    p = (0, 0) if padding is None else (padding, padding) if isinstance(padding, int) else padding
    assert shapes == [(2, min(5, r + 2 + p[0]) - max(0, r - p[0]), min(6, c + 3 + p[1]) - max(0, c - p[1])) for r in (0, 2, 4) for c in (0, 3)]
    assert (b.map(lambda y: y + 1).toimages().toarray() == a + 1).all()
    assert b.map_generic(lambda y: y.shape)[0, 0] == shapes[0]
    assert (b.first() == b.collect_blocks()[0]).all()


def test_block_errors_and_map_as_series(spark):
    a = np.arange(80).reshape(5, 4, 4)
    x = readers.images_from_array(spark, a)
    with pytest.raises(ValueError):
        x.toblocks((2, 2), padding=3)
    with pytest.raises(ValueError):
        x.toblocks((4, 4), padding=1)
    assert (x.map_as_series(lambda v: v - v.mean()).toarray() == a - a.mean(0)).all()
    assert x.map_as_series(lambda v: v[:3], chunk_size=(2, 2)).shape == (3, 4, 4)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_block_queries_see_all_images(spark):
    d = "/root/testdata/sf0.001"
    total = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("sum(aggregate(embedding, 0D, (a, x) -> a + x)) AS x", "sum(size(embedding)) AS n").first()
    found = catalogue.queries()
    assert abs(sum(r.value for r in found["collect_blocks"](spark, d).collect()) - total.x) < 1e-4
    rows = found["blocks_map_generic"](spark, d).collect()
    assert sum(r.n for r in rows) == total.n and abs(sum(r.value for r in rows) - total.x) < 1e-4
