import numpy as np
import pytest
from numpy.testing import assert_allclose
from pyspark.sql import functions as F

from voxelframe.sources import readers


def test_subscripts(spark):
    a = np.arange(2 * 3 * 4).reshape(2, 3, 4)
    x = readers.series_from_array(spark, a)
    for item in (0, slice(None, None, -1), (slice(0, 2), 1), (1, slice(None), [0, 3]), (slice(None), [2, 0, 2]), (Ellipsis, slice(1, 4, 2))):
        got = x[item].toarray(squeeze=False)
        want = a[tuple(slice(i, i + 1) if isinstance(i, int) else i for i in (item if isinstance(item, tuple) else (item,)))]
        assert (got == want).all(), item
    with pytest.raises(IndexError):
        x[5]


def test_elementwise(spark):
    a, b = np.array([[1, 2, 3], [4, 5, 6]]), np.array([[2, 0, 2], [1, 1, 4]])
    x, y = readers.series_from_array(spark, a), readers.series_from_array(spark, b)
    assert (x.plus(y).toarray() == a + b).all() and x.plus(y).dtype == np.int64
    assert (x.minus(y).toarray() == a - b).all() and (x.dottimes(y).toarray() == a * b).all()
    with np.errstate(divide="ignore"):
        assert_allclose(x.dotdivide(y).toarray(), a / b)
    assert_allclose(x.plus(1.5).toarray(), a + 1.5)
    with pytest.raises(ValueError):
        x.plus(readers.series_from_array(spark, a[:, :2]))


def test_map_reduce_stats(spark):
    a = np.arange(16).reshape(2, 8)
    x = readers.series_from_array(spark, a)
    assert (x.map(lambda v: v + 1).toarray() == a + 1).all()
    assert x.map(lambda v: v.sum()).shape == (2, 1)
    assert (x.map(lambda kv: kv[1] + kv[0][0], with_keys=True).toarray() == a + [[0], [1]]).all()
    for name in ("mean", "var", "std", "sum", "max", "min"):
        got = getattr(x, name)()
        assert got.shape == (1, 8)
        assert_allclose(got.toarray(), getattr(a, name)(axis=0))
    assert x.sum().dtype == np.int64 and x.mean().dtype == np.float64
    assert (x.reduce(np.add).toarray() == a.sum(0)).all()
    assert x.first().tolist() == a[0].tolist() and x.count() == 2
    f = readers.series_from_array(spark, np.array([[1.0, np.nan], [2.0, 3.0]]))
    assert np.isnan(f.min().toarray()[1]) and np.isnan(f.max().toarray()[1])


def test_casts_sampling_execution(spark):
    x = readers.series_from_array(spark, np.array([[1, 2, 3]], np.int16))
    for t in ("int64", "float32", "float64", "float16"):
        assert x.astype(t).toarray().dtype == np.dtype(t)
    with pytest.raises(TypeError):
        x.astype("int8", casting="safe")
    y = readers.series_from_array(spark, np.array([[300, -1]])).astype("uint8")
    assert y.toarray().tolist() == np.array([300, -1]).astype("uint8").tolist()
    z = readers.series_from_random(spark, (50, 4), 3)
    assert z.sample(7, seed=1).shape == (7, 4) and (z.sample(7, seed=1).toarray() == z.sample(7, seed=1).toarray()).all()
    assert z.sample(200).count() == 50
    with pytest.raises(ValueError):
        z.sample(0)
    assert z.repartition(2).npartitions() == 2 and z.repartition(4).coalesce(1).npartitions() == 1
    with pytest.raises(ValueError):
        z.coalesce(1000)
    z.cache()
    assert z.iscached()
    z.uncache()
    assert not z.iscached()
    z.compute()


def test_filter(spark):
    a = np.arange(12.0).reshape(4, 3) % 5
    x = readers.series_from_array(spark, a, labels=np.array([7, 8, 9, 10]))
    got = x.filter(lambda v: v[-1] > 1)
    assert (got.toarray() == a[a[:, -1] > 1]).all() and got.labels().tolist() == (np.array([7, 8, 9, 10])[a[:, -1] > 1]).tolist()
    assert (x.filter(where=lambda v: F.element_at(v, -1) > 1).toarray() == a[a[:, -1] > 1]).all()
    with pytest.raises(ValueError):
        x.filter()
    with pytest.raises(Exception, match="ZeroDivisionError"):
        x.filter(lambda v: 1 / 0).count()


def test_concatenate_and_local(spark):
    a = np.arange(6).reshape(2, 3)
    x, y = readers.series_from_array(spark, a, index=["p", "q", "r"]), readers.series_from_array(spark, a * 0.5)
    both = x.concatenate(y, x)
    assert both.shape == (6, 3) and both.dtype == np.float64 and (both.toarray() == np.concatenate([a, a * 0.5, a])).all()
    with pytest.raises(ValueError):
        x.concatenate(readers.series_from_array(spark, a[:, :2]))
    one = readers.series_from_array(spark, np.arange(4).reshape(4, 1), index=[9], labels=np.arange(4) * 2)
    local = one.tolocal()
    assert local.shape == (4, 1) and local.labels.tolist() == [0, 2, 4, 6]
    back = local.tospark(spark, 2)
    assert back.shape == (4, 1) and back.index == [9] and back.labels().tolist() == [0, 2, 4, 6] and (back.toarray(squeeze=False) == local.values).all()
    images = readers.images_from_array(spark, np.arange(8).reshape(2, 2, 2)).tolocal()
    assert (images.tospark(spark).toarray() == images.values).all()


def test_filter_of_nothing(spark):
    x = readers.series_from_array(spark, np.arange(6).reshape(2, 3))
    assert x.filter(lambda v: v.sum() > 100).toarray(squeeze=False).shape == (0, 3)


def test_readers(spark):
    x = readers.series_from_list(spark, [1, 2, 3], accessor=lambda i: np.arange(4) * i)
    assert (x.toarray() == np.outer([1, 2, 3], np.arange(4))).all()
    y = readers.images_from_list(spark, [np.eye(3), np.ones((3, 3))], labels=np.array([5, 6]))
    assert y.shape == (2, 3, 3) and y.labels().tolist() == [5, 6]
    z = readers.images_from_list(spark, ["b", "a"], accessor=lambda c: np.full((2, 2), ord(c)), keys=[(7,), (3,)], dims=(2, 2), dtype="int16")
    assert z.dtype == np.int16 and z.toarray()[:, 0, 0].tolist() == [97, 98]
    with pytest.raises(ValueError):
        readers.images_from_list(spark, [np.eye(2)], keys=[1, 2])
    with pytest.raises(ValueError):
        readers.images_from_list(spark, [np.eye(2)], dims=(3, 3))
    pairs = spark.sparkContext.parallelize([(1, np.arange(3)), (0, np.arange(3) + 5)], 2)
    assert readers.from_rdd(spark, pairs, "series", index=[4, 5, 6]).select(5).toarray().tolist() == [6, 1]
    pairs = spark.sparkContext.parallelize([((k,), np.eye(2) * k) for k in range(3)], 2)
    assert readers.from_rdd(spark, pairs, "images", shape=(3, 2, 2), labels=np.arange(3)).shape == (3, 2, 2)
    with pytest.raises(ValueError):
        readers.images_from_array(spark, [np.eye(2), np.eye(3)])
    with pytest.raises(ValueError):
        readers.images_from_array(spark, np.arange(3))
    r = readers.series_from_random(spark, (3, 5), seed=9).toarray()
    assert (r[2] == np.random.RandomState(11).randn(5)).all()
    assert readers.from_example(spark, "series") == ["waves", "steps"]
    assert readers.from_example(spark, "images", "steps").shape == (20, 24, 24)
    with pytest.raises(ValueError):
        readers.from_example(spark, "series", "none")
