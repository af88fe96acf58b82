import numpy as np
import pytest
from numpy.testing import assert_allclose

from voxelframe.sources import readers


def make(spark, values, **more):
    return readers.series_from_array(spark, np.array(values), **more)


def test_standardize_zscore_center(spark):
    x = make(spark, [[1, 2, 3, 4, 5]])
    a = np.arange(1, 6)
    assert_allclose(x.standardize(1).toarray(), a / a.std())
    assert_allclose(x.zscore(1).toarray(), (a - 3) / a.std())
    y = make(spark, [[1, 2], [3, 4]])
    assert_allclose(y.center(0).toarray(), [[-1, -1], [1, 1]])
    assert_allclose(y.standardize(0).toarray(), [[1, 2], [3, 4]])
    with pytest.raises(ValueError):
        y.center(2)


def test_constant_records_give_nan_not_errors(spark):
    x = make(spark, [[2.0, 2.0, 2.0], [1.0, 2.0, 4.0]])
    z = x.zscore(1).toarray()
    assert np.isnan(z[0]).all() and np.isfinite(z[1]).all()
    assert np.isnan(x.correlate([1, 2, 3]).toarray()[0])
    assert_allclose(x.crosscorr([1, 2, 3], 1).toarray()[0], [0, 0, 0])


def test_squelch_correlate_clip(spark):
    assert_allclose(make(spark, [[1, 2], [3, 4]]).squelch(3).toarray(), [[0, 0], [3, 4]])
    x = make(spark, [[1, 2, 3, 4, 5]])
    r = x.correlate([[4, 5, 6, 7, 8], [8, 7, 6, 5, 4]])
    assert_allclose(r.toarray(), [1, -1])
    assert x.correlate([4, 5, 6, 7, 8]).index == [1]
    assert_allclose(x.clip(2, 4).toarray(), [2, 2, 3, 4, 4])
    with pytest.raises(ValueError):
        x.correlate([1, 2])


def test_normalize(spark):
    x = make(spark, [[1, 2, 3, 4, 5]])
    a = np.arange(1, 6)

    def to(b):
        b = np.array(b)
        return (a - b) / (b + 0.1)

    assert_allclose(x.normalize("percentile", perc=20).toarray(), to(1.8))
    assert_allclose(x.normalize("mean").toarray(), to(3))
    for w in (2, 5):
        assert_allclose(x.normalize("window", window=w, perc=20).toarray(), to([1, 1, 2, 3, 4]))
    assert_allclose(x.normalize("window-exact", window=2, perc=20).toarray(), to([1.2, 1.4, 2.4, 3.4, 4.2]))
    assert_allclose(x.normalize("window-exact", window=6, perc=20).toarray(), to([1.6, 1.8, 1.8, 1.8, 2.6]))


def test_detrend(spark):
    assert_allclose(make(spark, [[1, 2, 3, 4, 5]]).detrend().toarray(), np.ones(5), atol=1e-9)
    y = np.random.RandomState(0).randn(12)
    t = np.arange(12)
    c = np.polynomial.polynomial.polyfit(t, y, 5)
    assert_allclose(make(spark, [y]).detrend("nonlinear", 5).toarray(), y - sum(c[k] * t**k for k in range(1, 6)), atol=1e-8)


@pytest.mark.parametrize("n", [9, 8])
def test_fourier(spark, n):
    y = np.array([1, 2, -4, 5, 8, 3, 4.1, 0.9, 2.3])[:n]
    f = np.fft.fft(y - y.mean())[: n // 2]
    amp = np.abs(f)
    phase = -np.pi / 2 - np.angle(f[2])
    got = make(spark, [y]).fourier(2)
    assert_allclose(got.toarray(), [amp[2] / np.sqrt((amp**2).sum()), phase + 2 * np.pi * (phase < 0)])
    assert got.index == ["coherence", "phase"]
    if n == 9:
        assert_allclose(got.toarray(), [0.578664, 4.102501], atol=1e-5)
    with pytest.raises(ValueError):
        make(spark, [y]).fourier(n // 2)


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
@pytest.mark.parametrize("m", [2, 3, 4, 7])
def test_convolve(spark, mode, m):
    s = np.arange(1.0, m + 1)
    assert_allclose(make(spark, [[1, 2, 3, 4, 5]]).convolve(s, mode).toarray(), np.convolve([1, 2, 3, 4, 5], s, mode))


def test_crosscorr(spark):
    y = [1, 2, -4, 5, 8, 3, 4.1, 0.9, 2.3]
    s = [1.5, 2.1, -4.2, 5.6, 8.1, 3.9, 4.2, 0.3, 2.1]
    got = make(spark, [y]).crosscorr(s, 2)
    assert_allclose(got.toarray(), [-0.18511, 0.03817, 0.99221, 0.06567, -0.25750], atol=2e-5)
    assert got.index == [-2, -1, 0, 1, 2]
    assert_allclose(make(spark, [y]).crosscorr(s, 0).toarray(), np.corrcoef(y, s)[0, 1])


def test_windows_and_panels(spark):
    x = make(spark, [range(7)])
    for w, want in ((2, [3, 4]), (3, [3, 4, 5]), (4, [2, 3, 4, 5])):
        assert_allclose(x.mean_by_window([3, 5], w).toarray(), want)
    assert_allclose(x.mean_by_window([3], 4).toarray(), [1, 2, 3, 4])
    with pytest.raises(ValueError):
        x.mean_by_window([6], 4)
    p = make(spark, [range(8)])
    assert_allclose(p.mean_by_panel(4).toarray(), [2, 3, 4, 5])
    assert_allclose(p.mean_by_panel(2).toarray(), [3, 4])
    with pytest.raises(ValueError):
        p.mean_by_panel(3)


def test_down_and_subsample(spark):
    assert_allclose(make(spark, [range(8)]).downsample(2).toarray(), [0.5, 2.5, 4.5, 6.5])
    assert_allclose(make(spark, [range(9)]).downsample(2).toarray(), [0.5, 2.5, 4.5, 6.5])
    x = make(spark, [range(8)]).subsample(3)
    assert x.toarray().tolist() == [0, 3, 6] and x.index == [0, 3, 6]
    with pytest.raises(ValueError):
        make(spark, [range(8)]).downsample(0)


def test_by_index(spark):
    x = make(spark, [range(12)], index=[0] * 4 + [1] * 4 + [2] * 4)
    assert x.sum_by_index().toarray().tolist() == [6, 22, 38]
    assert x.mean_by_index().toarray().tolist() == [1.5, 5.5, 9.5]
    assert x.median_by_index().toarray().tolist() == [1.5, 5.5, 9.5]
    assert x.count_by_index().toarray().tolist() == [4, 4, 4]
    assert x.min_by_index().toarray().tolist() == [0, 4, 8] and x.max_by_index().toarray().tolist() == [3, 7, 11]
    assert_allclose(x.std_by_index().toarray(), [np.std(range(4))] * 3)
    assert x.aggregate_by_index(lambda v: v.sum()).toarray().tolist() == [6, 22, 38]
    assert x.select_by_index(1).toarray().tolist() == [4, 5, 6, 7]
    assert x.select_by_index(1, squeeze=True).index == [0, 1, 2, 3]
    assert x.select_by_index([0, 2], filter=True).toarray().tolist() == [4, 5, 6, 7]
    with pytest.raises(ValueError):
        x.sum_by_index(level=1)


def test_multi_index(spark):
    index = [[0, 1, 0], [0, 1, 0], [0, 0, 0], [0, 0, 1]] + [[0, 1, 1]] * 2 + [[1, 0, 0], [1, 0, 1]] + [[1, 1, k % 2] for k in range(4)]
    x = make(spark, [range(12)], index=index)
    got = x.sum_by_index(level=[0, 1])
    want = {}
    for i, v in zip(index, range(12), strict=True):
        want[i[0], i[1]] = want.get((i[0], i[1]), 0) + v
    assert got.index == sorted(want) and got.toarray().tolist() == [want[k] for k in sorted(want)]
    y, mask = x.select_by_index([[1], [0, 1]], level=[0, 2], squeeze=True, return_mask=True)
    assert mask.sum() == 6 and y.index == [(i[1], i[2]) for i in index if i[0] == 1]


def test_select_and_index(spark):
    x = make(spark, [[4, 5, 6, 7], [8, 9, 10, 11]], index=["a", "b", "c", "d"])
    assert x.select("b").toarray().tolist() == [5, 9]
    assert x.select(["a", "d"]).toarray().tolist() == [[4, 7], [8, 11]]
    assert x.select(lambda i: i > "b").index == ["c", "d"]
    with pytest.raises(ValueError):
        x.select("z")
    with pytest.raises(ValueError):
        x.with_index([1, 2])
    assert make(spark, [[4, 5, 6, 7]]).between(0, 2).toarray().tolist() == [4, 5]


def test_matrices(spark):
    a = np.array([[1, 2, 3], [4, 5, 6]])
    x = make(spark, a)
    m = np.array([[1, 2], [3, 4], [5, 6]])
    assert_allclose(x.times(m).toarray(), a @ m)
    assert_allclose(x.times([1, 2, 3]).toarray(), a @ [1, 2, 3])
    assert_allclose(x.times(2).toarray(), a * 2)
    assert_allclose(x.gramian().toarray(), a.T @ a)
    assert_allclose(x.cov().toarray(), np.cov(a.T))
    with pytest.raises(ValueError):
        x.times([1, 2])


def test_shapes_and_labels(spark):
    a = np.arange(20).reshape(2, 2, 5)
    x = make(spark, a, labels=np.array([[0, 1], [2, 3]]))
    assert x.flatten().shape == (4, 5) and x.flatten().labels().tolist() == [0, 1, 2, 3]
    assert (x.flatten().reshape(2, 2, 5).toarray() == a).all()
    with pytest.raises(ValueError):
        x.reshape(5, 4)
    kept = x.filter(lambda v: v.sum() > 30)
    assert kept.labels().tolist() == [1, 2, 3] and kept.shape == (3, 5)
    assert x[1:, 0].labels().tolist() == [[2]] and x[1:, 0].shape == (1, 1, 5)
    assert (x.toimages().toarray() == np.moveaxis(a, -1, 0)).all()
    with pytest.raises(ValueError):
        x.with_labels(np.arange(3))
