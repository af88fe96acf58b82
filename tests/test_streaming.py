import numpy as np
from numpy.testing import assert_allclose

from voxelframe.plans.meta import Meta
from voxelframe.streaming import records


def test_stream(spark, tmp_path):
    a = np.random.RandomState(0).randn(6, 4)
    for k in range(3):
        spark.createDataFrame([(i, a[i].tolist()) for i in range(2 * k, 2 * k + 2)], "k0 long, values array<double>").write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("k0 long, values array<double>").parquet(str(tmp_path / "in/*"))
    out = records.transform(stream, Meta((6,), (4,), np.dtype("float64")), lambda s: s.center(1).subsample(2))
    q = out.writeStream.format("memory").queryName("centred").outputMode("append").start()
    stats = records.statistics(stream, "mean", "max").writeStream.format("memory").queryName("stats").outputMode("complete").start()
    for x in (q, stats):
        x.processAllAvailable()
        x.stop()
    got = {r.k0: r["values"] for r in spark.table("centred").collect()}
    assert_allclose([got[i] for i in range(6)], (a - a.mean(1, keepdims=True))[:, ::2])
    rows = sorted(spark.table("stats").collect())
    assert_allclose([r["mean"] for r in rows], a.mean(0))
    assert_allclose([r["max"] for r in rows], a.max(0))
