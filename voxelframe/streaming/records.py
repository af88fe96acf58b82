"""Per-record operators on a stream.

They are projections without state, so a streaming DataFrame of records (k0.., values) goes through the same code as a
batch one. Statistics across records keep one row of state for each position and are written in complete mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.operators.series import Series
from voxelframe.plans.meta import Meta


def transform(stream: DataFrame, meta: Meta, fn: Callable[[Series], Series]) -> DataFrame:
    """The records that fn makes of a stream's; fn uses per-record operators."""
    return fn(Series(stream, meta)).df


def statistics(stream: DataFrame, *functions: str) -> DataFrame:
    """Running statistics of each position: pos and a column for each of mean, var, std, sum, max, min, count."""
    known = {"mean": F.avg, "var": F.var_pop, "std": F.stddev_pop, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    cells = stream.select(F.posexplode("values").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))
    return cells.groupBy("pos").agg(*[known[f]("value").alias(f) for f in functions or ("mean",)])
