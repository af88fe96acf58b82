"""Connected components of a graph given by its edges, by rounds of joins; nothing is gathered to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe import session
from voxelframe.session import input_bytes, shuffle_partitions

#: Bytes of written tables that go to each task beside a larger table, at most, and that a partition is made for.
FEW, SHARE = 8 << 20, 1 << 20


def keep(df: DataFrame, name: str) -> DataFrame:
    """As the session's, and the shuffle files behind the written table go at once: nothing reads them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return session.keep(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def few(written: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its files have at most FEW bytes; larger ones are joined by shuffles."""
    return F.broadcast(written) if 0 < input_bytes(written) <= FEW else written


def partitions(written: DataFrame) -> int:
    """Into how many partitions rows made of a written table are dealt: one for each SHARE, as many as the session's at most."""
    size = input_bytes(written)
    most = shuffle_partitions(written.sparkSession)
    return min(most, 1 + size // SHARE) if size else most


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of `edges` (a, b); a component is its smallest node.

    Each round gives every node the least label around it, then the label of its label, so paths shorten by more than
    half; it ends when nothing changes. Rounds are written to shared storage, which cuts the lineage.
    """
    n = partitions(edges)
    both = edges.select("a", "b").where("a != b").repartition(n, "a", "b").distinct()
    both = keep(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = keep(both.repartition(n, "a").groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        around = both.join(few(labels), both.b == labels.node).select(F.col("a").alias("node"), "component").repartition(n, "node").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.repartition(n, "node").join(around, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("then"))
        new = keep(step.repartition(n, "next").join(jump.repartition(n, "next"), "next").select("node", F.col("then").alias("component"), (F.col("then") < F.col("component")).alias("changed")), "labels")
        labels = new.select("node", "component")
        if new.where("changed").isEmpty():
            return labels
