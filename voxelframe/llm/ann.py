"""Approximate nearest neighbours by a hierarchical navigable small-world graph for each shard.

Equal vectors are one point that carries its smallest ids, so heavy copies neither unbalance a shard nor fill a point's
links. Points are dealt out by hash to shards of about `shard_rows`. A shard's graph is stored in a table as flat
arrays: vectors, ids, and for each level the members and a matrix of neighbours' places, padded with -1.

A graph has what insertion in order of place gives: a point is linked with a diverse choice of the nearest ones among
those before it, and these link back; early points are few and far apart, which makes long links. The nearest are found
exactly, by products of blocks, rather than by searching the graph that is being built.

A search goes greedily down the levels and best-first on the lowest, in every shard; the shards' results are merged and
scored by Euclidean distance in double precision.

Vectors of each length have shards of their own. Queries go to a shard in blocks of bounded size, each with a task of its
own.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null vec_id take no
part; vectors of different lengths are no candidates for each other; rows of one vec_id never are each other's neighbours; ties go to smaller
vec_ids; a query without other vectors has no rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.session import keep, ship, table

SHARD_ROWS, LINKS, BEAM = 8192, 16, 128
#: Query vectors that one task takes to one shard.
BLOCK = 2048


def diverse(candidates: np.ndarray, distance: np.ndarray, x: np.ndarray, most: int) -> list[int]:
    """Of candidates in order of distance, those that are nearer to the point than to any chosen one; then, if too few,
    the nearest others."""
    v = x[candidates]
    between = ((v[:, None, :] - v[None, :, :]) ** 2).sum(-1)
    near, chosen, rest = np.full(len(candidates), np.inf), [], []
    for k in range(len(candidates)):
        if len(chosen) == most:
            break
        if distance[k] < near[k]:
            chosen.append(k)
            np.minimum(near, between[k], out=near)
        else:
            rest.append(k)
    return candidates[chosen + rest[: most - len(chosen)]].tolist()


def graph(x: np.ndarray, links: int) -> np.ndarray:
    """Neighbours' places of each point, at most 2 * links, padded with -1."""
    n, wide = len(x), 4 * links
    square = (x**2).sum(1)
    out: list[list[int]] = [[] for _ in range(n)]
    for a in range(0, n, 512):
        b = min(n, a + 512)
        d = square[a:b, None] + square[None, :b] - 2 * x[a:b] @ x[:b].T
        d[np.arange(b)[None, :] >= np.arange(a, b)[:, None]] = np.inf
        near = np.argpartition(d, min(wide, b) - 1, axis=1)[:, :wide] if b > wide else np.broadcast_to(np.arange(b), (b - a, b))
        for i in range(a, b):
            c = near[i - a][near[i - a] < i]
            c = c[np.argsort(d[i - a, c], kind="stable")]
            for j in diverse(c, ((x[c] - x[i]) ** 2).sum(1), x, links) if len(c) else ():
                out[i].append(j)
                out[j].append(i)
    flat = np.full((n, 2 * links), -1, np.int32)
    for i, own in enumerate(out):
        if len(own) > 2 * links:
            c = np.array(own)
            d = ((x[c] - x[i]) ** 2).sum(1)
            order = np.argsort(d, kind="stable")
            own = diverse(c[order], d[order], x, 2 * links)
        flat[i, : len(own)] = own
    return flat


class Graph:
    """Levels of (members, neighbours), from the lowest; places on a level are places among its members."""

    def __init__(self, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.levels = x, levels

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS) -> Graph:
        rng = np.random.Generator(np.random.PCG64(len(x)))
        height = (-np.log(1 - rng.random(len(x))) / np.log(links)).astype(int)
        levels, members = [], np.arange(len(x))
        while True:
            levels.append((members.astype(np.int32), graph(x[members], links)))
            above = members[height[members] >= len(levels)]
            if not len(above):
                return cls(x, levels)
            members = above

    def search(self, q: np.ndarray, k: int, beam: int) -> list[tuple[float, int]]:
        """Squared distances and places of about the k nearest."""
        best = 0
        for level in range(len(self.levels) - 1, -1, -1):
            members, neighbours = self.levels[level]
            at = int(np.searchsorted(members, best))
            if level:
                d = ((self.x[members[at]] - q) ** 2).sum()
                while True:
                    c = neighbours[at][neighbours[at] >= 0]
                    e = ((self.x[members[c]] - q) ** 2).sum(1)
                    if not len(c) or e.min() >= d:
                        break
                    at, d = int(c[e.argmin()]), e.min()
                best = int(members[at])
        members, neighbours = self.levels[0]
        d = float(((self.x[best] - q) ** 2).sum())
        seen = np.zeros(len(self.x), bool)
        seen[best] = True
        todo, found = [(d, best)], [(-d, best)]
        while todo:
            d, at = heapq.heappop(todo)
            if d > -found[0][0] and len(found) >= beam:
                break
            c = neighbours[at]
            c = c[c >= 0]
            c = c[~seen[c]]
            seen[c] = True
            e = ((self.x[c] - q) ** 2).sum(1)
            if len(found) >= beam:
                own = e < -found[0][0]
                c, e = c[own], e[own]
            for dist, j in zip(e.tolist(), c.tolist(), strict=True):
                if len(found) < beam:
                    heapq.heappush(found, (-dist, j))
                elif dist < -found[0][0]:
                    heapq.heapreplace(found, (-dist, j))
                else:
                    continue
                heapq.heappush(todo, (dist, j))
        return sorted((-d, j) for d, j in found)[:k]

    def flat(self) -> list[np.ndarray]:
        return [x for level in self.levels for x in (level[0], level[1].reshape(-1))]


def points(vectors: DataFrame, copies: int) -> DataFrame:
    """Distinct vectors as double arrays, and at most `copies` ids of each, the smallest."""
    usable = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    own = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    def few(batches):
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                ids, x = np.asarray(part.column("vec_id")), np.asarray(part.column("v").flatten()).reshape(-1, size)
                order = np.lexsort((ids, np.unique(np.ascontiguousarray(x).view(f"V{8 * size}").reshape(-1), return_inverse=True)[1].reshape(-1)))
                x, ids = x[order], ids[order]
                head = np.ones(len(ids), bool)
                head[1:] = (x[1:] != x[:-1]).any(1)
                start = np.flatnonzero(head)
                yield pa.RecordBatch.from_arrays([part.column("v").take(pa.array(order[start])), pa.array([np.unique(i)[:copies].tolist() for i in np.split(ids, start[1:])], pa.list_(pa.int64()))], ["v", "ids"])

    merged = own.mapInArrow(few, "v array<double>, ids array<long>").groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, copies).alias("ids"))
    return merged


def build_index(vectors: DataFrame, copies: int, shard_rows: int = SHARD_ROWS, links: int = LINKS) -> DataFrame:
    """A row for each shard: vectors, ids and levels as flat arrays."""
    ship(vectors.sparkSession)
    own = keep(points(vectors, copies), "points")
    shards = max(1, -(-own.count() // shard_rows))

    def build(key, t):
        x = np.asarray(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1)
        # Rows come in any order; in order of hash a shard that is built again is the same.
        order = np.argsort(np.array([i[0] for i in t["ids"].to_pylist()]) * 0x9E3779B1 % (1 << 32), kind="stable")
        t, x = t.take(pa.array(order)), np.ascontiguousarray(x[order])
        levels = Graph.build(x, links).flat()
        return pa.table({
            "shard": pa.array([key[1].as_py()], pa.int32()), "x": pa.array([x.astype("<f8").tobytes()]), "dim": pa.array([x.shape[1]], pa.int32()),
            "ids": pa.array([t["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))), "levels": pa.array([[a.astype("<i4").tobytes() for a in levels]], pa.list_(pa.binary())),
        })

    dealt = own.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return keep(dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "shard int, x binary, dim int, ids array<array<long>>, levels array<binary>"), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, links: int = LINKS) -> DataFrame:
    """For distinct query vectors (v array<double>), the best k found in any shard as found: array of (score, vec_id),
    in order."""
    last = index.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    blocks = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    asked = queries.select("v", F.size("v").alias("dim"), block, F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"))
    shards = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    task = ["dim", "shard", "block"]

    def look(key, shard, asked):
        rows = []
        if shard.num_rows and asked.num_rows:
            s = shard.to_pylist()[0]
            x = np.frombuffer(s["x"], "<f8").reshape(-1, s["dim"])
            flat = [np.frombuffer(a, "<i4") for a in s["levels"]]
            g = Graph(x, [(m, n.reshape(len(m), 2 * links)) for m, n in zip(flat[::2], flat[1::2], strict=True)])
            for v in asked["v"].to_pylist():
                found = [(float(np.sqrt(d)), i) for d, p in g.search(np.array(v), k, max(beam, k)) for i in s["ids"][p]]
                rows.append({"v": v, "found": [{"score": a, "vec_id": b} for a, b in sorted(found)[:k]]})
        return pa.Table.from_pylist(rows, pa.schema([("v", pa.list_(pa.float64())), ("found", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))]))

    each = shards.groupBy(*task).cogroup(asked.groupBy(*task)).applyInArrow(look, "v array<double>, found array<struct<score: double, vec_id: long>>")
    return each.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest found of each row of `vectors` (vec_id, embedding) whose vec_id is divisible by `every`, among all
    other rows: query_id, rank, vec_id, score."""
    index = build_index(vectors, k + 1, shard_rows)
    points_ = vectors.where((F.col("vec_id") % every) == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v")).distinct()
    usable = points_.where("v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    asked = keep(usable, "queries")
    found = keep(search(index, asked.select("v").distinct(), k + 1, beam), "found")
    others = asked.join(found, "v").select("query_id", F.slice(F.expr("filter(found, f -> f.vec_id <> query_id)"), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
