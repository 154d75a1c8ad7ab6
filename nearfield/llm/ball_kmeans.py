"""Centroid clustering by ball k-means over integer vectors.

A cluster is a ball: its centroid, and the distance to its farthest member as radius. After the
centroids have moved, a member can only change to a centroid whose distance from its own
is at most twice its own distance. So centroids beyond twice the radius are no neighbours of a
ball at all; members nearer than half the way to the first neighbour are its stable core and
keep their cluster; the rest lie in annuli between the half ways to one neighbour and to the
next, and are compared with the neighbours inside their annulus only. All of it is exact.

Vectors travel in blocks of ``BLOCK`` rows with the cluster of each; a block has its own balls (of the members that it
holds), whose radii are those of the ball or less. Blocks stay where they are through all rounds: a round passes
over them once and shuffles sums by cluster and component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ship import ship
from ._spark import checkpointed
from ._vectors import exact, integers, slices


def most(dim: int) -> int:
    """The largest integer component: four times a squared distance fits 64 bits (2**26 for 64 components)."""
    return math.isqrt((1 << 58) // max(1, dim))


BLOCKS = "ids array<long>, x binary, own binary, dist binary, slots array<long>, totals array<long>, compared long"


@dataclass
class Clusters:
    """Final centroids, one row of integers each, and (vec_id, cluster, distance) blocks of all vectors."""

    centroids: np.ndarray
    blocks: DataFrame
    #: Distances taken by all rounds, the last assignment included, and those that comparing with every centroid takes.
    compared: int
    every: int

    def members(self) -> DataFrame:
        """(vec_id, cluster, distance): one row a vector."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, own, dist in zip(batch["ids"], batch["own"], batch["dist"], strict=True):
                    yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(own.as_py(), np.int32)), pa.array(np.frombuffer(dist.as_py(), np.int64))], names=["vec_id", "cluster", "distance"])

        return self.blocks.mapInArrow(run, "vec_id long, cluster int, distance long")

    def inertia(self) -> dict[int, int]:
        """Summed distance of each cluster that has members."""
        n = len(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n, dtype=np.int64)
            for batch in batches:
                for own, dist in zip(batch["own"], batch["dist"], strict=True):
                    np.add.at(total, np.frombuffer(own.as_py(), np.int32), np.frombuffer(dist.as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cluster", "total"])

        found = self.blocks.select("own", "dist").mapInArrow(run, "cluster long, total long").groupBy("cluster").agg(F.sum("total").alias("total")).collect()
        return {r.cluster: r.total for r in found}


def _blocks(scale: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, vectors = integers(part["embedding"], scale, most(dim))
            fit = [i for i, v in enumerate(vectors) if len(v) == dim]
            if fit:
                ids = part["vec_id"].take(pa.array(rows[fit]))
                x = np.array([vectors[i] for i in fit], dtype=np.int32)
                yield _block(ids, x, np.full(len(fit), -1, dtype=np.int32))

    return run


def _block(ids: pa.Array, x: np.ndarray, own: np.ndarray, dist: np.ndarray | None = None, slots=(), totals=(), compared: int = 0) -> pa.RecordBatch:
    lists = lambda values: pa.array([values], pa.list_(pa.int64()))
    held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns = [held, pa.array([x.tobytes()]), pa.array([own.tobytes()]), pa.array([b"" if dist is None else dist.tobytes()]), lists(slots), lists(totals), pa.array([compared])]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "x", "own", "dist", "slots", "totals", "compared"])


def _draws(dim: int, size: int, seed: int):
    """The vectors of least hash of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in zip(batch["ids"], batch["x"], strict=True):
                hashes = [("" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()) for i in ids.as_py()]
                v = np.frombuffer(x.as_py(), np.int32).reshape(-1, dim)
                # vectors without an id are not drawn; rows of one id are drawn in the order of their components
                least = sorted((h, v[i].tolist()) for i, h in enumerate(hashes) if h)[:size]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in least], pa.string()), pa.array([v for _, v in least], pa.list_(pa.int64()))], names=["hash", "v"])

    return run


def drawn(blocks: DataFrame, dim: int, size: int, seed: int) -> np.ndarray:
    """The ``size`` vectors (all, if fewer) of least SHA-256 of ``seed:vec_id``, in that order."""
    rows = blocks.select("ids", "x").mapInArrow(_draws(dim, size, seed), "hash string, v array<long>").orderBy("hash", "v").limit(size).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), dim)


def assign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances taken), ties to the smaller number.

    ``own`` is the cluster that each vector had before the centroids moved, or -1.
    """
    xs, cs = exact(x.astype(np.int64), centroids)
    norms, squares = (xs * xs).sum(1), (cs * cs).sum(1)
    far = lambda rows, j: norms[rows] - 2 * (xs[rows] @ cs[j]) + squares[j]
    cluster, best = own.astype(np.int64), np.zeros(len(x), dtype=xs.dtype)
    between = squares[:, None] + squares[None] - 2 * cs @ cs.T
    taken = 0
    new = np.flatnonzero(own < 0)
    if len(new):
        every = norms[new][:, None] - 2 * xs[new] @ cs.T + squares[None]
        cluster[new] = np.argmin(every, axis=1)
        best[new] = every[np.arange(len(new)), cluster[new]]
        taken += every.size
    for i in np.unique(own[own >= 0]).tolist():
        members = np.flatnonzero(own == i)
        mine = far(members, i)
        best[members] = mine
        taken += len(members)
        # neighbours of the ball, nearest first
        near = np.flatnonzero(between[i] <= 4 * mine.max())
        near = near[near != i]
        near = near[np.argsort(between[i][near], kind="stable")]
        # how many neighbours a member's annulus reaches; none for the stable core
        reach = np.searchsorted(between[i][near], 4 * mine, "right")
        for t, j in enumerate(near.tolist()):
            some = members[reach > t]
            d = far(some, j)
            taken += len(some)
            better = (d < best[some]) | ((d == best[some]) & (j < cluster[some]))
            cluster[some[better]], best[some[better]] = j, d[better]
    return cluster.astype(np.int32), best.astype(np.int64), taken


def _round(centroids: np.ndarray, last: bool):
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, own in zip(batch["ids"], batch["x"], batch["own"], strict=True):
                v = np.frombuffer(x.as_py(), np.int32).reshape(-1, dim)
                cluster, dist, taken = assign(v, np.frombuffer(own.as_py(), np.int32), centroids)
                total = np.zeros((k, dim + 1), dtype=np.int64)
                if not last:
                    for j in np.unique(cluster).tolist():
                        held = v[cluster == j]
                        total[j] = [*held.sum(0, dtype=np.int64), len(held)]
                slots = np.flatnonzero(total)
                yield _block(ids.values, v[:0] if last else v, cluster, dist, slots, total.ravel()[slots], taken)

    return run


def cluster(rows: DataFrame, size: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> Clusters:
    """Cluster (vec_id, embedding) rows as integer vectors floor(scale * x).

    Vectors of another length than ``dim``, null ones, and those with null or non-finite components take no part. Centroids
    start as the ``size`` vectors of least SHA-256 of ``seed:vec_id``; in each round every vector goes to its nearest
    centroid (ties: the smaller number), then each centroid becomes the componentwise floor of its vectors'
    mean, and empty ones stay. At the end vectors are assigned once more. Rows that repeat a vec_id count each; a null
    vec_id is clustered, but never a start. Fewer vectors than ``size`` give as many clusters; none, no rows.
    Components beyond ``most(dim)`` / scale (65,536 by default) are an error. Only centroids and sums by cluster come to the driver.
    """
    spark = rows.sparkSession
    ship(spark)
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("embedding is not null")
    held = base.mapInArrow(_blocks(scale, dim), BLOCKS).persist()
    centroids = drawn(held, dim, size, seed)
    compared = every = 0
    if not len(centroids):
        held.unpersist()
        return Clusters(centroids, spark.createDataFrame([], BLOCKS), 0, 0)
    for step in range(rounds + 1):
        last = step == rounds
        now = held.mapInArrow(_round(centroids, last), BLOCKS)
        # a lost executor's blocks are computed again, round by round, from the table
        now = checkpointed(now.select("ids", "own", "dist", "compared", F.lit(None).alias("slots"), F.lit(None).alias("totals"))) if last else now.persist()
        compared += now.agg(F.sum("compared")).first()[0]
        if not last:
            sums = now.select(F.explode(F.arrays_zip("slots", "totals")).alias("z")).groupBy("z.slots").agg(F.sum("z.totals").alias("total")).collect()
            total = np.zeros(len(centroids) * (dim + 1), dtype=np.int64)
            for r in sums:
                total[r.slots] = r.total
            total = total.reshape(len(centroids), dim + 1)
            full = total[:, -1] > 0
            every += int(total[:, -1].sum()) * len(centroids)
            centroids = centroids.copy()
            centroids[full] = total[full, :-1] // total[full, -1:]
        held.unpersist()
        held = now
    every += every // max(rounds, 1)
    return Clusters(centroids, held.select("ids", "own", "dist"), compared, every)


def written(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def report(found: Clusters) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row a vector.

    What belongs to a cluster goes out as constants: there are as many as clusters.
    """
    sums = found.inertia()
    of_cluster = [sums.get(j, 0) for j in range(len(found.centroids))]
    hashes = [written(c) for c in found.centroids]
    rows = found.members()
    pick = lambda values, kind: F.element_at(F.lit(values) if values else F.array().cast(f"array<{kind}>"), F.col("cluster") + 1).cast(kind)
    return rows.select("vec_id", "cluster", "distance", pick(of_cluster, "long").alias("cluster_inertia"), F.lit(sum(of_cluster)).cast("long").alias("inertia"), pick(hashes, "string").alias("centroid_sha256"))


def sql(size: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """DuckDB form; {embeddings} names the table."""
    far = "list_sum(list_transform(list_zip(x, cen), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    near = lambda i: f"SELECT * FROM (SELECT v.rn, vec_id, x, c, cen, {far} AS d, row_number() OVER (PARTITION BY v.rn ORDER BY {far}, c) AS pick FROM v, c{i}) WHERE pick = 1"
    parts = [
        f"f AS (SELECT vec_id, embedding FROM {{embeddings}} WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {dim})",
        f"v AS (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda y: CAST(floor({scale} * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM f)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS cen FROM (SELECT x, sha256('{seed}:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {size}))",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} AS MATERIALIZED ({near(i)})",
            f"u{i} AS (SELECT c, generate_subscripts(x, 1) AS pos, unnest(x) AS y FROM a{i})",
            f"s{i} AS (SELECT c, pos, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM u{i} GROUP BY ALL)",
            f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS cen FROM s{i} GROUP BY c)",
            f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.cen, o.cen) AS cen FROM c{i} o LEFT JOIN m{i} m USING (c))",
        ]
    parts.append(f"a AS MATERIALIZED ({near(rounds)})")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(cen, ',')) AS centroid_sha256 FROM a
"""
