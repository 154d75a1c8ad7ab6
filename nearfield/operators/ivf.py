"""Inverted lists: build, probe, search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cluster_key
from ..sources.ship import ship
from ..sources.tables import checkpointed, fingerprint, load_index, save_index
from .flat import QUERY_BLOCK, Kernel, asked, matrix, metric_kernel, query_blocks, query_parts, scan
from .kmeans import assign, first_rows, lloyd
from .partition import numbered
from .topk import ranked, vector_columns


@dataclass
class IVF:
    """Centroids, and rows (vec_id, v, list_id)."""

    centroids: np.ndarray
    lists: DataFrame

    def table(self) -> DataFrame:
        """(list_id, centroid)."""
        return self.lists.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)], "list_id long, centroid array<double>")

    def sizes(self) -> DataFrame:
        """(list_id, size, first): sizes and offsets of all lists, empty ones too."""
        n = self.lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("size"))
        every = self.lists.sparkSession.range(len(self.centroids)).withColumnRenamed("id", "list_id").join(n, "list_id", "left").fillna(0, ["size"])
        # one row a list: their number is a parameter
        return every.withColumn("first", F.sum("size").over(W.orderBy("list_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))


def with_list(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (vec_id, v) with the list of the centroid of largest product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = assign(matrix(batch["v"]), centroids, "ip") if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(where, type=pa.int64())], names=["vec_id", "v", "list_id"])

    kind = dict(rows.dtypes)["v"]
    return rows.select("vec_id", "v").mapInArrow(run, f"vec_id long, v {kind}, list_id long")


def build(base: DataFrame, nlist: int, steps: int = 10) -> IVF:
    """Centroids by Lloyd steps with assignment by product, and one more assignment for the lists."""
    ship(base.sparkSession)
    rows = vector_columns(base)
    book = lloyd(rows, first_rows(rows, nlist)[None], steps, "ip")
    return IVF(book[0], with_list(rows, book[0]))


def nearest_lists(q: np.ndarray, centroids: np.ndarray, nprobe: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and distances of the nearest lists of each query, best first, ties by number."""
    dist = 1 - q @ centroids.T
    order = np.argsort(dist, axis=1, kind="stable")[:, : min(nprobe, len(centroids))]
    return order, np.take_along_axis(dist, order, 1)


def probes(index: IVF, queries: DataFrame, nprobe: int) -> DataFrame:
    """(qid, q, list_id, dist, rank): the nearest lists of each query, best first."""
    centroids = index.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order, dist = nearest_lists(matrix(batch["q"], centroids.shape[1]), centroids, nprobe)
                n, row = order.shape[1], np.repeat(np.arange(len(order)), order.shape[1])
                one = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array(order.ravel()), pa.array(dist.ravel()), pa.array(np.tile(np.arange(1, n + 1), len(order)))], names=["qid", "q", "list_id", "dist", "rank"])

    ship(queries.sparkSession)
    rows = asked(queries).withColumnRenamed("v", "q")
    return rows.mapInArrow(run, f"qid long, q {dict(rows.dtypes)['q']}, list_id long, dist double, rank long")


def probed_of(index: IVF, nprobe: int):
    """For a block of queries, which lists each of them probes."""
    centroids = index.centroids

    def run(q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(centroids)), dtype=bool)
        np.put_along_axis(out, nearest_lists(q, centroids, nprobe)[0], True, axis=1)
        return out

    return run


def search(index: IVF, queries: DataFrame, k: int = 10, nprobe: int = 4, order: str = "packed", block: int = QUERY_BLOCK, kernel_of: Callable[[np.ndarray], Kernel] | None = None) -> DataFrame:
    """(qid, vec_id, dist, rank) over the probed lists.

    The probes of a block of queries go out with it, and rows are ranked where
    they are scanned: a list of any size is read by as many tasks as it has splits. Queries that probe the same
    lists share a block (see ``ordered_blocks``), so that a block reads few lists.
    """
    return ranked(scan(index.lists, asked(queries), kernel_of or metric_kernel("ip"), k, probed_of=probed_of(index, nprobe), blocks=ordered_blocks(index, queries, nprobe, order, block)), k)


def union_search(index: IVF, queries: DataFrame, k: int = 10, nprobe: int = 4) -> DataFrame:
    """The same result by way of the union of all probed lists: a semi-join first, the probes of each query after."""
    parts = []
    for part in query_parts(queries):
        asked_lists = probes(index, part, nprobe)
        union = index.lists.join(F.broadcast(asked_lists.select("list_id").distinct()), "list_id", "left_semi")
        parts.append(search(IVF(index.centroids, union), part, k, nprobe))
    return ranked(reduce(DataFrame.unionByName, parts).drop("rank"), k)


def save(index: IVF, path: str, meta: dict) -> None:
    """Centroids, and the lists laid out by list_id, as tables."""
    save_index({"centroids": index.table(), "lists": index.lists}, path, meta, lists=len(index.centroids))


def load(spark: SparkSession, path: str, meta: dict | None = None) -> IVF | None:
    """A saved index ready to be searched; None if it is absent or was built from other data or parameters."""
    ship(spark)
    found = load_index(spark, path, meta)
    return None if found is None else of_tables(found)


def of_tables(found: dict[str, DataFrame]) -> IVF:
    rows = found["centroids"].orderBy("list_id").collect()
    if [r.list_id for r in rows] != list(range(len(rows))):
        raise ValueError("centroids are missing")
    return IVF(np.array([r.centroid for r in rows]), found["lists"].withColumn("list_id", F.col("list_id").cast("long")))


def build_or_load(base: DataFrame, path: str, nlist: int, steps: int = 10) -> IVF:
    """The index saved at ``path`` if it has these parameters and vectors, else one built and saved now."""
    meta = {"kind": "ivf", "nlist": nlist, "steps": steps, "data": fingerprint(base)}
    found = load(base.sparkSession, path, meta)
    if found is None:
        save(build(base, nlist, steps), path, meta)
        found = load(base.sparkSession, path, meta)
    return found


def _ordered(index: IVF, queries: DataFrame, nprobe: int, mode: str) -> DataFrame:
    """(qid, row): queries numbered in the order of their probes; no task sees them all."""
    near = probes(index, queries, nprobe)
    per = near.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "list_id"))), lambda x: x["list_id"]).alias("lists"))
    keys = {
        "none": [],
        "primary": [F.get("lists", F.lit(0)), F.get("lists", F.lit(1))],
        "signature": [F.slice(F.array_sort("lists"), 1, 8)],
        # the nearest list in the highest bits
        "packed": [cluster_key(F.reverse(F.slice("lists", 1, 4)))],
    }
    if mode not in keys:
        raise ValueError(f"the order must be one of {sorted(keys)}")
    return numbered(per.select("qid", *(k.alias(f"key{i}") for i, k in enumerate(keys[mode]))), *(f"key{i}" for i in range(len(keys[mode]))), "qid").select("qid", "row")


def query_order(index: IVF, queries: DataFrame, nprobe: int = 8, mode: str = "signature") -> DataFrame:
    """(qid, place): the batch order of queries by their probes: none, primary (two nearest), signature (eight least ids) or packed (four nearest in one key)."""
    return _ordered(index, queries, nprobe, mode).select("qid", (F.col("row") + 1).alias("place"))


def ordered_blocks(index: IVF, queries: DataFrame, nprobe: int, mode: str = "packed", size: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of ``size`` queries at a time in such an order; up to ``size`` queries are one block, and need none."""
    rows = asked(queries)
    n = rows.count()
    if n <= size:
        yield from query_blocks(rows, size)
        return
    placed = checkpointed(rows.join(_ordered(index, queries, nprobe, mode), "qid"))
    for a in range(0, n, size):
        part = placed.where((F.col("row") >= a) & (F.col("row") < a + size)).orderBy("row").select("qid", "v").toArrow()
        if part.num_rows:
            yield part["qid"].to_numpy(), matrix(part["v"])
