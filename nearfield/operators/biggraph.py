"""One proximity graph of any size as tables, and its search by joins.

Rows are dealt to their two nearest regions (centroids), so that regions overlap. Each region's piece is linked
by itself, in a task of bounded size, and a row's links in its pieces are put together: rows at the borders carry
walks across. A search holds a beam for every query in a table. Each step opens the nearest few nodes of
all beams, joins them with the links and those with the vectors, and merges what is nearer into the beams, which ``ef``
bounds. Nothing depends on how many nodes there are in all, but the number of steps, and that slowly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.ship import ship
from ..sources.tables import checkpointed, load_index, save_index
from . import ivf
from .flat import asked, matrix
from .graph import by_piece
from .smallworld import CANDIDATES, Graph, Layer, nearest
from .topk import ranked, vector_columns

#: Rows of a piece, at most about; nodes that searches may enter by, a sample of bounded size that goes out to all tasks.
PIECE_ROWS, ENTRIES = 40_000, 4096


@dataclass
class Linked:
    """(node, vec_id) of all rows, (node, v) and (node, links) of distinct vectors, and the nodes to enter by."""

    rows: DataFrame
    vectors: DataFrame
    links: DataFrame
    entries: Graph


def _regions(centroids: np.ndarray, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, _ = ivf.nearest_lists(matrix(batch["v"]), centroids, overlap)
                row = np.repeat(np.arange(len(found)), found.shape[1])
                yield pa.RecordBatch.from_arrays([batch["node"].take(pa.array(row)), batch["v"].take(pa.array(row)), pa.array(found.ravel(), pa.int64())], names=["node", "v", "part"])

    return run


def _linker(m: int):
    def run(key, table):
        ids, x = table["node"].to_numpy(), matrix(table["v"])
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        layer = Layer(np.arange(len(ids)), x)
        found, dist = nearest(layer.xf, layer.xf, CANDIDATES, np.arange(len(ids)))
        layer.connect(found, dist, m, 2 * m)
        layer.repair(0)
        row, col = np.nonzero(layer.links >= 0)
        sizes = np.bincount(row, minlength=len(ids))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids[layer.links[row, col]]))
        return pa.table({"node": ids, "links": lists, "first": np.arange(len(ids)) == 0})

    return run


def build(base: DataFrame, m: int = 16, overlap: int = 2, piece_rows: int = PIECE_ROWS, steps: int = 3, entries: int = ENTRIES) -> Linked:
    """Link (vec_id, embedding) rows, whatever their number; nulls are left out.

    Equal vectors are one node, named after their least vec_id. A region of more than ``piece_rows`` rows is cut by a
    hash of the node. Each piece is linked so that all its nodes can be reached from its least one, which is
    among the entries; so all nodes can be reached from the entries.
    """
    spark = base.sparkSession
    ship(spark)
    rows = vector_columns(base).withColumn("v", F.transform("v", lambda x: x.cast("double") + 0.0))
    vectors = checkpointed(rows.groupBy("v").agg(F.min("vec_id").alias("node")).select("node", "v"))
    n = vectors.count()
    regions = max(1, -(-n * overlap // piece_rows))
    if regions > 1:
        sample = vectors.where(F.pmod(F.xxhash64("node"), F.lit(max(1, n // (256 * regions)))) == 0).withColumnRenamed("node", "vec_id").withColumnRenamed("v", "embedding")
        centroids = ivf.build(sample, min(regions, sample.count()), steps).centroids
        dealt = vectors.mapInArrow(_regions(centroids, overlap), "node long, v array<double>, part long")
    else:
        dealt = vectors.select("node", "v", F.lit(0).cast("long").alias("part"))
    linked = checkpointed(by_piece(dealt, "node", piece_rows, _linker(m), "node long, links array<long>, first boolean"))
    links = linked.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))  # one list a piece that the node is in
    # a sample of bounded size, besides one node a piece
    picked = vectors.orderBy(F.xxhash64("node"), "node").limit(entries).select("node").union(linked.where("first").select("node")).distinct()
    return Linked(rows.join(vectors, "v").select("node", "vec_id"), vectors, links, _entries(vectors.join(picked, "node", "left_semi")))


def _entries(rows: DataFrame) -> Graph:
    t = rows.toArrow()
    return Graph(matrix(t["v"]), t["node"].to_numpy())


def save(g: Linked, path: str, meta: dict) -> None:
    spark = g.rows.sparkSession
    top = spark.createDataFrame(g.entries.table().to_pylist(), "node long, vec_id long, links array<array<int>>, entry boolean, embedding array<double>")
    save_index({"rows": g.rows, "vectors": g.vectors, "adjacency": g.links, "entries": top}, path, meta)


def load(spark: SparkSession, path: str, meta: dict | None = None) -> Linked | None:
    """A saved graph ready to be searched; None if it is absent or was built otherwise."""
    found = load_index(spark, path, meta)
    if found is None:
        return None
    ship(spark)
    return Linked(found["rows"], found["vectors"], found["adjacency"], Graph.of_table(found["entries"].toArrow()))


def _entered(entries: Graph, starts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = entries.search_all(matrix(batch["v"]), starts, 4 * starts)
                counts = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["qid"].to_numpy(), counts)), pa.array([i for x in found for _, i in x], pa.int64()), pa.array([d for x in found for d, _ in x], pa.float64())], names=["qid", "node", "dist"])

    return run


def _far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            q, v = matrix(batch["q"]), matrix(batch["v"])
            yield pa.RecordBatch.from_arrays([batch["qid"], batch["node"], pa.array(1 - (v * q).sum(1))], names=["qid", "node", "dist"])


def search(g: Linked, queries: DataFrame, k: int = 10, ef: int = 64, width: int | None = None, starts: int = 4, most_steps: int = 1000) -> DataFrame:
    """(qid, vec_id, dist, rank): beams of ``ef`` nodes for all queries at once, ``width`` of which are opened a step.

    A node that has left a beam cannot come back, as the beam only comes nearer; so no table of visited nodes is kept.
    """
    spark = queries.sparkSession
    ef, width = max(ef, k), width or max(8, ef // 8)
    wanted = checkpointed(asked(queries).select("qid", F.transform("v", lambda x: x.cast("double")).alias("v")))
    # both sides of the steps' joins stay dealt out by node, so only beams are shuffled
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = g.links.select("node", "links").repartition(parts, "node").persist()
    vectors = g.vectors.select("node", "v").repartition(parts, "node").persist()
    by_dist = W.partitionBy("qid").orderBy("dist", "node")
    next_ = ~F.col("opened") & (F.row_number().over(W.partitionBy("qid", "opened").orderBy("dist", "node")) <= width)
    # a step's beams are not joined with what came from them: Spark's estimate of their size would be squared each time, and its digits double
    first = wanted.mapInArrow(_entered(g.entries, starts), "qid long, node long, dist double").withColumn("opened", F.lit(False))
    beam = checkpointed(first.withColumn("now", next_))
    try:
        for _ in range(most_steps):
            open_ = beam.where("now").select("qid", "node")
            if open_.isEmpty():
                break
            near = open_.join(links.hint("merge"), "node").select("qid", F.explode("links").alias("node")).distinct()
            new = near.join(beam.select("qid", "node"), ["qid", "node"], "left_anti")
            met = new.join(vectors.hint("merge"), "node").join(wanted.withColumnRenamed("v", "q").hint("merge"), "qid").select("qid", "node", "q", "v")
            met = met.mapInArrow(_far, "qid long, node long, dist double").withColumn("opened", F.lit(False))
            both = beam.select("qid", "node", "dist", (F.col("opened") | F.col("now")).alias("opened")).unionByName(met)
            nearest_ = both.withColumn("place", F.row_number().over(by_dist)).where(F.col("place") <= ef).drop("place")
            beam = checkpointed(nearest_.withColumn("now", next_))
        # the k nearest nodes hold the k nearest rows
        best = beam.withColumn("place", F.rank().over(W.partitionBy("qid").orderBy("dist"))).where(F.col("place") <= k)
        return checkpointed(ranked(best.join(g.rows.hint("merge"), "node").select("qid", "vec_id", "dist"), k))
    finally:
        links.unpersist()
        vectors.unpersist()
