"""Exact search: blocks of queries against all rows by matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import METRICS, truncated
from ..plans.options import SearchOptions
from ..sources.ship import ship
from ..sources.tables import checkpointed
from .topk import ranked, vector_columns

#: Queries that go out at once; more take further passes over the rows.
QUERY_BLOCK = 4096
_ROWS = 2048
#: Distances (8 bytes each) of a block of queries that are looked at at once: tasks share a machine's memory.
CELLS = 1 << 20
FOUND = "qid long, vec_id long, dist double"


def matrix(column: pa.Array, length: int | None = None) -> np.ndarray:
    """A list column as a matrix of doubles; lists of several lengths, or of another than ``length``, are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, length or 0))
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    want = int(sizes[0]) if length is None else length
    if (sizes != want).any():
        raise ValueError(f"a vector has {int(sizes[sizes != want][0])} components, not {want}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, want)


class Best:
    """The k least (dist, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.dist, self.ids = k, np.full((n, 0), np.inf), np.zeros((n, 0), dtype=np.int64)

    def add(self, dist: np.ndarray, ids: np.ndarray) -> None:
        dist, ids = np.hstack([self.dist, dist]), np.hstack([self.ids, np.broadcast_to(ids, dist.shape)])
        if dist.shape[1] > self.k:
            # all that tie with the k-th stay in the running until ids decide
            edge = np.partition(dist, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            width = int((dist <= edge).sum(1).max())
            near = np.argpartition(dist, width - 1, axis=1)[:, :width] if width < dist.shape[1] else np.broadcast_to(np.arange(width), dist.shape)
            d, i = np.take_along_axis(dist, near, 1), np.take_along_axis(ids, near, 1)
            order = np.lexsort((i, d), axis=1)[:, : self.k]
            dist, ids = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        self.dist, self.ids = dist, ids

    def add_some(self, which: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of some of the queries only."""
        part = Best(len(which), self.k)
        part.dist, part.ids = self.dist[which], self.ids[which]
        part.add(dist, ids)
        width = max(part.dist.shape[1], self.dist.shape[1])
        for name, fill in (("dist", np.inf), ("ids", 0)):
            mine, theirs = getattr(self, name), getattr(part, name)
            if width > mine.shape[1]:
                mine = np.pad(mine, ((0, 0), (0, width - mine.shape[1])), constant_values=fill)
            mine[which, : theirs.shape[1]] = theirs
            mine[which, theirs.shape[1] :] = fill
            setattr(self, name, mine)

    def rows(self, qid: np.ndarray) -> pa.RecordBatch:
        ok = np.isfinite(self.dist)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qid[:, None], ok.shape)[ok]), pa.array(self.ids[ok]), pa.array(self.dist[ok])], names=["qid", "vec_id", "dist"])


#: A kernel has the distances of a block of queries (by number) to rows of an Arrow batch.
Kernel = Callable[[np.ndarray, pa.RecordBatch], np.ndarray]


def spans(batch: pa.RecordBatch, every: np.ndarray, probed: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Queries (by number) with the rows that they meet, about ``CELLS`` pairs at a time; with ``probed`` (queries x lists) those of their lists only."""
    if probed is None:
        step = max(64, min(_ROWS, CELLS // max(1, len(every))))
        for a in range(0, batch.num_rows, step):
            yield every, batch.slice(a, step)
        return
    lists = batch["list_id"].to_numpy()
    for x in np.unique(lists).tolist():
        which = np.flatnonzero(probed[:, x])
        if len(which):
            rows, step = np.flatnonzero(lists == x), max(64, min(_ROWS, CELLS // len(which)))
            for a in range(0, len(rows), step):
                yield which, batch.take(pa.array(rows[a : a + step]))


def _scan(qid: np.ndarray, kernel: Kernel, k: int, eps: float | None = None, probed: np.ndarray | None = None):
    """The k nearest rows of each query within a partition, or all within ``eps``.

    With ``probed`` (queries x lists) a query meets the rows of its lists only.
    """
    every = np.arange(len(qid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shortlist import Nearest

        best = Nearest(len(qid), k)
        for batch in batches:
            for which, part in spans(batch, every, probed):
                ids = part["vec_id"].to_numpy()
                if hasattr(kernel, "near"):
                    some, dist, row = kernel.near(which, part, best)
                    best.add_pairs(some, dist, ids[row])
                    continue
                dist = kernel(which, part)
                if eps is None:
                    best.add(which, dist, ids)
                else:
                    i, j = np.nonzero(dist <= eps)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[which[i]]), pa.array(ids[j]), pa.array(dist[i, j])], names=["qid", "vec_id", "dist"])
        if eps is None:
            # a row beyond the k-th of its query in this partition never leaves the task
            which, dist, ids = best.thin()
            yield pa.RecordBatch.from_arrays([pa.array(qid[which], pa.int64()), pa.array(ids, pa.int64()), pa.array(dist, pa.float64())], names=["qid", "vec_id", "dist"])

    return run


def scan(
    rows: DataFrame, queries: DataFrame, kernel_of: Callable[[np.ndarray], Kernel], k: int, eps: float | None = None, probed_of: Callable[[np.ndarray], np.ndarray] | None = None,
    blocks: Iterator[tuple[np.ndarray, np.ndarray]] | None = None,
) -> DataFrame:
    """(qid, vec_id, dist): per-partition candidates that hold every query's k nearest, or all within ``eps``.

    queries: (qid, v). They go out in ``blocks`` (of a hash of qid, if none are given); ``kernel_of`` makes the kernel of a
    block's matrix, ``probed_of`` its table of probed lists (rows then have a list_id). Kernels of ``quick`` find pairs, without ``eps``.
    """
    ship(rows.sparkSession)
    out = None
    for qid, q in query_blocks(queries) if blocks is None else blocks:
        probed = probed_of(q) if probed_of else None
        some = rows if probed is None else of_lists(rows, probed.any(0))
        found = some.mapInArrow(_scan(qid, kernel_of(q), k, eps, probed), FOUND)
        out = found if out is None else out.unionByName(found)
    return nothing(rows.sparkSession) if out is None else out


def of_lists(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """The rows of the wanted lists (a flag each); all rows where every list is wanted."""
    if wanted.all():
        return rows
    # one expression: a call for each of many lists would take longer than the scan
    return rows.where(f"list_id in ({', '.join(map(str, np.flatnonzero(wanted).tolist()))})" if wanted.any() else "false")


def nothing(spark: SparkSession) -> DataFrame:
    """What no queries find."""
    return spark.createDataFrame([], FOUND)


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the queries, at most ``size`` at a time; all must have one length."""
    n = queries.count()
    passes = max(1, -(-n // size)) if n else 0
    for i in range(passes):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i).orderBy("qid").toArrow()
        if part.num_rows:
            yield part["qid"].to_numpy(), matrix(part["v"])


def query_parts(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[DataFrame]:
    """The queries in parts of about ``size`` rows (one part if there are fewer), each fit to be broadcast."""
    passes = max(1, -(-queries.count() // size))
    for i in range(passes):
        yield queries if passes == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i)


def metric_kernel(metric: str) -> Callable[[np.ndarray], Kernel]:
    """Kernels of a registered metric over a column v."""
    kernel = METRICS[metric][1]
    return lambda q: lambda which, part: kernel(q[which], matrix(part["v"], q.shape[1]))


def distances(base: DataFrame, queries: DataFrame, k: int, metric: str = "ip", eps: float | None = None) -> DataFrame:
    """(qid, vec_id, dist): per-partition candidates that hold every query's k nearest, or all within ``eps``.

    base: (vec_id, v); queries: (qid, v). Rows and queries must have one length.
    """
    return scan(base, queries, metric_kernel(metric), k, eps)


def asked(queries: DataFrame) -> DataFrame:
    """Queries (qid, embedding) as (qid, v); nulls are left out."""
    return queries.select(F.col("qid").cast("long").alias("qid"), F.col("embedding").alias("v")).where("qid is not null and v is not null")


def chosen(rows: DataFrame, predicate: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """The rows for which a callable, asked with whole Arrow batches of all their columns, says yes."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                said = np.asarray(predicate(pa.Table.from_batches([batch])), dtype=bool)
                if said.shape != (batch.num_rows,):
                    raise ValueError(f"a predicate has {said.shape} answers for {batch.num_rows} rows")
                yield batch.filter(pa.array(said))

    return rows.mapInArrow(run, rows.schema)


def search(base: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions(), where: Column | None = None, predicate: Callable[[pa.Table], np.ndarray] | None = None) -> DataFrame:
    """(qid, vec_id, dist, rank): exact k nearest.

    ``where``, and a callable ``predicate`` (see ``chosen``), filter rows before they are ranked. With ``dims`` the first stage looks at
    that many components and ``rerank`` candidates are ranked anew on all.
    """
    if where is not None:
        base = base.where(where)
    if predicate is not None:
        base = chosen(base, predicate)
    rows = vector_columns(base)
    wanted = asked(queries)
    if options.dims is None:
        return ranked(distances(rows, wanted, options.k, options.metric), options.k)
    p = max(options.k, options.rerank)
    cut = truncated(F.col("v"), options.dims)
    short = ranked(distances(rows.withColumn("v", cut), wanted.withColumn("v", cut), p, options.metric), p)
    return short if options.rerank <= options.k else rerank(short, rows, wanted, options.k, options.metric)


#: Candidates (16 bytes each) that go out to the rows; more meet them by a merge join.
BROADCAST_CANDIDATES = 1_000_000


def rerank(candidates: DataFrame, rows: DataFrame, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """Exact distances of candidates (qid, vec_id), and the k nearest by them.

    Candidates are found once, and counted: few go out to the rows, which then stay where they are.
    """
    column = METRICS[metric][0]
    near = checkpointed(candidates.select("qid", "vec_id"))
    near = F.broadcast(near) if near.count() <= BROADCAST_CANDIDATES else near.hint("merge")
    exact = rows.join(near, "vec_id").join(queries.withColumnRenamed("v", "_q"), "qid")
    return ranked(exact.select("qid", "vec_id", column(F.col("_q"), F.col("v")).alias("dist")), k)


def range_search(base: DataFrame, queries: DataFrame, eps: float, metric: str = "l2", most: int | None = None) -> DataFrame:
    """All rows within ``eps`` of each query (the ``most`` nearest, if given), nearest first."""
    rows = vector_columns(base)
    return ranked(distances(rows, asked(queries), 0, metric, eps), most)


def _first_documents(qid: np.ndarray, kernel: Kernel, n: int):
    """(qid, vec_id, dist, doc): the nearest row of each of the n nearest documents of a partition."""
    every = np.arange(len(qid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dist, ids, docs = np.zeros((len(qid), 0)), np.zeros((len(qid), 0), dtype=np.int64), np.zeros((len(qid), 0), dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                shape = (len(qid), part.num_rows)
                d = np.hstack([dist, kernel(every, part)])
                i = np.hstack([ids, np.broadcast_to(part["vec_id"].to_numpy(), shape)])
                c = np.hstack([docs, np.broadcast_to(part["doc"].to_numpy(), shape)])
                order = np.lexsort((i, d, c), axis=1)
                d, i, c = (np.take_along_axis(x, order, 1) for x in (d, i, c))
                # the nearest row of each document leads its run; all others drop behind
                d[:, 1:][c[:, 1:] == c[:, :-1]] = np.inf
                order = np.lexsort((i, d), axis=1)[:, :n]
                dist, ids, docs = (np.take_along_axis(x, order, 1) for x in (d, i, c))
        ok = np.isfinite(dist)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qid[:, None], ok.shape)[ok]), pa.array(ids[ok]), pa.array(dist[ok]), pa.array(docs[ok])], names=["qid", "vec_id", "dist", "doc"])

    return run


def document_search(base: DataFrame, queries: DataFrame, n: int, metric: str = "ip") -> DataFrame:
    """(qid, vec_id, doc, dist): all rows nearer than the nearest row of document n + 1.

    base: (vec_id, doc, v). A first pass finds the n + 1 nearest documents, a second
    one the rows within the bound that the last of them sets.
    """
    ship(base.sparkSession)
    kernel_of = metric_kernel(metric)
    out = None
    for qid, q in query_blocks(queries):
        first = base.mapInArrow(_first_documents(qid, kernel_of(q), n + 1), FOUND + ", doc long")
        first = first.groupBy("qid", "doc").agg(F.min(F.struct("dist", "vec_id")).alias("first"))
        place = F.row_number().over(W.partitionBy("qid").orderBy("first.dist", "first.vec_id"))
        bounds = {r.qid: (r["first"]["dist"], r["first"]["vec_id"]) for r in first.withColumn("place", place).where(F.col("place") == n + 1).collect()}
        far, last = (np.array([bounds.get(i, (np.inf, 0))[j] for i in qid.tolist()]) for j in (0, 1))

        def run(batches: Iterator[pa.RecordBatch], qid=qid, kernel=kernel_of(q), far=far[:, None], last=last[:, None]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(a, _ROWS)
                    dist, ids, doc = kernel(np.arange(len(qid)), part), part["vec_id"].to_numpy(), part["doc"].to_numpy()
                    i, j = np.nonzero((dist < far) | ((dist == far) & (ids[None] < last)))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(ids[j]), pa.array(dist[i, j]), pa.array(doc[j])], names=["qid", "vec_id", "dist", "doc"])

        found = base.mapInArrow(run, FOUND + ", doc long")
        out = found if out is None else out.unionByName(found)
    return (base.sparkSession.createDataFrame([], FOUND + ", doc long") if out is None else out).select("qid", "vec_id", "doc", "dist")


def search_local(base: DataFrame, queries: DataFrame, k: int, blocks: int, local_p: int, metric: str = "ip") -> DataFrame:
    """Search by contiguous blocks of ids that keep ``local_p`` each before the merge; below k this may lose neighbours."""
    from .partition import shards

    rows = shards(base, blocks)
    found = None
    for qid, q in query_blocks(asked(queries)):
        kernel = METRICS[metric][1]

        def run(batches: Iterator[pa.RecordBatch], qid=qid, q=q, kernel=kernel) -> Iterator[pa.RecordBatch]:
            held: dict[int, Best] = {}
            for batch in batches:
                part, ids, x = batch["shard"].to_numpy(), batch["vec_id"].to_numpy(), matrix(batch["embedding"], q.shape[1])
                for s in np.unique(part).tolist():
                    held.setdefault(s, Best(len(q), local_p)).add(kernel(q, x[part == s]), ids[part == s])
            for s, best in held.items():
                b = best.rows(qid)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, s))], names=["qid", "vec_id", "dist", "shard"])

        part = rows.select("shard", "vec_id", "embedding").mapInArrow(run, FOUND + ", shard long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return ranked(nothing(base.sparkSession), k)
    local = ranked(found.withColumn("key", F.struct("qid", "shard")), local_p, key="key").drop("key", "rank", "shard")
    return ranked(local, k)
