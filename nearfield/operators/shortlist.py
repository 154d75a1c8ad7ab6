"""Two-stage search: many candidates by a cheap kernel, few neighbours by exact inner products.

A task sends one row a query, its candidates as two arrays, and rows of one query are merged batch by batch; so a query
costs a row a task and not a row a candidate. Queries go out in blocks whose candidates are about ``PAIRS``
(or one query's), so what a block sends to the rows for exact distances is bounded whatever the number of queries.
Tables of a kernel, such as those of product quantisation, are made in the tasks: only queries and books are sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ship import ship
from ..sources.tables import checkpointed
from .flat import QUERY_BLOCK, Kernel, matrix, nothing, of_lists, spans

#: Candidates of a block of queries, which go out to all rows (16 bytes each).
PAIRS = 1 << 20
#: Pairs whose distances are summed at once, and candidates that are merged at once.
_CHUNK, _MERGED = 1 << 16, 1 << 18
PACKED = "qid long, vec_ids array<long>, dists array<double>"

#: Ids and matrices of some queries at a time.
Blocks = Iterator[tuple[np.ndarray, np.ndarray]]


def block_size(p: int) -> int:
    """Queries of a block that keep ``p`` candidates each."""
    return max(1, min(QUERY_BLOCK, PAIRS // max(p, 1)))


class Nearest:
    """The k least (dist, id) of each of n queries. Candidates gather, and are thinned once there are many more than are wanted."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        #: No candidate beyond it can count; those that tie with it stay until ids decide. Infinite distances and NaN never count.
        self.bound = np.full(n, np.finfo(np.float64).max)
        #: As many rows as are wanted score so much at least, where a kernel knows that (see ``quick``).
        self.score = np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows, self.kept = 0, 0

    def add(self, which: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """Distances of some queries (by number) to rows."""
        i, j = np.nonzero(dist <= self.bound[which][:, None])
        self._hold(which[i], dist[i, j], ids[j])

    def add_pairs(self, which: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        near = np.flatnonzero(dist <= self.bound[which])
        self._hold(which[near], dist[near], ids[near])

    def _hold(self, *pairs: np.ndarray) -> None:
        if len(pairs[0]):
            self.held.append(pairs)
            self.rows += len(pairs[0])
            if self.rows >= 2 * self.kept + PAIRS // 4:
                self.thin()

    def thin(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What counts so far, by query, distance and id."""
        if not self.held:
            none = np.zeros(0, dtype=np.int64)
            return none, none.astype(np.float64), none
        which, dist, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = _order(which, dist, ids, self.n)
        which = which[order]
        first = np.searchsorted(which, np.arange(self.n + 1))
        keep = np.arange(len(which)) - first[which] < self.k
        full = np.flatnonzero(np.diff(first) >= self.k) if self.k else np.zeros(0, dtype=np.int64)
        self.bound[full] = dist[order[first[full] + self.k - 1]]
        out = which[keep], dist[order[keep]], ids[order[keep]]
        self.held, self.rows = [out], len(out[0])
        self.kept = self.rows
        return out

    def packed(self, qid: np.ndarray) -> pa.RecordBatch:
        which, dist, ids = self.thin()
        return _packed(qid[which], dist, ids)


def _order(which: np.ndarray, dist: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """By query number, distance and id: a plain sort by distance, then ids where distances tie, then a stable sort of small numbers."""
    order = np.argsort(dist)
    same = np.flatnonzero(np.diff(dist[order]) == 0)
    if len(same):
        tied = np.union1d(same, same + 1)
        held = order[tied]
        order[tied] = held[np.lexsort((ids[held], dist[held]))]
    small = which[order]
    return order[np.argsort(small.astype(np.uint16) if n <= 1 << 16 else small, kind="stable")]


def _packed(qid: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """One row a query, of candidates in order."""
    new = np.ones(len(qid), dtype=bool)
    new[1:] = qid[1:] != qid[:-1]
    edge = np.flatnonzero(new)
    at = pa.array(np.append(edge, len(qid)), type=pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(qid[edge], type=pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids, type=pa.int64())), pa.ListArray.from_arrays(at, pa.array(dist, type=pa.float64()))], names=["qid", "vec_ids", "dists"])


def _flat(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, dist, id) of each candidate of packed rows."""
    ids, dist = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch["vec_ids"], batch["dists"]))
    size = ids.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(batch["qid"].to_numpy(), size), dist.flatten().to_numpy(), ids.flatten().to_numpy()


def _merged(k: int):
    """The k nearest of each query, of packed rows in order of qid; the last query of a batch waits for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, rows = None, max(1, _MERGED // max(k, 1))
        for batch in (b.slice(a, rows) for b in batches for a in range(0, b.num_rows, rows)):
            qid, dist, ids = _flat(batch)
            if wait is not None:
                qid, dist, ids = (np.concatenate(x) for x in zip(wait, (qid, dist, ids), strict=True))
            if not len(qid):
                continue
            every, which = np.unique(qid, return_inverse=True)
            best = Nearest(len(every), k)
            best.add_pairs(which, dist, ids)
            which, dist, ids = best.thin()
            done = int(np.searchsorted(which, len(every) - 1))
            if done:
                yield _packed(every[which[:done]], dist[:done], ids[:done])
            wait = every[which[done:]], dist[done:], ids[done:]
        if wait is not None and len(wait[0]):
            yield _packed(*wait)

    return run


def merged(parts: DataFrame, k: int) -> DataFrame:
    """One packed row a query, its k nearest in order."""
    return parts.repartition("qid").sortWithinPartitions("qid").mapInArrow(_merged(k), PACKED)


def listed(near: DataFrame) -> DataFrame:
    """(qid, vec_id, dist, rank) of packed rows in order."""
    each = near.select("qid", F.posexplode(F.arrays_zip("vec_ids", "dists")))
    return each.select("qid", F.col("col.vec_ids").alias("vec_id"), F.col("col.dists").alias("dist"), (F.col("pos") + 1).cast("long").alias("rank"))


def _scan(qid: np.ndarray, q: np.ndarray, kernel_of: Callable[[np.ndarray], Kernel], k: int, probed: np.ndarray | None):
    every = np.arange(len(qid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, best = None, Nearest(len(qid), k)
        for batch in batches:
            for which, part in spans(batch, every, probed):
                kernel = kernel_of(q) if kernel is None else kernel
                ids = part["vec_id"].to_numpy()
                if hasattr(kernel, "near"):
                    some, dist, row = kernel.near(which, part, best)
                    best.add_pairs(some, dist, ids[row])
                else:
                    best.add(which, kernel(which, part), ids)
        yield best.packed(qid)

    return run


def _found(rows: DataFrame, qid: np.ndarray, q: np.ndarray, kernel_of: Callable[[np.ndarray], Kernel], p: int, probed_of: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    probed = probed_of(q) if probed_of else None
    some = rows if probed is None else of_lists(rows, probed.any(0))
    return merged(some.mapInArrow(_scan(qid, q, kernel_of, p, probed), PACKED), p)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def candidates(rows: DataFrame, blocks: Blocks, kernel_of: Callable[[np.ndarray], Kernel], p: int, probed_of: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(qid, vec_id, dist, rank): the p rows of least kernel distance of each query, among those of its probed lists if it has such."""
    ship(rows.sparkSession)
    parts = [_found(rows, qid, q, kernel_of, p, probed_of) for qid, q in blocks]
    return listed(_united(parts)) if parts else nothing(rows.sparkSession).withColumn("rank", F.lit(0).cast("long"))


def _exact(qid: np.ndarray, q: np.ndarray, which: np.ndarray, wanted: np.ndarray, k: int):
    """Distances of the wanted pairs (query number, id; in order of id), summed component by component, as the Column form does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, columns = Nearest(len(qid), k), np.ascontiguousarray(q.T)
        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            low, high = np.searchsorted(wanted, ids, "left"), np.searchsorted(wanted, ids, "right")
            met = np.flatnonzero(high > low)
            if not len(met):
                continue
            x = np.ascontiguousarray(matrix(batch["v"].take(pa.array(met)), q.shape[1]).T)
            size = (high - low)[met]
            row = np.repeat(np.arange(len(met)), size)
            pair = np.repeat(low[met] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(row))
            for a in range(0, len(row), _CHUNK):
                r, w = row[a : a + _CHUNK], which[pair[a : a + _CHUNK]]
                total = np.zeros(len(r))
                for mine, theirs in zip(columns, x, strict=True):
                    total += mine[w] * theirs[r]
                best.add_pairs(w, 1 - total, ids[met[r]])
        yield best.packed(qid)

    return run


def refined(rows: DataFrame, vectors: DataFrame, blocks: Blocks, kernel_of: Callable[[np.ndarray], Kernel], k: int, p: int, probed_of: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(qid, vec_id, dist, rank): the k nearest by inner product (vectors: vec_id, v) among each query's p candidates of ``rows``.

    Candidates of a block of queries (see ``block_size``) go out to the vectors, which stay where they are. Rows
    that repeat a vec_id each count, as candidates and as vectors. No queries or no rows find nothing.
    """
    ship(rows.sparkSession)
    asked = list(blocks)
    parts = [_found(rows, qid, q, kernel_of, p, probed_of) for qid, q in asked]
    if len(parts) > 1:
        near = checkpointed(_united([part.withColumn("block", F.lit(i)) for i, part in enumerate(parts)]))
        parts = [near.where(F.col("block") == i).drop("block") for i in range(len(parts))]
    out = []
    for (qid, q), part in zip(asked, parts, strict=True):
        found, _, wanted = _flat(part.toArrow())
        if not len(found):
            continue
        # queries that repeat a qid share its candidates
        every, which = np.unique(qid, return_index=True)
        number = which[np.searchsorted(every, found)]
        order = np.lexsort((number, wanted))
        out.append(merged(vectors.mapInArrow(_exact(qid, q, number[order], wanted[order], k), PACKED), k))
    return listed(_united(out)) if out else nothing(rows.sparkSession).withColumn("rank", F.lit(0).cast("long"))
