"""Exact searches that look at most pairs in single precision only.

Products in single precision, whose error is bounded, tell which pairs may count; those are measured in double precision.
``search_near`` looks at groups of rows first: a group whose centre and radius keep it beyond a query's bound is passed by.
All of them find what a full scan in double precision finds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import ip_distance
from ..sources.ship import ship
from ..sources.tables import checkpointed
from .flat import CELLS, FOUND, asked, matrix, nothing
from .shortlist import Nearest
from .topk import ranked, vector_columns

#: Pairs that are measured in double precision at once.
_PAIRS = 1 << 14
#: Queries that ``search_near`` sends out at once.
NEAR_BLOCK = 16_384
#: A bound that none is beyond.
_NONE = np.finfo(np.float64).max
#: How far distances that are summed in another order may be apart.
_SLACK = 1e-9


def _error(a: np.ndarray, b: np.ndarray) -> float:
    """How far single-precision products of rows of a with rows of b (doubles) may be off, their conversion included."""
    far = np.sqrt(np.einsum("ij,ij->i", a, a).max(initial=0) * np.einsum("ij,ij->i", b, b).max(initial=0))
    return float((a.shape[1] + 4) * 2.0**-23 * far)


def _cells(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few flags that are set."""
    at = np.flatnonzero(flags.ravel())
    return np.divmod(at, max(1, flags.shape[1]))


class Filtered:
    """A kernel of ``_scan`` that finds pairs: scores (the larger the nearer) are products of rows made of queries and of batches."""

    def __init__(self, asks: np.ndarray, limit: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: Callable[[pa.RecordBatch], tuple], exact: Callable, k: int):
        self.asks, self.single, self.limit, self.rows, self.exact, self.k = asks, asks.astype(np.float32), limit, rows, exact, k

    def near(self, which: np.ndarray, part: pa.RecordBatch, best: Nearest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, distance, row) of all pairs that can be among the nearest, and perhaps of some that cannot."""
        scored, held = self.rows(part)
        with np.errstate(over="ignore", invalid="ignore"):
            s = self.single[which] @ scored.astype(np.float32).T
            slack = _error(self.asks[which], scored)
            # by the bound that distances set, and by the k rows that scored so much before there was one
            least = np.maximum(self.limit(which, best.bound[which]), best.score[which])
            free = np.flatnonzero(np.isneginf(least))
            if len(free) and 0 < self.k <= s.shape[1]:
                kth = np.partition(s[free], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - slack
                least[free] = np.where(np.isfinite(kth), kth, -np.inf)
                best.score[which[free]] = least[free]
            # what overflows or is no number is measured
            least = np.nextafter((least - slack).astype(np.float32), np.float32(-np.inf))
            i, j = _cells(~(s < least[:, None]))
        w, out = which[i], np.empty(len(i))
        for a in range(0, len(i), _PAIRS):
            out[a : a + _PAIRS] = self.exact(w[a : a + _PAIRS], held, j[a : a + _PAIRS])
        return w, out, j


def products(k: int) -> Callable[[np.ndarray], Filtered]:
    """Kernels of the distance 1 - product over a column v."""

    def kernel_of(q: np.ndarray) -> Filtered:
        def rows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            x = matrix(part["v"], q.shape[1])
            return x, x

        return Filtered(q, lambda which, bound: np.where(bound < _NONE, 1 - bound, -np.inf), rows, lambda w, x, j: 1 - np.einsum("ij,ij->i", q[w], x[j]), k)

    return kernel_of


def coded(book: np.ndarray, p: int) -> Callable[[np.ndarray], Filtered]:
    """Kernels of table distances: squared distances to the rows that codes stand for, with the sums of ``pq.looked_up``."""

    def kernel_of(q: np.ndarray) -> Filtered:
        from .pq import codes_of

        norm, dsub = (q * q).sum(1), book.shape[2]

        def rows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            codes = codes_of(part, book)
            x = np.hstack([book[m][codes[:, m]] for m in range(len(book))])
            return np.hstack([x, (x * x).sum(1)[:, None] / -2]), x

        def exact(w: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
            d = q[w] - x[j]
            d *= d
            cell = d[:, ::dsub].copy()
            for at in range(1, dsub):
                cell += d[:, at::dsub]
            total = np.zeros(len(w))
            for m in range(len(book)):
                total += cell[:, m]
            return np.round(total, 12)

        return Filtered(np.hstack([q, np.ones((len(q), 1))]), lambda which, bound: np.where(bound < _NONE, (norm[which] - bound - _SLACK) / 2, -np.inf), rows, exact, p)

    return kernel_of


def _groups(ids: np.ndarray, x: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first row, rows, centre, radius) of runs of rows that share their id div ``near``."""
    start = np.concatenate([[0], np.flatnonzero(np.diff(ids // near)) + 1])
    size = np.diff(np.append(start, len(ids)))
    centre = np.add.reduceat(x, start, axis=0) / size[:, None]
    off = x - np.repeat(centre, size, axis=0)
    return start, size, centre, np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", off, off), start))


def _scan_groups(qid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, near: int):
    """The k nearest rows of each query within a partition, of those within its bound."""
    norm = np.sqrt((q * q).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(len(qid), k)
        best.bound = bound.copy()
        # a row of a group scores at most query * centre + |query| * radius
        asks = np.hstack([q, norm[:, None]])
        single = asks.astype(np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = matrix(batch["v"], q.shape[1]), batch["vec_id"].to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                start, size, centre, radius = _groups(ids, x, near)
            groups = np.hstack([centre, radius[:, None] * (1 + _SLACK)])
            step = max(16, CELLS // max(1, len(qid)))
            for a in range(0, len(start), step):
                with np.errstate(over="ignore", invalid="ignore"):
                    some = groups[a : a + step]
                    slack = _error(asks, some) + _SLACK
                    least = np.where(best.bound < _NONE, 1 - best.bound, -np.inf) - slack
                    least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
                    # what overflows or is no number is measured
                    i, g = _cells(~(single @ some.astype(np.float32).T < least[:, None]))
                many = max(1, _PAIRS // int(size[a : a + step].max()))
                for b in range(0, len(i), many):
                    here = a + g[b : b + many]
                    n = size[here]
                    row = np.repeat(start[here] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    w = np.repeat(i[b : b + many], n)
                    best.add_pairs(w, 1 - np.einsum("ij,ij->i", q[w], x[row]), ids[row])
        which, dist, ids = best.thin()
        yield pa.RecordBatch.from_arrays([pa.array(qid[which], pa.int64()), pa.array(ids, pa.int64()), pa.array(dist, pa.float64())], names=["qid", "vec_id", "dist"])

    return run


def search_near(base: DataFrame, queries: DataFrame, k: int, near: int) -> DataFrame:
    """(qid, vec_id, dist, rank): exact k nearest by product, where rows of the same id div ``near`` are thought to lie near each other, and follow each other.

    The k-th nearest of the rows that share the query's number bounds it; groups beyond are passed by. Where rows are not near each
    other, or a query has too few such rows, more is looked at, and the same rows are found.
    """
    ship(base.sparkSession)
    rows, wanted = vector_columns(base), asked(queries)
    group = lambda c: F.floor(F.col(c) / near).alias("g")
    mine = wanted.select("qid", group("qid"), F.col("v").alias("q"))
    held = rows.select("v", "vec_id", group("vec_id")).join(mine.select("g").distinct(), "g", "left_semi").join(mine, "g")
    kth = ranked(held.select("qid", "vec_id", ip_distance(F.col("q"), F.col("v")).alias("dist")), k).where(F.col("rank") == k)
    # of queries that repeat a qid, the farther bound holds for both
    kth = kth.groupBy("qid").agg(F.max("dist").alias("bound"))
    once = wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    bounds = once.join(kth, "qid", "left").select("qid", F.when(F.col("n") == 1, F.col("bound")).alias("bound"))
    asks = checkpointed(wanted.join(bounds, "qid"))
    passes, out = max(1, -(-asks.count() // NEAR_BLOCK)), None
    for i in range(passes):
        part = asks.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i).orderBy("qid").toArrow()
        if part.num_rows:
            far = part["bound"].to_numpy()
            bound = np.where(np.isfinite(far), far + _SLACK, _NONE)
            found = rows.mapInArrow(_scan_groups(part["qid"].to_numpy(), matrix(part["v"]), bound, k, near), FOUND)
            out = found if out is None else out.unionByName(found)
    return ranked(nothing(base.sparkSession) if out is None else out, k)
