"""Deterministic Lloyd iterations over sub-spaces, as partition sums.

A book has, for each group and sub-space, ``size`` centroids. Only books travel to
the driver: their size depends on parameters, not on rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import matrix
from .partition import numbered

#: Centroids are rounded after each step, so that sums in another order give the same assignments.
DIGITS = 9


def assign(x: np.ndarray, book: np.ndarray, how: str) -> np.ndarray:
    """Nearest centroid, the first of equals: by largest product (ip) or least squared distance (l2)."""
    score = x @ (-book.T) if how == "ip" else x @ (-2 * book.T)
    if how != "ip":
        score += (book * book).sum(1)
    best, every = np.argmin(score, axis=1), np.arange(len(score))
    if score.shape[1] > 1:
        # scores that agree in 12 digits tie: only rows whose second score is that near need rounding
        low = score[every, best]
        score[every, best] = np.inf
        tied = np.flatnonzero(score.min(axis=1) - low <= 1e-11 + 1e-14 * np.abs(low))
        score[every, best] = low
        best[tied] = np.argmin(np.round(score[tied], 12), axis=1)
    return best


def _sums(book: np.ndarray, how: str):
    subspaces, size, dsub = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((subspaces, size, dsub + 1))
        for batch in batches:
            x = matrix(batch["v"])
            for m in range(subspaces):
                part = x[:, m * dsub : (m + 1) * dsub]
                np.add.at(total[m], assign(part, book[m], how), np.hstack([part, np.ones((len(part), 1))]))
        slot = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(slot, type=pa.int64()), pa.array(total.ravel()[slot])], names=["slot", "total"])

    return run


def lloyd(rows: DataFrame, start: np.ndarray, steps: int, how: str, reseed=None) -> np.ndarray:
    """A book (sub-spaces, size, dsub) after ``steps`` updates; empty clusters keep their centroid or are reseeded."""
    book = np.round(start.astype(float), DIGITS)
    for step in range(steps):
        total = np.zeros(book.shape[:2] + (book.shape[2] + 1,))
        for slot, v in rows.select("v").mapInArrow(_sums(book, how), "slot long, total double").groupBy("slot").agg(F.sum("total")).collect():
            total.ravel()[slot] = v
        n = total[:, :, -1:]
        new = np.where(n > 0, total[:, :, :-1] / np.maximum(n, 1), book)
        if reseed is not None:
            for m, c in zip(*np.nonzero(n[:, :, 0] == 0), strict=True):
                new[m, c] = reseed(int(m), int(c), step)
        book = np.round(new, DIGITS)
    return book


def first_rows(rows: DataFrame, size: int, *order: str) -> np.ndarray:
    """Rows number c * n div size of the given order, as the start of a book; ids alone are sorted."""
    order = order or ("vec_id",)
    keys = list(dict.fromkeys([*order, "vec_id"]))
    seats = numbered(rows.select(*keys), *order)
    n = seats.select("n_rows").first()
    rows_at = [(c, c * n["n_rows"] // size) for c in range(size)] if n else []
    picks = seats.join(F.broadcast(rows.sparkSession.createDataFrame(rows_at, "c int, row long")), "row").select("c", *keys)
    found = rows.join(F.broadcast(picks), keys).orderBy("c").select("v").toArrow()
    if found.num_rows < size:
        raise ValueError(f"{size} centroids need as many rows")
    return matrix(found["v"])
