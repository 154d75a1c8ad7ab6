"""Vectors of embedding tables as integer matrices inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are handled as one matrix.
BLOCK = 4096


def integers(column: pa.Array, scale: int, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row numbers, vectors) of a list column: floor(scale * x) of each component x.

    Rows that are null or hold a null or a component that is not finite are left out. A result
    beyond ``most`` is an error: sums over it could exceed 64 bits.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    present = column.is_valid().to_numpy(zero_copy_only=False).copy()
    column = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
    flat = column.flatten()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    bad = ~np.isfinite(values)
    if bad.any():
        present[np.searchsorted(ends, np.flatnonzero(bad), "right")] = False
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(scale * values)
    keep = np.repeat(present, sizes)
    if (np.abs(whole[keep]) > most).any():
        raise ValueError(f"a component beyond {most} / {scale}: sums of products would not fit 64 bits")
    whole = np.where(keep, whole, 0).astype(np.int64)
    rows = np.flatnonzero(present)
    return rows, [whole[ends[i] - sizes[i] : ends[i]] for i in rows]


def matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array(vectors, dtype=np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def exact(x: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same matrices as doubles where all sums of products of their rows are exact in them, else as they are."""
    most = max((int(np.abs(m).max(initial=0)) for m in (x, *others)), default=0)
    width = max(m.shape[1] for m in (x, *others))
    return tuple(m.astype(np.float64) for m in (x, *others)) if 4 * width * most * most < 1 << 53 else (x, *others)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
