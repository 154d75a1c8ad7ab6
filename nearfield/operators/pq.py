"""Product quantisation: codes, lookup tables, and the four searches that use them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ship import ship
from ..sources.tables import book_table, load_index, read_book, save_index
from .flat import Kernel, asked, matrix, query_blocks
from .ivf import IVF, of_tables, ordered_blocks, probed_of
from .kmeans import DIGITS, assign, first_rows, lloyd
from .partition import numbered
from .shortlist import block_size, candidates, refined
from .topk import vector_columns


def start_book(first: np.ndarray, subspaces: int) -> np.ndarray:
    if first.shape[1] % subspaces:
        raise ValueError("the number of sub-spaces must divide the dimension")
    return first.reshape(len(first), subspaces, -1).transpose(1, 0, 2)


def train(rows: DataFrame, subspaces: int, size: int, steps: int = 10, order: tuple[str, ...] = ("vec_id",)) -> np.ndarray:
    """One book (sub-spaces, size, dsub) by Lloyd steps in squared distance; an empty cluster keeps its centroid."""
    if size > 256:
        raise ValueError("at most 256 codes")
    ship(rows.sparkSession)
    return lloyd(rows, start_book(first_rows(rows, size, *order), subspaces), steps, "l2")


def encode(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    dsub = book.shape[2]
    return np.stack([assign(x[:, m * dsub : (m + 1) * dsub], book[m], "l2") for m in range(len(book))], axis=1) if len(x) else np.zeros((0, len(book)), dtype=np.int64)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d), type=pa.int32()), pa.array(values.ravel(), type=kind))


def coded(rows: DataFrame, book: np.ndarray, *keep: str) -> DataFrame:
    """Rows (vec_id, ...keep, code) of rows with a vector v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["vec_id"], *(batch[k] for k in keep), _lists(encode(matrix(batch["v"]), book), pa.int16())], names=["vec_id", *keep, "code"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", *keep, "v").mapInArrow(run, ", ".join(["vec_id long", *(f"{k} {kinds[k]}" for k in keep), "code array<smallint>"]))


def lookup(q: np.ndarray, book: np.ndarray, how: str = "l2") -> np.ndarray:
    """(queries, sub-spaces, codes): distances (l2) or products (ip) of queries with all codewords."""
    out = np.zeros((len(q), len(book), book.shape[1]))
    for m, words in enumerate(book):
        for j in range(book.shape[2]):
            mine, theirs = q[:, m * book.shape[2] + j, None], words[None, :, j]
            out[:, m] += (mine - theirs) ** 2 if how == "l2" else mine * theirs
    return out


def looked_up(lut: np.ndarray, codes: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """Asymmetric distances: the sum of each code's entry in its sub-space's table, rounded so that equal codes tie; for some of the queries, or all."""
    out = np.zeros((len(lut) if which is None else len(which), len(codes)))
    for m in range(lut.shape[1]):
        table = lut[:, m] if which is None else lut[which, m]
        out += np.take(table, codes[:, m], axis=1)
    return np.round(out, 12, out=out)


def codes_of(part: pa.RecordBatch, book: np.ndarray) -> np.ndarray:
    """Stored codes of a batch, or those of its vectors."""
    if "code" in part.schema.names:
        return matrix(part["code"], len(book)).astype(np.int64)
    return encode(matrix(part["v"], len(book) * book.shape[2]), book)


def _adc_kernel(book: np.ndarray):
    def kernel_of(q: np.ndarray) -> Kernel:
        lut = lookup(q, book)
        return lambda which, part: looked_up(lut, codes_of(part, book), which)

    return kernel_of


def adc(codes: DataFrame, queries: DataFrame, book: np.ndarray, top_p: int) -> DataFrame:
    """The ``top_p`` rows of least table distance, from codes (vec_id, code) or vectors (vec_id, v)."""
    return candidates(codes, query_blocks(asked(queries), block_size(top_p)), _adc_kernel(book), top_p)


def search(base: DataFrame, queries: DataFrame, book: np.ndarray, k: int = 10, top_p: int = 50) -> DataFrame:
    """Candidates by table distance, then exact distances."""
    rows, p = vector_columns(base), max(k, top_p)
    return refined(rows, rows, query_blocks(asked(queries), block_size(p)), _adc_kernel(book), k, p)


def ivf_search(index: IVF, queries: DataFrame, book: np.ndarray, k: int = 10, top_p: int = 50, nprobe: int = 4, codes: DataFrame | None = None, kernel_of: Callable[[np.ndarray], Kernel] | None = None) -> DataFrame:
    """Raw vectors coded by one book; candidates come from the probed lists. ``codes`` (vec_id, list_id, code) may be stored ones."""
    p = max(k, top_p)
    blocks = ordered_blocks(index, queries, nprobe, size=block_size(p))
    return refined(index.lists if codes is None else codes, index.lists.select("vec_id", "v"), blocks, kernel_of or _adc_kernel(book), k, p, probed_of(index, nprobe))


def _local_sums(books: dict[int, np.ndarray]):
    """Sums by (list, sub-space, code) of a partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            where = batch["list_id"].to_numpy()
            x = matrix(batch["v"])
            for one in np.unique(where).tolist():
                book, rows = books[one], x[where == one]
                held = total.setdefault(one, np.zeros((*book.shape[:2], book.shape[2] + 1)))
                for m in range(len(book)):
                    part = rows[:, m * book.shape[2] : (m + 1) * book.shape[2]]
                    np.add.at(held[m], assign(part, book[m], "l2"), np.hstack([part, np.ones((len(part), 1))]))
        for one, held in total.items():
            slot = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), one)), pa.array(slot), pa.array(held.ravel()[slot])], names=["list_id", "slot", "total"])

    return run


def local_books(index: IVF, subspaces: int, size: int, steps: int = 10) -> DataFrame:
    """(list_id, m, c, centroid): one book for each list, trained on its own rows in the order of vec_id.

    Lists meet as partial sums, never as a whole: rows are summed where they are, by list, sub-space and code, and seats
    in the order of ids come from a range sort of ids alone. Books, whose size depends on parameters, go out to the tasks.
    A list of fewer rows than ``size`` repeats its rows as centroids.
    """
    spark = index.lists.sparkSession
    sizes = {r.list_id: r.size for r in index.lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("size")).collect()}
    before = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[x] for x in sorted(sizes))]).tolist(), strict=False))
    seats = numbered(index.lists.select("list_id", "vec_id"), "list_id", "vec_id")
    picked = spark.createDataFrame([(x, c, before[x] + c * sizes[x] // size) for x in sorted(sizes) for c in range(size)], "list_id long, c long, row long")
    starts = picked.join(seats.select("row", "vec_id"), "row").join(index.lists.select("vec_id", "v"), "vec_id").select("list_id", "c", "v")
    books: dict[int, np.ndarray] = {}
    found = starts.orderBy("list_id", "c").toArrow()
    where, x = found["list_id"].to_numpy(), matrix(found["v"])
    for one in sizes:
        books[one] = np.round(start_book(x[where == one], subspaces), DIGITS)
    for _ in range(steps):
        sums = index.lists.select("list_id", "v").mapInArrow(_local_sums(books), "list_id long, slot long, total double").groupBy("list_id", "slot").agg(F.sum("total").alias("total")).collect()
        total = {one: np.zeros((*b.shape[:2], b.shape[2] + 1)) for one, b in books.items()}
        for r in sums:
            total[r.list_id].ravel()[r.slot] = r.total
        for one, t in total.items():
            n = t[:, :, -1:]
            books[one] = np.round(np.where(n > 0, t[:, :, :-1] / np.maximum(n, 1), books[one]), DIGITS)
    rows = [(one, m, c, [float(y) for y in b[m, c]]) for one, b in sorted(books.items()) for m in range(b.shape[0]) for c in range(b.shape[1])]
    return spark.createDataFrame(rows, "list_id long, m long, c long, centroid array<double>")


def save_local(index: IVF, books: DataFrame, path: str, meta: dict) -> None:
    """Lists, and their books laid out by list."""
    save_index({"centroids": index.table(), "lists": index.lists, "books": books}, path, meta, by={"books": "list_id"})


def load_local(spark: SparkSession, path: str, meta: dict | None = None) -> tuple[IVF, DataFrame] | None:
    """(index, books) for ``local_search``, or None; a list without a book is an error."""
    found = load_index(spark, path, meta)
    if found is None:
        return None
    ship(spark)
    index, books = of_tables(found), found["books"].withColumn("list_id", F.col("list_id").cast("long"))
    if not index.lists.select("list_id").distinct().join(books, "list_id", "left_anti").isEmpty():
        raise ValueError(f"{path}: a list has no book")
    return index, books


def local_search(index: IVF, books: DataFrame, queries: DataFrame, k: int = 10, top_p: int = 50, nprobe: int = 4) -> DataFrame:
    """Codes and tables by the books of the lists: a table for each list that a query probes."""
    found: dict[int, dict[tuple[int, int], list[float]]] = {}
    for r in books.collect():
        found.setdefault(r.list_id, {})[r.m, r.c] = r.centroid
    held = {}
    for x, cells in found.items():
        n, size = 1 + max(m for m, _ in cells), 1 + max(c for _, c in cells)
        held[x] = np.array([[cells[m, c] for c in range(size)] for m in range(n)])

    def kernel_of(q: np.ndarray) -> Kernel:
        last: list = [None, None, None]  # rows of one list come in a row: its tables are made once

        def kernel(which: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
            one = part["list_id"][0].as_py()
            if last[0] != one or not np.array_equal(last[1], which):
                last[:] = one, which, lookup(q[which], held[one])
            return looked_up(last[2], codes_of(part, held[one]))

        return kernel

    p = max(k, top_p)
    blocks = ordered_blocks(index, queries, nprobe, size=block_size(p))
    return refined(index.lists, index.lists.select("vec_id", "v"), blocks, kernel_of, k, p, probed_of(index, nprobe))


@dataclass
class Residual:
    """Inverted lists whose residuals are coded by one book, trained in list order."""

    index: IVF
    book: np.ndarray
    codes: DataFrame


def build_residual(index: IVF, subspaces: int, size: int, steps: int = 10) -> Residual:
    c = F.broadcast(index.table())
    left = index.lists.join(c, "list_id").select("list_id", "vec_id", F.zip_with("v", "centroid", lambda a, b: a.cast("double") - b).alias("v"))
    book = train(left, subspaces, size, steps, order=("list_id", "vec_id"))
    return Residual(index, book, coded(left, book, "list_id"))


def residual_search(r: Residual, queries: DataFrame, k: int = 10, rerank_p: int = 50, nprobe: int = 4) -> DataFrame:
    """Score 1 - (q . centroid + sum of q_m . codeword); the best go through exact distances."""
    centroids, book = r.index.centroids, r.book

    def kernel_of(q: np.ndarray) -> Kernel:
        lut, top = lookup(q, book, "ip"), q @ centroids.T

        def kernel(which: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
            return 1 - (top[which, part["list_id"][0].as_py()][:, None] + looked_up(lut, codes_of(part, book), which))

        return kernel

    p = max(k, rerank_p)
    probed, blocks = probed_of(r.index, nprobe), ordered_blocks(r.index, queries, nprobe, size=block_size(p))
    if rerank_p <= k:
        return candidates(r.codes, blocks, kernel_of, p, probed)
    return refined(r.codes, r.index.lists.select("vec_id", "v"), blocks, kernel_of, k, p, probed)


def save_residual(r: Residual, path: str, meta: dict) -> None:
    spark = r.codes.sparkSession
    save_index({"centroids": r.index.table(), "lists": r.index.lists, "book": book_table(spark, r.book), "codes": r.codes}, path, meta, lists=len(r.index.centroids))


def load_residual(spark: SparkSession, path: str, meta: dict | None = None) -> Residual | None:
    """A saved residual index ready to be searched, or None."""
    found = load_index(spark, path, meta)
    if found is None:
        return None
    ship(spark)
    return Residual(of_tables(found), read_book(found["book"]), found["codes"].withColumn("list_id", F.col("list_id").cast("long")))


def save_coded(index: IVF, book: np.ndarray, path: str, meta: dict) -> None:
    """Lists, a book of the raw vectors, and their codes by list."""
    spark = index.lists.sparkSession
    save_index({"centroids": index.table(), "lists": index.lists, "book": book_table(spark, book), "codes": coded(index.lists, book, "list_id")}, path, meta, lists=len(index.centroids))


def load_coded(spark: SparkSession, path: str, meta: dict | None = None) -> tuple[IVF, np.ndarray, DataFrame] | None:
    """(index, book, codes) for ``ivf_search``, or None."""
    found = load_index(spark, path, meta)
    if found is None:
        return None
    ship(spark)
    return of_tables(found), read_book(found["book"]), found["codes"].withColumn("list_id", F.col("list_id").cast("long"))
