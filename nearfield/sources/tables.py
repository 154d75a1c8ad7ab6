"""Sources and sinks: parquet tables, binary vector files, index bundles."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ship import ship


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share.

    Where the session names none, one of our own is set in local mode, as in tests; on
    a cluster a folder of one machine would lose what other machines wrote.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="nearfield-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KINDS = {"fbin": np.float32, "ibin": np.int32, "u8bin": np.uint8}


def _parsed(kind: str, checked: bool):
    dtype = np.dtype(KINDS[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if len(content) < 8:
                    raise ValueError(f"{path}: no header")
                n, d = np.frombuffer(content, np.uint32, 2).tolist()
                if checked and len(content) != 8 + n * d * dtype.itemsize:
                    raise ValueError(f"{path}: {len(content)} bytes do not hold {n} x {d} values")
                x = np.frombuffer(content, dtype, min(n * d, (len(content) - 8) // dtype.itemsize), 8)
                for a in range(0, len(x) // max(d, 1), 8192):
                    part = x[a * d : (a + 8192) * d].astype(np.float32)
                    rows = len(part) // d
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * d + 1, d), type=pa.int32()), pa.array(part[: rows * d]))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * rows), pa.array(np.arange(a, a + rows)), lists], names=["path", "vec_id", "embedding"])

    return run


def read_bin(spark: SparkSession, path: str, kind: str = "fbin", checked: bool = True) -> DataFrame:
    """(path, vec_id, embedding) of files [u32 n][u32 d][n * d values]; ids are row numbers within a file."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parsed(kind, checked), "path string, vec_id long, embedding array<float>")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, d) of such files, from their first eight bytes."""
    head = F.substring(F.hex(F.substring("content", 1, 8)), 1, 16)
    number = lambda at: F.conv(F.concat(*(F.substring(head, at + 2 * i + 1, 2) for i in (3, 2, 1, 0))), 16, 10).cast("long")
    return spark.read.format("binaryFile").load(path).select("path", number(0).alias("n"), number(8).alias("d"))


def read_vecs(spark: SparkSession, path: str, kind: str = "f") -> DataFrame:
    """(vec_id, embedding) of fvecs, ivecs or bvecs files: each row [i32 d][d values]."""
    ship(spark)
    dtype = np.dtype({"f": np.float32, "i": np.int32, "b": np.uint8}[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"].to_pylist():
                d = int(np.frombuffer(content, np.int32, 1)[0]) if content else 0
                step = 4 + d * dtype.itemsize
                rows = np.frombuffer(content, np.uint8).reshape(-1, step)[:, 4:].copy().view(dtype).astype(np.float32) if d else np.zeros((0, 1), np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), type=pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), lists], names=["vec_id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "vec_id long, embedding array<float>")


def fingerprint(base: DataFrame) -> str:
    """Rows, length and an order-free hash of the vectors an index is built from."""
    r = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"), F.sum(F.xxhash64("vec_id", "embedding").cast("decimal(20,0)")).alias("h")).first()
    return f"{r['n']}-{r['d']}-{r['h']}"


#: Lists that have a folder each; more are range-sorted into files, which readers skip by their statistics.
LIST_FOLDERS = 256


def save_index(tables: dict[str, DataFrame], path: str, meta: dict, by: dict[str, str] | None = None, keep: list[str] | None = None, lists: int = 0) -> None:
    """Write an index as parquet tables and a one-row meta table, which comes last.

    ``by`` names the column that a table is laid out by, ``keep`` tables that are there already. With more than LIST_FOLDERS
    ``lists``, rows of that column are sorted into files instead of folders. Rows of a known number of lists go to ranges of
    (list, id) first, so that each task writes few lists and a long list is written by several tasks.
    """
    by = {"lists": "list_id", "codes": "list_id"} | (by or {})
    for name, df in tables.items():
        key = by.get(name)
        if key not in df.columns:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            continue
        if lists:
            # a number of its own: by size alone, codes would end up in too few files for the work that a search does on them
            df = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "vec_id").sortWithinPartitions(key, "vec_id")
        w = df.write.mode("overwrite")
        (w if lists > LIST_FOLDERS else w.partitionBy(key)).parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True), ",".join(sorted([*tables, *(keep or [])])))], "meta string, names string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str, meta: dict | None = None) -> dict[str, DataFrame] | None:
    """The tables of a saved index, or None if it is absent or was built from other data or parameters."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.parquet(f"{path}/meta").first()
    except AnalysisException:
        return None
    if meta is not None and json.loads(row["meta"]) != json.loads(json.dumps(meta)):
        return None
    return {n: spark.read.parquet(f"{path}/{n}") for n in [*row["names"].split(","), "meta"]}


def build_or_load(spark: SparkSession, path: str, meta: dict, build) -> dict[str, DataFrame]:
    """A saved index that matches ``meta``, or else one built now, saved, and read back."""
    found = load_index(spark, path, meta)
    if found is None:
        save_index(build(), path, meta)
        found = load_index(spark, path, meta)
    return found


def drop_index(spark: SparkSession, path: str) -> None:
    """Remove a saved index, through the store that Spark keeps it in."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def index_size(spark: SparkSession, path: str) -> DataFrame:
    """(name, files, bytes) of a saved index's tables, from the listing of its files alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract(F.element_at(F.split("path", F.lit("/" + path.rstrip("/").split("/")[-1] + "/")), -1), "^[^/]+", 0)
    return files.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def index_path(root: str, kind: str, **parameters) -> str:
    """Where an index of a kind and these parameters is kept under a root."""
    return "/".join([root, kind, *(f"{k}={parameters[k]}" for k in sorted(parameters))])


def book_table(spark: SparkSession, book: np.ndarray) -> DataFrame:
    """(m, c, centroid) of a book (sub-spaces, codes, components)."""
    rows = [(m, c, [float(x) for x in book[m, c]]) for m in range(book.shape[0]) for c in range(book.shape[1])]
    return spark.createDataFrame(rows, "m long, c long, centroid array<double>")


def read_book(table: DataFrame) -> np.ndarray:
    """The book of such a table; gaps and rows of another length are errors."""
    rows = table.orderBy("m", "c").collect()
    n, size = 1 + max(r.m for r in rows), 1 + max(r.c for r in rows)
    if [(r.m, r.c) for r in rows] != [(m, c) for m in range(n) for c in range(size)] or len({len(r.centroid) for r in rows}) != 1:
        raise ValueError("the book has gaps, or centroids of several lengths")
    return np.array([r.centroid for r in rows]).reshape(n, size, -1)
