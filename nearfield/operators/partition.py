"""Row numbers, shards and partitioners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import squared_norm
from ..sources.tables import checkpointed


def numbered(table: DataFrame, *order: str | Column) -> DataFrame:
    """Rows with ``row`` from 0 in the given total order, without one task seeing all rows.

    A range sort deals rows out in order; each partition's offset is the count of those before it.
    """
    done = checkpointed(table.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seat", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["_part"]: r["n"] for r in done.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = {}, 0
    for p in sorted(counts):
        offsets[p], total = total, total + counts[p]
    rows = [(p, n) for p, n in offsets.items()]
    at = F.broadcast(table.sparkSession.createDataFrame(rows, "_part int, _offset long"))
    return done.join(at, "_part").withColumn("row", (F.col("_offset") + F.col("_seat")).cast("long")).withColumn("n_rows", F.lit(total).cast("long")).drop("_part", "_seat", "_offset")


def shard_of(row: Column, n: Column, shards: int) -> Column:
    """Contiguous shards; the first n % shards get one row more."""
    small = F.floor(n / shards)
    extra = n % shards
    cut = extra * (small + 1)
    return F.when(row < cut, F.floor(row / (small + 1))).otherwise(extra + F.floor((row - cut) / F.greatest(small, F.lit(1)))).cast("long")


def shards(table: DataFrame, n: int) -> DataFrame:
    """Rows with ``shard``: contiguous ranges of vec_id.

    Only ids are numbered; rows take their shard by comparing their id with the n first ones.
    """
    ids = numbered(table.select("vec_id"), "vec_id").withColumn("shard", shard_of(F.col("row"), F.col("n_rows"), n))
    first = sorted(r["first"] for r in ids.groupBy("shard").agg(F.min("vec_id").alias("first")).collect())
    place = sum((F.col("vec_id") >= F.lit(x)).cast("long") for x in first[1:]) if len(first) > 1 else F.lit(0)
    return table.withColumn("shard", F.lit(0).cast("long") + place)


def chunk_of(row: Column, n: Column, parts: int) -> Column:
    """Chunk p has the rows from floor(p * n / parts) on."""
    return F.floor(((row + 1) * parts - 1) / n).cast("long")


def partitioned(table: DataFrame, parts: int, strategy: str) -> DataFrame:
    """Rows with ``part``: contiguous, round_robin, random (by a hash, balanced) or norm (by squared norm)."""
    if strategy == "round_robin":
        return numbered(table, "vec_id").withColumn("part", F.col("row") % parts).drop("row", "n_rows")
    order = {"contiguous": ["vec_id"], "random": [F.md5(F.col("vec_id").cast("string")), "vec_id"], "norm": [F.round(squared_norm(F.col("embedding")), 12), "vec_id"]}[strategy]
    return numbered(table, *order).withColumn("part", chunk_of(F.col("row"), F.col("n_rows"), parts)).drop("row", "n_rows")


def owners(sizes: dict[int, int], ranks: int) -> dict[int, int]:
    """Longest-processing-time placement of parts on ranks, largest first; ties by id."""
    load = [0] * ranks
    out = {}
    for part in sorted(sizes, key=lambda p: (-sizes[p], p)):
        r = load.index(min(load))
        out[part] = r
        load[r] += sizes[part]
    return out
