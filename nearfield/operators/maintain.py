"""Index maintenance as table operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of the same vec_id and join the rest."""
    return base.join(rows.select("vec_id"), "vec_id", "left_anti").unionByName(rows.select(*base.columns))


def insert(base: DataFrame, rows: DataFrame, capacity: int | None = None) -> DataFrame:
    """Upsert with a check of the number of rows afterwards."""
    out = upsert(base, rows)
    if capacity is not None and (n := out.count()) > capacity:
        raise ValueError(f"{n} rows exceed the capacity of {capacity}")
    return out


def append(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows without ids, numbered on from the number of rows in the table."""
    from .partition import numbered

    start = base.count()
    return base.unionByName(numbered(rows, *rows.columns[:1]).withColumn("vec_id", F.col("row") + start).select(*base.columns))


def remove(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows without those ids; absent ids change nothing."""
    return base.join(ids.select("vec_id"), "vec_id", "left_anti")


def mark_deleted(tombstones: DataFrame, base: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstones with the ids added; an id that is absent or deleted already is an error."""
    if ids.join(base.select("vec_id"), "vec_id", "left_anti").limit(1).count():
        raise ValueError("an id is not in the table")
    if ids.join(tombstones, "vec_id", "left_semi").limit(1).count():
        raise ValueError("an id is deleted already")
    return tombstones.select("vec_id").union(ids.select("vec_id"))


def unmark_deleted(tombstones: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstones without the ids; an id that is not deleted is an error."""
    if ids.join(tombstones, "vec_id", "left_anti").limit(1).count():
        raise ValueError("an id is not deleted")
    return tombstones.select("vec_id").join(ids.select("vec_id"), "vec_id", "left_anti")


def live(base: DataFrame, tombstones: DataFrame) -> DataFrame:
    return base.join(tombstones.select("vec_id"), "vec_id", "left_anti")


def replace_deleted(base: DataFrame, tombstones: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows take the places of deleted ones, least ids first: (table, tombstones that are left)."""
    n = rows.count()
    freed = tombstones.select("vec_id").distinct().orderBy("vec_id").limit(n)
    table = upsert(remove(base, freed), rows)
    left = tombstones.join(freed, "vec_id", "left_anti").join(rows.select("vec_id"), "vec_id", "left_anti")
    return table, left


def resized(count: int, capacity: int) -> int:
    if capacity < count:
        raise ValueError("the capacity is below the number of rows")
    return capacity


def vectors(base: DataFrame, ids: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the ids; a missing one is an error when the rows are read."""
    found = ids.select("vec_id").join(base.select("vec_id", "embedding"), "vec_id", "left")
    return found.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.concat(F.lit("no vector "), F.col("vec_id").cast("string")))).otherwise(F.col("embedding")))
