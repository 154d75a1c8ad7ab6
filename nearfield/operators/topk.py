"""Ranking, merging and scoring of neighbour lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(rows: DataFrame, k: int | None = None, by: str = "dist", key: str = "qid") -> DataFrame:
    """The k rows of least (``by``, vec_id) of each key, with their rank from 1.

    Spark splits the rank filter into a limit before and after the exchange.
    """
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.col(by), F.col("vec_id"))).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def merged(*parts: DataFrame, k: int) -> DataFrame:
    """Top k of several neighbour lists; a vector found twice counts once."""
    rows = parts[0].select("qid", "vec_id", "dist")
    for p in parts[1:]:
        rows = rows.unionByName(p.select("qid", "vec_id", "dist"))
    return ranked(rows.groupBy("qid", "vec_id").agg(F.min("dist").alias("dist")), k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(k, n_queries, recall): the part of the first k true neighbours that were found."""
    true = truth.where(F.col("rank") <= k).select("qid", "vec_id")
    hits = true.join(found.where(F.col("rank") <= k).select("qid", "vec_id").distinct().withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left")
    each = hits.groupBy("qid").agg(F.count("hit").alias("n"))
    return each.agg(F.lit(k).cast("long").alias("k"), F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.col("n") / F.lit(k)), 6).alias("recall"))


def rounded(rows: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def vector_columns(table: DataFrame, vector: Column | str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that have both."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
