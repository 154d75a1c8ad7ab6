"""Observability: how work is spread, and how long steps take."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def partition_balance(rows: DataFrame) -> DataFrame:
    """(partition, rows, imbalance): rows of each partition, and the greatest over the mean."""
    per = rows.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))
    every = W.partitionBy()
    return per.withColumn("imbalance", F.max("rows").over(every) / F.avg("rows").over(every))


def scanned_rows(probes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(qid, scanned): rows in the lists that each query probes."""
    return probes.join(sizes, "list_id").groupBy("qid").agg(F.sum("size").alias("scanned"))


class Timings:
    """Wall seconds of named steps; ``rows`` gives them as a table."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def rows(self) -> list[tuple[str, float]]:
        return list(self.seconds.items())


def quality(found: DataFrame, truth: DataFrame, k: int, name: str, seconds: float) -> DataFrame:
    """(name, k, n_queries, recall, seconds, queries_per_second) of one search."""
    from ..operators.topk import recall

    rows = recall(found, truth, k)
    return rows.select(F.lit(name).alias("name"), "k", "n_queries", "recall", F.lit(float(seconds)).alias("seconds"), (F.col("n_queries") / F.lit(max(float(seconds), 1e-9))).alias("queries_per_second"))


def tied_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(k, n_queries, recall): what is found no farther than the true k-th counts, whichever of equals it is."""
    far = truth.where(F.col("rank") <= k).groupBy("qid").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("true"))
    near = far.join(found.where(F.col("rank") <= k).select("qid", "dist"), "qid", "left")
    each = near.groupBy("qid", "true").agg(F.sum((F.col("dist") <= F.col("far") + 1e-9).cast("long")).alias("n"))
    return each.agg(F.lit(k).cast("long").alias("k"), F.count(F.lit(1)).alias("n_queries"), F.avg(F.coalesce("n", F.lit(0)) / F.col("true")).alias("recall"))


def merge_profile(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, candidates, queries, bytes): what each part of a sharded search sends to the merge (ids and distances)."""
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("qid").alias("queries"))
        one = one.select(F.lit(name).alias("part"), "candidates", "queries", (F.col("candidates") * 24).alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out


def write_csv(rows: DataFrame, path: str) -> None:
    """A report as one CSV file with a header; reports have a row for each part, step or search."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
