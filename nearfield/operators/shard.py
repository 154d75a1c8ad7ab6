"""Sharded search and its balance."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import checkpointed, load_index
from .flat import search_local
from .ivf import IVF, build, probes
from .partition import shards
from .pq import ivf_search, load_coded, save_coded, train
from .topk import merged, vector_columns


def search(base: DataFrame, queries: DataFrame, n: int, k: int = 10) -> DataFrame:
    """Top k of each shard, merged."""
    return search_local(base, queries, k, n, k)


@dataclass
class Shard:
    """The index of one shard: lists and a book of its own, trained on its rows alone."""

    index: IVF
    book: np.ndarray


def build_ivfpq(base: DataFrame, n: int, nlist: int, subspaces: int, size: int, steps: int = 10) -> list[Shard]:
    """An inverted index with product codes for each contiguous shard; other neighbours are found than by a global one."""
    rows = checkpointed(shards(base.select("vec_id", "embedding"), n))
    out = []
    for s in range(n):
        part = rows.where(F.col("shard") == s).drop("shard")
        out.append(Shard(build(part, nlist, steps), train(vector_columns(part), subspaces, size, steps)))
    return out


def search_ivfpq(parts: list[Shard], queries: DataFrame, k: int = 10, top_p: int = 50, nprobe: int = 4) -> DataFrame:
    """Every shard is searched by its own index; its top k meet in one merge."""
    return merged(*(ivf_search(s.index, queries, s.book, k, top_p, nprobe) for s in parts), k=k)


def save(parts: list[Shard], path: str, meta: dict) -> None:
    """Each shard's index as a bundle of its own, with the number of shards in each."""
    for i, s in enumerate(parts):
        save_coded(s.index, s.book, f"{path}/shard={i}", meta | {"shards": len(parts)})


def load(spark: SparkSession, path: str, meta: dict, only: list[int] | None = None) -> list[Shard] | None:
    """The saved shards (or only some of them); None if one is absent or was built otherwise."""
    first = load_index(spark, f"{path}/shard=0")
    if first is None:
        return None
    n = json.loads(first["meta"].first()["meta"])["shards"]
    found = [load_coded(spark, f"{path}/shard={i}", meta | {"shards": n}) for i in (range(n) if only is None else only)]
    return None if None in found else [Shard(index, book) for index, book, _ in found]


def balance(index: IVF, queries: DataFrame, n: int, nprobe: int = 4) -> DataFrame:
    """(shard, local_count, avg_scan_count, imbalance): rows a shard holds and scans for a query; greatest over mean."""
    placed = shards(index.lists.select("vec_id", "list_id"), n)
    held = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("local_count"))
    per = placed.groupBy("shard", "list_id").agg(F.count(F.lit(1)).alias("rows"))
    asked = probes(index, queries, nprobe).groupBy("list_id").agg(F.count(F.lit(1)).alias("asks"))
    scanned = per.join(asked, "list_id").groupBy("shard").agg(F.sum(F.col("rows") * F.col("asks")).alias("scans"))
    out = held.join(scanned, "shard", "left").withColumn("avg_scan_count", F.coalesce("scans", F.lit(0)) / F.lit(queries.count()))
    every = W.partitionBy()
    return out.select("shard", "local_count", "avg_scan_count", (F.max("avg_scan_count").over(every) / F.avg("avg_scan_count").over(every)).alias("imbalance"))
