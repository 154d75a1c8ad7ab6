"""One face for all indexes: rows, deletions, capacity, search, save and load."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.options import SearchOptions
from ..sources.tables import checkpointed, fingerprint, load_index, save_index
from . import flat, graph, ivf, maintain, partition, pq
from .topk import vector_columns


class Searcher(Protocol):
    """What a kind of index has to offer."""

    def build(self, rows: DataFrame) -> None: ...

    def search(self, queries: DataFrame, options: SearchOptions, allowed: DataFrame | None) -> DataFrame: ...

    def save(self, path: str, meta: dict) -> None:
        """Write the tables that a search needs."""

    def load(self, spark: SparkSession, path: str, meta: dict, rows: DataFrame) -> bool:
        """Take such tables up again; false if they are absent or of other rows or parameters."""


class Flat:
    def build(self, rows: DataFrame) -> None:
        self.rows = rows

    def save(self, path: str, meta: dict) -> None:
        pass

    def load(self, spark: SparkSession, path: str, meta: dict, rows: DataFrame) -> bool:
        self.rows = rows
        return True

    def search(self, queries: DataFrame, options: SearchOptions, allowed: DataFrame | None = None) -> DataFrame:
        rows = self.rows if allowed is None else self.rows.join(allowed, "vec_id", "left_semi")
        return flat.search(rows, queries, options)


class Inverted:
    def __init__(self, nlist: int = 16, steps: int = 10):
        self.nlist, self.steps = nlist, steps

    def build(self, rows: DataFrame) -> None:
        self.index = ivf.build(rows, self.nlist, self.steps)

    def save(self, path: str, meta: dict) -> None:
        ivf.save(self.index, path, meta)

    def load(self, spark: SparkSession, path: str, meta: dict, rows: DataFrame) -> bool:
        self.index = ivf.load(spark, path, meta)
        return self.index is not None

    def search(self, queries: DataFrame, options: SearchOptions, allowed: DataFrame | None = None) -> DataFrame:
        index = self.index if allowed is None else ivf.IVF(self.index.centroids, self.index.lists.join(allowed, "vec_id", "left_semi"))
        return ivf.search(index, queries, options.k, options.nprobe)


class Quantised(Inverted):
    def __init__(self, nlist: int = 16, steps: int = 10, subspaces: int = 16, size: int = 16):
        super().__init__(nlist, steps)
        self.subspaces, self.size = subspaces, size

    def build(self, rows: DataFrame) -> None:
        super().build(rows)
        self.book, self.codes = pq.train(vector_columns(rows), self.subspaces, self.size, self.steps), None

    def save(self, path: str, meta: dict) -> None:
        pq.save_coded(self.index, self.book, path, meta)

    def load(self, spark: SparkSession, path: str, meta: dict, rows: DataFrame) -> bool:
        found = pq.load_coded(spark, path, meta)
        if found is not None:
            self.index, self.book, self.codes = found
        return found is not None

    def search(self, queries: DataFrame, options: SearchOptions, allowed: DataFrame | None = None) -> DataFrame:
        index, codes = self.index, self.codes
        if allowed is not None:
            index = ivf.IVF(index.centroids, index.lists.join(allowed, "vec_id", "left_semi"))
            codes = codes and codes.join(allowed, "vec_id", "left_semi")
        return pq.ivf_search(index, queries, self.book, options.k, options.candidates, options.nprobe, codes)


class SmallWorld:
    """Graphs by part. Rows that come or go change the graphs of their pieces; nothing else is linked anew."""

    def __init__(self, parts: int = 1, m: int = 16, ef: int = 150):
        self.parts, self.m, self.ef = parts, m, ef

    def build(self, rows: DataFrame) -> None:
        self.nodes = checkpointed(graph.build(partition.partitioned(rows, self.parts, "contiguous"), self.m, self.ef))

    def change(self, rows: DataFrame, gone: DataFrame) -> None:
        """Rows that have a place keep their part, new ones go to the part of a hash of their id."""
        at = self.nodes.select("vec_id", F.col("part").alias("had"))
        placed = rows.join(at, "vec_id", "left").select(F.coalesce("had", F.pmod(F.xxhash64("vec_id"), F.lit(self.parts))).alias("part"), "vec_id", "embedding")
        now, parts = graph.changed(self.nodes, placed, gone, self.m, self.ef)
        if parts:
            self.nodes = checkpointed(self.nodes.where(~F.col("part").isin(parts)).unionByName(now))

    def save(self, path: str, meta: dict) -> None:
        graph.save(self.nodes, path, meta)

    def load(self, spark: SparkSession, path: str, meta: dict, rows: DataFrame) -> bool:
        self.nodes = graph.load(spark, path, meta)
        return self.nodes is not None

    def search(self, queries: DataFrame, options: SearchOptions, allowed: DataFrame | None = None) -> DataFrame:
        return graph.search_nodes(self.nodes, queries, options.k, options.beam, allowed=allowed)

    def within(self, queries: DataFrame, eps: float, least: int = 100, allowed: DataFrame | None = None) -> DataFrame:
        return graph.range_nodes(self.nodes, queries, eps, least, allowed=allowed)

    def documents(self, queries: DataFrame, docs: DataFrame, n: int, ef: int = 64) -> DataFrame:
        return graph.document_nodes(self.nodes, queries, docs, n, ef)


KINDS = {"flat": Flat, "ivf": Inverted, "ivfpq": Quantised, "hnsw": SmallWorld}


class Index:
    """Rows (vec_id, embedding) under one kind of index.

    Adding rows replaces those of the same ids; deleted rows stay in place, unseen,
    until they are restored or replaced. An index is built when it is first searched; after that, rows that come
    change a graph in place, while other kinds are built again.
    """

    def __init__(self, spark: SparkSession, kind: str = "flat", capacity: int | None = None, **parameters):
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {sorted(KINDS)}")
        self.spark, self.kind, self.capacity, self.parameters = spark, kind, capacity, parameters
        self.rows = spark.createDataFrame([], "vec_id long, embedding array<float>")
        self.deleted = spark.createDataFrame([], "vec_id long")
        self._searcher: Searcher | None = None

    def add(self, rows: DataFrame, replace_deleted: bool = False) -> None:
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        if replace_deleted:
            table, left = maintain.replace_deleted(self.rows, self.deleted, rows)
            table, self.deleted = checkpointed(table), checkpointed(left)
        else:
            table = checkpointed(maintain.upsert(self.rows, rows))
            self.deleted = checkpointed(self.deleted.join(rows, "vec_id", "left_anti"))
        if self.capacity is not None and (n := table.count()) > self.capacity:
            raise ValueError(f"{n} rows exceed the capacity of {self.capacity}")
        if isinstance(self._searcher, SmallWorld):
            gone = self.rows.select("vec_id").join(table, "vec_id", "left_anti")
            self._searcher.change(rows, gone)
        else:
            self._searcher = None
        self.rows = table

    def resize(self, capacity: int) -> None:
        self.capacity = maintain.resized(self.rows.count(), capacity)

    def delete(self, ids: DataFrame) -> None:
        """Ids that are absent or deleted already are an error."""
        self.deleted = checkpointed(maintain.mark_deleted(self.deleted, self.rows, ids))

    def restore(self, ids: DataFrame) -> None:
        self.deleted = checkpointed(maintain.unmark_deleted(self.deleted, ids))

    def __len__(self) -> int:
        return self.rows.count()

    def ids(self) -> DataFrame:
        return self.rows.select("vec_id")

    def vectors(self, ids: DataFrame) -> DataFrame:
        return maintain.vectors(self.rows, ids)

    def search(self, queries: DataFrame, options: SearchOptions = SearchOptions(), allowed: DataFrame | None = None, full: bool = False) -> DataFrame:
        """(qid, vec_id, dist, rank) among live, allowed rows; ``full``: fewer than k rows for a query are an error."""
        searcher = self._built()
        if not self.deleted.isEmpty():
            live = maintain.live(self.rows, self.deleted).select("vec_id")
            allowed = live if allowed is None else live.join(allowed, "vec_id", "left_semi")
        found = searcher.search(queries, options, allowed)
        return checked(found, queries, options.k) if full else found

    def _built(self) -> Searcher:
        if self._searcher is None:
            self._searcher = KINDS[self.kind](**self.parameters)
            self._searcher.build(self.rows)
        return self._searcher

    def within(self, queries: DataFrame, eps: float, least: int = 100) -> DataFrame:
        """(qid, vec_id, dist, rank): live rows within ``eps``, by product distance."""
        live = maintain.live(self.rows, self.deleted)
        if self.kind == "hnsw":
            return self._built().within(queries, eps, least, live.select("vec_id"))
        return flat.range_search(live, queries, eps, "ip")

    def documents(self, queries: DataFrame, docs: DataFrame, n: int, ef: int = 64) -> DataFrame:
        """(qid, vec_id, doc, dist): live rows of the n nearest documents; docs: (vec_id, doc)."""
        docs = docs.join(maintain.live(self.rows, self.deleted).select("vec_id"), "vec_id", "left_semi")
        if self.kind == "hnsw":
            return self._built().documents(queries, docs, n, ef)
        rows = vector_columns(self.rows).join(docs.select("vec_id", F.col("doc").cast("long").alias("doc")), "vec_id")
        return flat.document_search(rows, flat.asked(queries), n)

    def save(self, path: str) -> None:
        """Rows, deletions, parameters, and the tables of the kind as they are built: lists, books and codes, or links."""
        save_index({"rows": self.rows, "deleted": self.deleted}, path, self._meta())
        self._built().save(f"{path}/built", self._meta())

    def _meta(self) -> dict:
        return {"kind": self.kind, "capacity": self.capacity, "parameters": self.parameters, "data": fingerprint(self.rows)}

    @classmethod
    def load(cls, spark: SparkSession, path: str, capacity: int | None = None) -> Index:
        """A saved index, ready to be searched without building; rows that are not those that were saved are an error."""
        found = load_index(spark, path)
        if found is None:
            raise FileNotFoundError(path)
        meta = json.loads(found["meta"].first()["meta"])
        out = cls(spark, meta["kind"], meta["capacity"] if capacity is None else capacity, **meta["parameters"])
        out.rows, out.deleted = found["rows"], found["deleted"]
        if fingerprint(out.rows) != meta["data"]:
            raise ValueError(f"{path}: the rows have changed since they were saved")
        if out.capacity is not None:
            out.resize(out.capacity)
        searcher = KINDS[out.kind](**out.parameters)
        if not searcher.load(spark, f"{path}/built", meta, out.rows):
            raise ValueError(f"{path}: the tables of the index are missing, or of other rows")
        out._searcher = searcher
        return out


def checked(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same rows; an error if some query has fewer than k."""
    found = checkpointed(found)
    short = queries.select("qid").distinct().join(found.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left").where(F.coalesce("n", F.lit(0)) < k)
    if (n := short.count()):
        raise ValueError(f"{n} queries have fewer than {k} neighbours; ef or nprobe is too small, or the filter too strict")
    return found
