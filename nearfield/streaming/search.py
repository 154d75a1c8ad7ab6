"""Queries as a stream: each micro-batch is answered as a whole."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.topk import ranked
from ..plans.report import Timings
from ..sources.tables import checkpointed


def read_queries(spark: SparkSession, path: str, schema: str = "qid long, embedding array<float>", files: int = 8) -> DataFrame:
    """A stream of query files; ``files`` of them at most enter a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def answer(queries: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Answer each batch by ``search`` and append it, laid out by batch: a batch that is done again overwrites itself."""

    def batch(df: DataFrame, number: int) -> None:
        search(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A stage takes the batch's queries and what the stage before it found.
Stage = Callable[[DataFrame, DataFrame | None], DataFrame]


def answer_staged(queries: DataFrame, stages: dict[str, Stage], out: str, checkpoint: str) -> StreamingQuery:
    """Answer each batch stage by stage (probe, candidates, rerank, ...), each written before the next one reads it.

    The last stage's rows are the answer; the seconds of each stage are kept beside
    them, under ``timings``. A batch that is done again overwrites itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        timings, found = Timings(), None
        asked = checkpointed(df)
        names = list(stages)
        for name in names:
            with timings.step(name):
                rows = stages[name](asked, found)
                if name == names[-1]:
                    rows.write.mode("overwrite").parquet(f"{out}/answers/batch={number}")
                else:
                    found = checkpointed(rows)
        seconds = df.sparkSession.createDataFrame(timings.rows(), "stage string, seconds double")
        seconds.coalesce(1).write.mode("overwrite").parquet(f"{out}/timings/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ivfpq_stages(index, book, k: int = 10, top_p: int = 50, nprobe: int = 4) -> dict[str, Stage]:
    """Probe, table distances and rerank as three stages."""
    from ..operators import flat, ivf, pq

    def candidates(queries: DataFrame, probed: DataFrame | None) -> DataFrame:
        held = index.lists.join(probed.select("list_id").distinct(), "list_id", "left_semi")
        p = max(k, top_p)
        return ranked(flat.scan(held, flat.asked(queries), pq._adc_kernel(book), p, probed_of=ivf.probed_of(index, nprobe)), p)

    return {
        "probe": lambda queries, _: ivf.probes(index, queries, nprobe).drop("q"),
        "candidates": candidates,
        "rerank": lambda queries, near: flat.rerank(near, index.lists.select("vec_id", "v"), flat.asked(queries), k),
    }


#: A stage of a chain takes rows of one query each, and returns such rows (the last one: answers).
Link = Callable[[DataFrame], DataFrame]


class Chain:
    """Stages as streaming queries of their own, each fed by the table that the one before it writes: they overlap.

    A batch is written beside its place and moved there at once, so the next stage sees whole batches only; one that is
    done again after a failure finds its place taken and changes nothing. A stage that is ``ahead`` batches before the
    next one waits. ``schemas`` are those of what the stages read: the first one is that of the source's files.
    """

    def __init__(self, spark: SparkSession, source: str, stages: dict[str, Link], schemas: list[str], root: str, files: int = 1, ahead: int = 2):
        self.spark, self.root, self.ahead, self.names = spark, root, ahead, list(stages)
        self.done = dict.fromkeys(self.names, 0)
        self.timings: list[tuple[str, int, float, float]] = []
        self.lock, self.stopped = threading.Lock(), threading.Event()
        self.queries: list[StreamingQuery] = []
        for i, (name, schema) in enumerate(zip(self.names, schemas, strict=True)):
            path = source if i == 0 else f"{root}/{self.names[i - 1]}"
            self._make(path)
            rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)
            writer = rows.writeStream.foreachBatch(self._batch(i, stages[name])).option("checkpointLocation", f"{root}/_checkpoints/{name}")
            self.queries.append((writer.trigger(availableNow=True) if i == 0 else writer.trigger(processingTime="100 milliseconds")).queryName(f"{name}-{id(self)}").start())

    def _store(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _make(self, path: str) -> None:
        store, place = self._store(path)
        store.mkdirs(place)

    def _batch(self, at: int, stage: Link):
        name = self.names[at]

        def run(df: DataFrame, number: int) -> None:
            after = self.names[at + 1] if at + 1 < len(self.names) else None
            while after and self.done[name] - self.done[after] >= self.ahead and not self.stopped.is_set():
                time.sleep(0.02)
            began = time.time()
            target, staging = f"{self.root}/{name}/batch={number}", f"{self.root}/_staging/{name}-{number}"
            store, place = self._store(target)
            if not store.exists(place):
                # one file a batch: the next stage takes a batch as a whole
                stage(df).coalesce(1).write.mode("overwrite").parquet(staging)
                if not store.rename(self._store(staging)[1], place):
                    raise OSError(f"{staging} could not be moved to {target}")
            with self.lock:
                self.done[name] += 1
                self.timings.append((name, number, began, time.time()))

        return run

    def finish(self) -> DataFrame:
        """Wait until all that the source has is answered; (stage, batch, began, ended) in seconds. A stage's failure is raised here."""
        try:
            self.queries[0].awaitTermination()
            for q in self.queries[1:]:
                q.processAllAvailable()
        finally:
            self.stopped.set()
            for q in self.queries:
                q.stop()
        return self.spark.createDataFrame(self.timings, "stage string, batch long, began double, ended double")

    def answers(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/{self.names[-1]}")


def ivfpq_chain(spark: SparkSession, source: str, index, book, root: str, k: int = 10, top_p: int = 50, nprobe: int = 4, ahead: int = 2) -> Chain:
    """Probe, table distances and rerank of queries (qid, embedding) that arrive as files under ``source``, overlapped."""
    from ..operators import flat, ivf, pq

    query, kind = "qid long, embedding array<float>", F.collect_list(F.struct("rank", "id"))

    def listed(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
        per = found.groupBy("qid").agg(F.transform(F.array_sort(kind), lambda s: s["id"]).alias(name))
        return rows.select("qid", "embedding").join(per, "qid")

    def probe(rows: DataFrame) -> DataFrame:
        return listed(rows, ivf.probes(index, rows, nprobe).select("qid", "rank", F.col("list_id").alias("id")), "lists")

    def candidates(rows: DataFrame) -> DataFrame:
        held = index.lists.join(rows.select(F.explode("lists").alias("list_id")).distinct(), "list_id", "left_semi")
        p = max(k, top_p)
        near = ranked(flat.scan(held, flat.asked(rows), pq._adc_kernel(book), p, probed_of=ivf.probed_of(index, nprobe)), p)
        return listed(rows, near.select("qid", "rank", F.col("vec_id").alias("id")), "near")

    def rerank(rows: DataFrame) -> DataFrame:
        near = rows.select("qid", F.explode("near").alias("vec_id"))
        return flat.rerank(near, index.lists.select("vec_id", "v"), flat.asked(rows), k)

    schemas = [query, f"{query}, lists array<long>", f"{query}, near array<long>"]
    return Chain(spark, source, {"probe": probe, "candidates": candidates, "rerank": rerank}, schemas, root, 1, ahead)
