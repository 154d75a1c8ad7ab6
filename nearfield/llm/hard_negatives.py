"""Hard-negative mining by norm-bucketed search for largest inner products.

Candidates are sorted by norm and cut into chunks, one to a partition, and each chunk into
buckets. A product is at most the anchor's norm times the bucket's largest one (Cauchy and
Schwarz), so a bucket is passed over for a window whose lower limit, or whose k-th
score so far, lies above that bound; chunks below all of an anchor's limits never meet it.

Anchors are a part of the rows, dealt out to the chunks: in a chunk's task candidates come
first and anchors stream past them in blocks, so that memory holds one chunk and one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.ship import ship
from ._spark import checkpointed
from ._vectors import exact, integers, matrix, slices

#: Candidates of a chunk at most (by about 300 bytes each), of a bucket, and anchors of a block.
CHUNK_ROWS, BUCKET, ANCHORS = 131_072, 2048, 1024
#: The largest integer component: a hundred times a product of up to 2**13 of them fits 64 bits.
MOST = 1 << 21
ROWS = "vec_id long, label long, anchor boolean, norm long, x binary"
_POSITIVE, _NEGATIVE = "anchor_id long, vec_id long, score long", "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _packed(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, vectors = integers(part["embedding"], scale, MOST)
            at = pa.array(rows)
            norms = [int(v @ v) for v in vectors]
            yield pa.RecordBatch.from_arrays([part["vec_id"].take(at), part["label"].take(at), part["anchor"].take(at), pa.array(norms, pa.int64()), pa.array([v.astype(np.int32).tobytes() for v in vectors], pa.binary())], names=["vec_id", "label", "anchor", "norm", "x"])

    return run


class Top:
    """The k best (score, least id) of each anchor so far."""

    def __init__(self, n: int, k: int):
        self.score, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Single candidates (anchor number, score, id)."""
        last = self.score[row, -1]
        some = (score > last) | ((score == last) & (ids < self.ids[row, -1]))
        row, score, ids = row[some], score[some], ids[some]
        if not len(row):
            return
        k, hit = self.score.shape[1], np.unique(row)
        row = np.concatenate([np.repeat(hit, k), row])
        score, ids = np.concatenate([self.score[hit].ravel(), score]), np.concatenate([self.ids[hit].ravel(), ids])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < k
        self.score[row[first], place[first]], self.ids[row[first], place[first]] = score[first], ids[first]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor number, id, score) of all entries."""
        row, place = np.nonzero(np.isfinite(self.score))
        return row, self.ids[row, place], self.score[row, place].astype(np.int64)


class Chunk:
    """Candidates by falling norm, cut into buckets."""

    def __init__(self, rows: pa.Table, bucket: int):
        self.ids, self.labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.norms, self.x = rows["norm"].to_numpy().astype(np.float64), _matrix(rows["x"])
        self.cuts = range(0, len(self.ids), bucket)
        self.bucket = bucket

    def buckets(self) -> Iterator[tuple[slice, float]]:
        """(rows, largest norm) of each bucket."""
        for a in self.cuts:
            yield slice(a, a + self.bucket), float(np.sqrt(self.norms[a]))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return matrix([np.frombuffer(b, np.int32) for b in column.to_pylist()])


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    width = min(a.shape[1], x.shape[1])
    return a[:, :width] @ x[:, :width].T


def _bound(norm: np.ndarray, top: float) -> np.ndarray:
    return norm * top * (1 + 1e-9) + 1


def _positives(chunk: Chunk, block: pa.Table, k: int) -> pa.RecordBatch:
    """The k best other candidates of each anchor's own label."""
    ids, labels = block["vec_id"].to_numpy(), block["label"].to_numpy()
    norm = np.sqrt(block["norm"].to_numpy().astype(np.float64))
    a, x = exact(_matrix(block["x"]), chunk.x)
    best = Top(len(ids), k)
    for rows, top in chunk.buckets():
        open_ = best.worst() <= _bound(norm, top)
        theirs = chunk.labels[rows]
        for label in np.unique(labels[open_]).tolist():
            who, cand = np.flatnonzero(open_ & (labels == label)), np.flatnonzero(theirs == label)
            if len(cand):
                score = _products(a[who], x[rows][cand])
                i, j = np.nonzero((score >= best.worst()[who][:, None]) & (chunk.ids[rows][cand][None] != ids[who][:, None]))
                best.add(who[i], score[i, j], chunk.ids[rows][cand[j]])
    row, found, score = best.found()
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(score)], names=["anchor_id", "vec_id", "score"])


def _negatives(chunk: Chunk, block: pa.Table, k: int, low: int, high: int) -> pa.RecordBatch:
    """For each anchor and positive, the k best candidates of other labels inside the positive's window of scores."""
    ids, labels = block["vec_id"].to_numpy(), block["label"].to_numpy()
    norm = np.sqrt(block["norm"].to_numpy().astype(np.float64))
    a, x = exact(_matrix(block["x"]), chunk.x)
    met = block["positives"].to_pylist()
    width = max((len(p) for p in met), default=0)
    whose, given, scores, tops, limits = [], [], [], [], []
    for w in range(width):
        who = np.array([i for i, p in enumerate(met) if len(p) > w])
        s = np.array([met[i][w]["score"] for i in who], dtype=np.int64)
        whose.append(who)
        given.append(np.array([met[i][w]["vec_id"] for i in who], dtype=np.int64))
        scores.append(s)
        tops.append(Top(len(who), k))
        # whole numbers between low and high hundredths of the positive's score
        limits.append((-(-low * s // 100), high * s // 100))
    for rows, top in chunk.buckets():
        bound = _bound(norm, top)
        open_ = [bound[who] >= np.maximum(lo, t.worst()) for who, t, (lo, _) in zip(whose, tops, limits, strict=True)]
        some = np.unique(np.concatenate([who[o] for who, o in zip(whose, open_, strict=True)])) if width else np.zeros(0, dtype=int)
        if not len(some):
            continue
        score = np.full((len(some), len(chunk.ids[rows])), -np.inf)
        score[:] = _products(a[some], x[rows])
        score[labels[some][:, None] == chunk.labels[rows][None]] = -np.inf
        for who, o, t, (lo, hi) in zip(whose, open_, tops, limits, strict=True):
            at = np.flatnonzero(o)
            s = score[np.searchsorted(some, who[at])]
            i, j = np.nonzero((s >= np.maximum(lo[at], t.worst()[at])[:, None]) & (s <= hi[at][:, None]))
            t.add(at[i], s[i, j], chunk.ids[rows][j])
    out = []
    for who, pid, ps, t in zip(whose, given, scores, tops, strict=True):
        row, found, score = t.found()
        out.append((ids[who[row]], pid[row], ps[row], found, score))
    columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, dtype=np.int64) for c in range(5)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score", "vec_id", "score"])


def _meeting(answer: Callable[[Chunk, pa.Table], pa.RecordBatch], bucket: int, block: int):
    """Rows of one chunk, candidates first: anchors pass by in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: Chunk | None = None
        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            n = int(np.count_nonzero(batch["asks"].to_numpy(zero_copy_only=False) == 0))
            if n:
                held.append(batch.slice(0, n))
            asks = batch.slice(n)
            if not asks.num_rows:
                continue
            if chunk is None:
                chunk = Chunk(pa.Table.from_batches(held), bucket) if held else Chunk(pa.Table.from_batches([batch.slice(0, 0)]), bucket)
                held = []
            for a in range(0, asks.num_rows, block):
                held.append(asks.slice(a, block))
                waiting += held[-1].num_rows
                if waiting >= block:
                    yield answer(chunk, pa.Table.from_batches(held))
                    held, waiting = [], 0
        if chunk is not None and held:
            yield answer(chunk, pa.Table.from_batches(held))

    return run


def _met(candidates: DataFrame, anchors: DataFrame, chunks: int, answer, schema: str, bucket: int) -> DataFrame:
    """``answer`` of every chunk to the anchors that ask it; anchors have ``last``, the last chunk that can matter to them."""
    kind = "array<struct<vec_id:bigint,score:bigint>>"
    have = candidates.select("chunk", F.lit(0).alias("asks"), "vec_id", "label", "norm", "x", F.lit(None).cast(kind).alias("positives"))
    ask = anchors.where("last >= 0").select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk"), F.lit(1).alias("asks"), "vec_id", "label", "norm", "x", F.col("positives").cast(kind).alias("positives"))
    both = have.unionByName(ask).repartitionById(chunks, F.col("chunk")).sortWithinPartitions("asks", F.col("norm").desc(), "vec_id")
    return both.drop("chunk").mapInArrow(_meeting(answer, bucket, ANCHORS), schema)


def _first(rows: DataFrame, k: int, *key: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.col("score").desc(), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def candidates(rows: DataFrame, is_anchor: Column, scale: int, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, list[int]]:
    """((vec_id, label, anchor, norm, x, chunk) by falling norm, largest squared norm of each chunk).

    Rows without id, label or usable vector are left out. Of rows that repeat an id the one of least
    label, and then of least vector, counts.
    """
    spark = rows.sparkSession
    ship(spark)
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), is_anchor.alias("anchor"), "embedding").where("vec_id is not null and label is not null and embedding is not null")
    packed = some.mapInArrow(_packed(scale), ROWS)
    n = rows.count()
    parts = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n // chunk_rows))

    def cut(packed: DataFrame) -> DataFrame:
        # vec_id is a key too: equal norms, as of many copies, are dealt out like others
        dealt = packed.repartitionByRange(parts, F.col("norm").desc(), F.col("vec_id"))
        return checkpointed(dealt.withColumn("chunk", F.spark_partition_id()))

    out = cut(packed)
    if not out.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        once = packed.groupBy("vec_id").agg(F.min(F.struct("label", "x", "anchor", "norm")).alias("r"))
        out = cut(once.select("vec_id", "r.label", "r.anchor", "r.norm", "r.x"))
    top = {r.chunk: r.top for r in out.groupBy("chunk").agg(F.max("norm").alias("top")).collect()}
    return out, [top.get(c, 0) for c in range(1 + max(top, default=-1))]


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, chunk_rows: int = CHUNK_ROWS, bucket: int = BUCKET) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for (vec_id, label, embedding) rows.

    Components become floor(scale * x), a score is the product with the anchor; higher ones come first, ties by
    smaller vec_id. An anchor's positives are its first ``positives`` other rows of its label; for each, the
    first ``negatives`` rows of other labels follow whose score lies between ``low`` and ``high`` hundredths of the
    positive's. Rows with a null id, label or vector, or a null or non-finite component take no part; missing components of
    shorter vectors count as 0; of rows that repeat an id the least (label, vector) counts. Anchors without positives, or without
    negatives in the window, have no rows. Components beyond 2**21 / scale are an error.
    """
    have, tops = candidates(rows, is_anchor, scale, chunk_rows)
    chunks = len(tops)
    asking = have.where("anchor").drop("chunk", "anchor")
    if not chunks:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    every = asking.withColumn("last", F.lit(chunks - 1)).withColumn("positives", F.lit(None))
    found = _met(have, every, chunks, lambda c, b: _positives(c, b, positives), _POSITIVE, bucket)
    near = _first(found, positives, "anchor_id").where("score >= 0")  # a window of negative scores is empty
    held = checkpointed(near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "score"))).alias("positives"), F.min("score").alias("least")))
    # chunks fall in norm: those whose bound is below the least limit come last
    limit = F.floor(F.col("least") * low / 100)
    reached = F.size(F.filter(F.lit([float(t) for t in tops]), lambda t: F.sqrt(t * F.col("norm")) * (1 + 1e-9) + 1 >= limit)) - 1
    windows = asking.join(held.hint("merge"), asking["vec_id"] == held["anchor_id"]).withColumn("last", reached)
    found = _met(have, windows, chunks, lambda c, b: _negatives(c, b, negatives, low, high), _NEGATIVE, bucket)
    out = _first(found, negatives, "anchor_id", "positive_id")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: DuckDB form of the query; {embeddings} names the table.
SQL = r"""
WITH b AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda y: floor(256 * CAST(y AS DOUBLE))) AS x
  FROM {embeddings}
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM b a, b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
