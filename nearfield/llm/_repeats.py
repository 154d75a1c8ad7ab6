"""Finding repeated keys at scale, for the exact-substring operators.

Rows are first thinned inside each task: of the rows of one key a task keeps one
for the exchange and passes the rest on as known repeats. So however often a key
occurs, it sends one row per task and buffer, and no key gathers its rows in one
place. What is sent is packed: the rows of a buffer that go to one partition
travel as one binary, column by column and byte plane by byte plane, which takes
half the space of rows. The receiving task reads its part in up to ``SUBS`` slices of
the key space, sorted ahead by Spark, and holds one slice at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import checkpointed, table, texts
from ._text import U64, ragged

BUFFER_ROWS, SUBS, MARKS_A_ROW = 1 << 19, 4, 1 << 15
PACKED = "bucket int, sub int, kind int, data binary"
PLACES = "doc_id long, mark long, kind int"
#: Kinds of packed rows and of places: keyed rows, known repeats, and rows to look at again.
KEYED, KNOWN, AGAIN = 0, 1, 2

Columns = tuple[np.ndarray, ...]


def pack(columns: Columns, widths: tuple[int, ...]) -> bytes:
    """Low bytes of unsigned 64-bit columns, plane by plane; a negative width stores differences."""
    out = []
    for x, w in zip(columns, widths, strict=True):
        x = x.astype(np.uint64)
        if w < 0:
            x = np.diff(x, prepend=U64(0))
        out.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, : abs(w)].T).tobytes())
    return b"".join(out)


def unpack(data: bytes, widths: tuple[int, ...]) -> Columns:
    n = len(data) // sum(map(abs, widths))
    out, at = [], 0
    for w in widths:
        full = np.zeros((n, 8), dtype=np.uint8)
        full[:, : abs(w)] = np.frombuffer(data, np.uint8, n * abs(w), at).reshape(abs(w), n).T
        at += n * abs(w)
        x = full.reshape(-1).view(np.uint64)
        out.append(np.cumsum(x, dtype=np.uint64) if w < 0 else x)
    return tuple(out)


_MARK = (-8, 4, 4)  # doc_id, pos, len


class Exchange:
    """Packs what one task sends; ``buckets`` has one id for each receiving partition."""

    def __init__(self, buckets: list[int], widths: tuple[int, ...]):
        self.buckets, self.widths, self.turn = np.array(buckets), widths, 0
        #: With many partitions each is small by itself, and slices would only multiply the packed rows.
        self.subs = max(1, min(SUBS, 256 // len(buckets)))

    @staticmethod
    def batch(bucket: list, sub: list, kind: int, data: list) -> pa.RecordBatch:
        return table("bucket:i,sub:i,kind:i,data:z", bucket=bucket, sub=sub, kind=[kind] * len(data), data=data)

    def keyed(self, key: np.ndarray, columns: Columns) -> Iterator[pa.RecordBatch]:
        """Send rows by the high 24 bits of their key; they keep their order within a partition."""
        n = len(self.buckets)
        high = (key >> U64(40)).astype(np.int64)
        slot = high % n * self.subs + high // n % self.subs
        order = np.argsort(slot, kind="stable")
        cut = np.flatnonzero(np.diff(slot[order], prepend=-1))
        cuts = np.append(cut, len(order)).tolist()
        slots = slot[order][cut].tolist()
        columns = tuple(c[order] for c in columns)
        data = [pack(tuple(c[a:b] for c in columns), self.widths) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield self.batch([self.buckets[s // self.subs] for s in slots], [s % self.subs for s in slots], KEYED, data)

    def known(self, doc: np.ndarray, pos: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Send marks to the partitions in turn."""
        for a in range(0, len(doc), MARKS_A_ROW):
            self.turn += 1
            part = slice(a, a + MARKS_A_ROW)
            yield self.batch([self.buckets[self.turn % len(self.buckets)]], [0], KNOWN, [pack((doc[part], pos[part], length[part]), _MARK)])


class Thinned:
    """Collects keyed rows of a task and sends them thinned.

    ``first`` sends of each key the least (doc, pos) only; all others are known
    repeats. Otherwise every row of a key that comes more than once is known to be
    repeated, and one row goes out under the key besides. Rows are (h, g, doc, pos).
    """

    def __init__(self, exchange: Exchange, first: bool):
        self.exchange, self.first, self.held, self.rows = exchange, first, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.rows += len(columns[0])
        if self.rows >= BUFFER_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        h, g, doc, pos = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.rows = [], 0
        order = np.lexsort((pos, doc, g, h)) if self.first else np.argsort(h, kind="stable")
        new = fresh(h[order], g[order])
        # rows go out in order of place: neighbours in a document then pack well
        lead = np.sort(order[new])
        columns = (h, g, doc, pos) if self.first else (h, doc, pos)
        yield from self.exchange.keyed(h[lead], tuple(c[lead] for c in columns))
        rest = order[beyond_first(new, doc[order], pos[order])] if self.first else order[np.bincount(c)[c] > 1] if len(c := np.cumsum(new) - 1) else order
        yield from self.exchange.known(*merged(doc[rest], pos[rest], np.ones(len(rest), dtype=np.int64)))


def fresh(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def beyond_first(new: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which rows of groups in order of place, each opened by a ``new`` row, lie at another place than the first.

    A row that comes twice has one place twice, and no copy of it is a repeat of the other.
    """
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, dtype=np.int64)
    out = np.zeros(len(new), dtype=bool)
    for c in place:
        out |= c != c[lead]
    return out


def merged(doc: np.ndarray, pos: np.ndarray, length: np.ndarray) -> Columns:
    """Marks in order of place; marks of length 1 that follow each other become one."""
    order = np.lexsort((pos, doc))
    doc, pos, length = doc[order], pos[order], length[order]
    if not len(doc) or length.max() > 1:
        return doc, pos, length
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], pos[at], np.diff(np.append(at, len(new)))


def places(doc: np.ndarray, pos: np.ndarray, length: np.ndarray, kind: int = KNOWN) -> pa.RecordBatch:
    mark = (pos.astype(np.int64) << 32) | length.astype(np.int64)
    return table("doc_id:l,mark:l,kind:i", doc_id=doc.astype(np.uint64).view(np.int64), mark=mark, kind=np.full(len(doc), kind, dtype=np.int32))


FIRST_WIDTHS = (8, 4, -8, 4)  # h, g, doc, pos
MANY_WIDTHS = (5, -8, 4)  # h, doc, pos


def many(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places of keys that come more than once."""
    order = np.argsort(h, kind="stable")
    group = np.cumsum(fresh(h[order])) - 1
    if len(order):
        rest = order[np.bincount(group)[group] > 1]
        yield places(*merged(doc[rest].view(np.int64), pos[rest].view(np.int64), np.ones(len(rest), dtype=np.int64)))


def not_first(h: np.ndarray, g: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places of keys that a lesser place has too."""
    doc, pos = doc.view(np.int64), pos.view(np.int64)
    order = np.lexsort((pos, doc, g, h))
    rest = order[beyond_first(fresh(h[order], g[order]), doc[order], pos[order])]
    yield places(*merged(doc[rest], pos[rest], np.ones(len(rest), dtype=np.int64)))


def not_first_doc(h: np.ndarray, g: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places of keys that a lesser document has too."""
    doc, pos = doc.view(np.int64), pos.view(np.int64)
    order = np.lexsort((pos, doc, g, h))
    rest = order[beyond_first(fresh(h[order], g[order]), doc[order])]
    yield places(*merged(doc[rest], pos[rest], np.ones(len(rest), dtype=np.int64)))


def receive(judge: Callable[..., Iterator[pa.RecordBatch]], widths: tuple[int, ...]):
    """Reads the packed rows of a partition, slice by slice, and judges each slice's keyed rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        current = None
        for batch in batches:
            for sub, kind, data in zip(batch["sub"].to_pylist(), batch["kind"].to_pylist(), batch["data"], strict=True):
                if kind == KNOWN:
                    yield places(*unpack(data.as_py(), _MARK))
                    continue
                if sub != current and held:
                    yield from judge(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                current = sub
                held.append(unpack(data.as_py(), widths))
        if held:
            yield from judge(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def exchanged(sent: DataFrame, n: int, judge: Callable[..., Iterator[pa.RecordBatch]], widths: tuple[int, ...]) -> DataFrame:
    """(doc_id, mark, kind) of what ``judge`` finds, and of what was known before."""
    return sent.repartition(n, "bucket").sortWithinPartitions("sub").mapInArrow(receive(judge, widths), PLACES)


def bucket_ids(spark: SparkSession) -> list[int]:
    """One number for each shuffle partition that Spark's hash sends there."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(24 * n).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"), F.col("id").cast("int").alias("id"))
    return [r.id for r in rows.groupBy("p").agg(F.min("id").alias("id")).orderBy("p").collect()]


def based(documents: DataFrame) -> DataFrame:
    """(doc_id, text) and, where rows of one doc_id differ, ``base``: rows of one id are one document, laid end to end.

    ``base`` is the place at which a row begins in its document, in bytes or words; rows of one
    text have one base, so a row that comes twice is no copy of itself.
    """
    docs = texts(documents)
    named = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    mixed = named.groupBy("doc_id").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low <> high")
    mixed = checkpointed(mixed.select("doc_id"))
    if mixed.isEmpty():
        return docs
    rows = named.join(mixed, "doc_id", "left_semi").distinct()
    before = F.coalesce(F.sum(F.col("size") + 1).over(W.partitionBy("doc_id").orderBy("hash", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = checkpointed(rows.select(F.col("doc_id").alias("mixed_id"), F.col("hash").alias("mixed_hash"), before.alias("before")))
    out = docs.join(rows, (docs.doc_id == rows.mixed_id) & (F.xxhash64("text") == rows.mixed_hash), "left")
    return checkpointed(out.select("doc_id", "text", F.coalesce("before", F.lit(0)).cast("long").alias("base")))


def marked(docs: DataFrame, found: DataFrame, keep_all: bool = False) -> DataFrame:
    """Documents (see ``based``) with their marks; the exchange of the texts is one and the same in every use.

    A mark is pos * 2**32 + length. ``keep_all`` keeps documents without marks, and
    rows whose doc_id is null.
    """
    marks = found.groupBy(F.col("doc_id").alias("marked_id")).agg(F.collect_list("mark").alias("marks")).hint("shuffle_hash")
    known = docs.where("doc_id is not null")
    out = known.join(marks, known.doc_id == marks.marked_id, "left" if keep_all else "inner").select(*docs.columns, "marks")
    if keep_all:
        nameless = docs.where("doc_id is null").select(*docs.columns, F.lit(None).cast(out.schema["marks"].dataType).alias("marks"))
        out = out.union(nameless)
    return out


def bases(batch: pa.RecordBatch) -> np.ndarray:
    """Where each row begins in its document."""
    return batch["base"].to_numpy() if "base" in batch.schema.names else np.zeros(batch.num_rows, dtype=np.int64)


def mark_arrays(batch: pa.RecordBatch, rows: slice, size: np.ndarray, scale: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a slice of rows of these sizes: row number, pos within the row and length of each mark that lies in the row.

    ``scale``: a place is told apart by so many positions.
    """
    part = batch["marks"].slice(rows.start, len(size))
    counts = pc.fill_null(pc.list_value_length(part), 0).to_numpy().astype(np.int64)
    flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row, pos, length = np.repeat(np.arange(len(size)), counts), flat >> 32, flat & 0xFFFFFFFF
    pos = pos - scale * bases(batch)[rows][row]
    own = (pos >= 0) & (pos < scale * size[row])
    return row[own], pos[own], length[own]


def spread(row: np.ndarray, pos: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and pos of every single place of the marks."""
    return np.repeat(row, length), ragged(pos, length)
