"""Repeated word windows by level-wise doubling.

The target window has ``window`` words. Level 1 looks at quarter windows, and of
those only at the least-hashed one of each target window (a winnowed choice that
depends on the words alone, so equal windows choose equal places). Quarters that
occur once drop out; what is left is extended to half windows, to the right and
to the left, and counted again; halves that occur twice or more let their target
windows in, which are judged by 96 bits of hash and exact order of place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._repeats import FIRST_WIDTHS, MANY_WIDTHS, PACKED, Exchange, Thinned, based, bases, bucket_ids, exchanged, mark_arrays, marked, many, not_first, spread
from ._spark import table
from ._text import BYTE_B, WORD_A, WORD_B, Block, Words, blocks, cover, inside, window_minima


def _anchors(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Target window starts, the anchor place of each, and the hashes of all quarter windows."""
    quarter = window // 4
    grams = WORD_A.grams(hashes, quarter)
    start = np.flatnonzero(inside(words.at, window))
    if not len(start):
        return start, start, grams
    return start, window_minima(grams, window - quarter + 1)[start], grams


def _quarters(window: int, buckets: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Thinned(Exchange(buckets, MANY_WIDTHS), first=False)
        for batch in batches:
            ids, base = batch.column(0).to_numpy(zero_copy_only=False), bases(batch)
            for block in blocks(batch.column(1)):
                words = Words(block)
                _, anchor, grams = _anchors(words, words.hashes(), window)
                place = np.unique(anchor)
                doc = words.doc()[place]
                yield from out.add(grams[place], np.zeros(len(place), np.uint64), ids[block.rows][doc], place - words.at[doc] + base[block.rows][doc])
        yield from out.flush()

    return run


def _lift(batch: pa.RecordBatch, block: Block, words: Words) -> np.ndarray:
    """Which word places of the block are marked."""
    row, pos = spread(*mark_arrays(batch, block.rows, np.diff(words.at)))
    place = words.at[row] + pos
    out = np.zeros(len(words), dtype=bool)
    out[place[place < words.at[row + 1]]] = True
    return out


def _halves(window: int, buckets: list[int]):
    half, quarter = window // 2, window // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Thinned(Exchange(buckets, MANY_WIDTHS), first=False)
        for batch in batches:
            ids, base = batch.column(0).to_numpy(), bases(batch)
            for block in blocks(batch.column(1)):
                words = Words(block)
                grams = WORD_B.grams(words.hashes(), half)
                anchor = np.flatnonzero(_lift(batch, block, words))
                doc = words.doc()[anchor]
                own = anchor - words.at[doc] + base[block.rows][doc]
                # a half window at its own place p goes by 2p if it runs right from the anchor, by 2p + 1 if left
                for start, side in ((anchor, 0), (anchor - (half - quarter), 1)):
                    ok = (start >= words.at[doc]) & (start + half <= words.at[doc + 1])
                    yield from out.add(grams[start[ok]], np.zeros(int(ok.sum()), np.uint64), ids[block.rows][doc[ok]], 2 * own[ok] + side)
        yield from out.flush()

    return run


def _wholes(window: int, buckets: list[int]):
    half = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Thinned(Exchange(buckets, FIRST_WIDTHS), first=True)
        for batch in batches:
            ids, base = batch.column(0).to_numpy(), bases(batch)
            for block in blocks(batch.column(1)):
                words = Words(block)
                hashes = words.hashes()
                start, anchor, _ = _anchors(words, hashes, window)
                row, pos = spread(*mark_arrays(batch, block.rows, np.diff(words.at), 2))
                alive = np.zeros((2, len(words) + 1), dtype=bool)
                place = words.at[row] + pos // 2
                ok = place < words.at[row + 1]
                alive[pos[ok] % 2, place[ok]] = True
                keep = np.where(anchor - start <= half, alive[0, anchor], alive[1, anchor])
                start = start[keep]
                doc = words.doc()[start]
                h, g = WORD_A.grams(hashes, window), WORD_B.grams(words.hashes(BYTE_B), window)
                yield from out.add(h[start], g[start], ids[block.rows][doc], start - words.at[doc] + base[block.rows][doc])
        yield from out.flush()

    return run


def _cut(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = Words(block)
                row, pos, length = mark_arrays(batch, block.rows, np.diff(words.at))
                begin = words.at[row] + pos
                end = np.minimum(begin + length - 1 + window, words.at[row + 1])
                ok = begin < end
                gone = cover(len(words), begin[ok], end[ok])
                kept = np.flatnonzero(~gone)
                doc = words.doc()
                removed = np.bincount(doc[gone], minlength=len(block))
                # each kept word takes the byte after it along as its space, but for a document's last
                last = np.ones(len(kept), dtype=bool)
                last[:-1] = doc[kept][1:] != doc[kept][:-1]
                size = words.end[kept] - words.start[kept] + ~last
                data = block.data.copy()
                data[words.end[kept[~last]]] = 0x20
                data = data[cover(len(data), words.start[kept], words.start[kept] + size)]
                per = np.bincount(doc[kept], weights=size, minlength=len(block)).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(per)])
                view = memoryview(data.tobytes())
                parts = [view[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out = table("n_words:l,n_removed:l,kept_sha256:s", n_words=np.diff(words.at), n_removed=removed, kept_sha256=[hashlib.sha256(x).hexdigest() for x in parts])
                ids = batch.column(0).slice(block.rows.start, len(block))
                columns, names = [ids, *out.columns], ["doc_id", *out.schema.names]
                if keep_text:
                    columns.append(pa.array([str(x, "utf-8") for x in parts]))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_windows(documents: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, mark): runs of word windows that also start earlier; a mark is first word * 2**32 + windows.

    Earlier means a smaller doc_id, or the same document and an earlier start.
    ``window`` is a multiple of 4. Of doc_ids whose rows differ, first words count from ``based``.
    """
    return _repeated_windows(based(documents), window)


def _repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    if window < 4 or window % 4:
        raise ValueError("window must be a multiple of 4")
    known = docs.where("doc_id is not null")
    buckets = bucket_ids(docs.sparkSession)
    n = len(buckets)
    quarters = exchanged(known.mapInArrow(_quarters(window, buckets), PACKED), n, many, MANY_WIDTHS)
    halves = exchanged(marked(docs, quarters).mapInArrow(_halves(window, buckets), PACKED), n, many, MANY_WIDTHS)
    return exchanged(marked(docs, halves).mapInArrow(_wholes(window, buckets), PACKED), n, not_first, FIRST_WIDTHS)


def drop_repeated_windows(documents: DataFrame, window: int = 20, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every row.

    A word goes if a window over it also starts earlier; windows are judged on
    the input. Kept words are joined by one space. Null texts have no words. Rows
    whose doc_id is null lose nothing and are no one's earlier copy; rows that
    repeat a doc_id are one document, laid end to end (in the order of a hash of their
    texts), and a row that comes twice is no copy of itself. No rows in, none out.
    """
    docs = based(documents)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return marked(docs, _repeated_windows(docs, window), keep_all=True).mapInArrow(_cut(window, keep_text), schema)


#: DuckDB form of op3's rows with windows of 20 words; {documents} names the table.
SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM {documents}
), windows AS (
  SELECT doc_id, start, array_to_string(list_slice(words, start, start + 19), ' ') AS key
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM texts WHERE len(words) >= 20)
), later AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY key ORDER BY doc_id, start) AS place FROM windows) WHERE place > 1
), gone AS (
  SELECT DISTINCT doc_id, start + step AS pos FROM later, range(20) AS r(step)
), words AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts
), kept AS (
  SELECT w.doc_id, count(g.pos) AS n_removed, string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY w.doc_id
)
SELECT t.doc_id, CAST(len(t.words) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
