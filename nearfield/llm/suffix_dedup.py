"""Repeated byte strings across documents by longest previous factors.

In the order of all suffixes, the longest match of a suffix with an earlier document
is found at one of two neighbours: the nearest one before it and the nearest one
after it that belong to a smaller document. Their common prefixes with it, the
least of the common prefixes between neighbours on the way, give its longest
previous factor; a factor of ``length`` bytes or more is a repeat, and what such
factors cover goes, so that the first copy stays.

One suffix array over a corpus does not fit a machine, so suffixes are dealt out:
each string of ``length`` bytes belongs to its least-hashed 16-gram (its anchor),
and equal strings have equal anchors. Anchors that occur in one document drop
out. Of the others, each document sends the hash of the bytes that hold the
anchor's strings, its fragment: a fragment that an earlier document has whole goes
whole. Fragments of one anchor that differ meet in one task, which sorts the
suffixes of many anchors at once, up to ``length`` bytes. An anchor of more than
``most_fragments`` different fragments never meets as a whole: its strings go on
one by one before the exchange, under 96 bits of hash, thinned in the sending task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import AGAIN, FIRST_WIDTHS, KNOWN, PACKED, PLACES, Columns, Exchange, based, bases, beyond_first, bucket_ids, exchanged, fresh, mark_arrays, marked, merged, not_first_doc, places, receive
from ._spark import grouped, table
from ._text import BYTE_A, BYTE_B, U64, Block, blocks, cover, inside, ragged, runs, signed, window_minima

ANCHOR = 16
#: Fragments of one anchor that meet in one task.
MOST_FRAGMENTS = 1 << 13
#: In a count: the document has the fragment's anchor, or content, elsewhere too (bit 31 in marks, bit 15 in packed rows);
#: the strings of the fragment go on one by one (marks only).
_TWIN, _TWIN_PACKED, _APART = 1 << 31, 1 << 15, 1 << 30
_COUNT = _APART - 1


def sorted_suffixes(data: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse suffix array: the order of the suffixes at ``start``, each of ``depth`` bytes or more.

    They are compared up to ``depth`` bytes, eight at a time. The second array has the
    length of the common prefix of each with the one before (0 for the first).
    """
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(data) + 1, dtype=np.uint64)
    for i in range(8):
        eight |= padded[i : i + len(data) + 1] << U64(56 - 8 * i)
    words = [eight[start + i] for i in range(0, depth - depth % 8, 8)]
    if depth % 8:
        words.append(eight[start + depth - depth % 8] >> U64(64 - 8 * (depth % 8)) << U64(64 - 8 * (depth % 8)))
    order = np.lexsort(words[::-1])
    common = np.full(len(start), depth, dtype=np.int64)
    open_ = np.arange(1, len(start))
    for i, w in enumerate(words):
        x = w[order[open_]] ^ w[order[open_ - 1]]
        differs = x != 0
        at, x = open_[differs], x[differs]
        common[at] = 8 * i + sum((x < U64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
        open_ = open_[~differs]
    common[:1] = 0
    return order, common


def _nearest_smaller(doc: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest one before it of a smaller document, and the common prefix with it.

    All entries jump at once: what lies between an entry and where it points is of
    no smaller document, so it may take over the pointer of the entry it points at.
    Entries whose common prefix falls below ``least`` stop; their pointers count for nothing.
    """
    to, prefix = np.arange(len(doc)) - 1, common.copy()
    open_ = np.flatnonzero(prefix >= max(least, 1))
    while len(open_):
        open_ = open_[doc[to[open_]] >= doc[open_]]
        at = to[open_]
        prefix[open_], to[open_] = np.minimum(prefix[open_], prefix[at]), to[at]
        open_ = open_[(prefix[open_] >= max(least, 1)) & (to[open_] >= 0)]
    return to, prefix


def longest_previous_factors(doc: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """Of suffixes in order, the longest common prefix with one of a smaller document; factors below ``least`` may read 0.

    ``common`` has the common prefix of each with the one before.
    """
    n = len(doc)
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    after = np.append(common[1:], 0)[::-1]
    for flip, (d, c) in enumerate(((doc, common), (doc[::-1], after))):
        to, prefix = _nearest_smaller(d, c, least)
        found = np.where((to >= 0) & (prefix >= least) & (d[np.maximum(to, 0)] < d), prefix, 0)
        out = np.maximum(out, found[::-1] if flip else found)
    return out


class _Strings:
    """The strings of ``length`` bytes in a block and their anchors."""

    def __init__(self, block: Block, length: int):
        self.grams = BYTE_A.grams(block.data, ANCHOR)
        self.start = np.flatnonzero(inside(block.at, length))
        anchor = window_minima(self.grams, length - ANCHOR + 1)[self.start] if len(self.start) else self.start
        new = np.ones(len(self.start), dtype=bool)
        doc = np.searchsorted(block.at, self.start, "right") - 1
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        #: One entry a fragment: strings begin..begin+count-1, their document and anchor hash.
        self.begin, self.count = self.start[first], np.diff(np.append(first, len(self.start)))
        self.doc, self.key = doc[first], self.grams[anchor[first]]

    def once(self, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each fragment the first one of its key within its document, and whether there are others."""
        order = np.lexsort((self.begin, *keys, self.doc))
        new = fresh(self.doc[order], *(k[order] for k in keys))
        group = np.cumsum(new) - 1
        lead, many = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=bool)
        lead[order] = order[np.flatnonzero(new)][group]
        many[order] = np.bincount(group)[group] > 1 if len(group) else many
        return lead, many


def _anchor_keys(data: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """Hash of the anchor of the string at each place."""
    out = np.empty(len(begin), dtype=np.uint64)
    sums = BYTE_A.sums(data)
    step = np.arange(length - ANCHOR + 1)
    for a in range(0, len(begin), 1 << 14):
        at = begin[a : a + (1 << 14), None] + step
        grams = BYTE_A.spans(sums, at, at + ANCHOR)
        # as window_minima chooses: by the high bits, the leftmost of equals
        best = np.argmin(grams >> U64(30), axis=1)
        out[a : a + (1 << 14)] = grams[np.arange(len(at)), best]
    return out


def _part(block: Block, rows: np.ndarray) -> tuple[Block, np.ndarray]:
    """Some documents of a block, and their bytes' places in it."""
    size = np.diff(block.at)[rows]
    place = ragged(block.at[rows], size)
    return Block(block.data[place], np.concatenate([[0], np.cumsum(size)]), block.rows), place


#: anchor, doc, first string, strings
_ANCHOR_WIDTHS = (5, -8, 4, 2)


def _send_anchors(out: Exchange, held: list[Columns]) -> Iterator[pa.RecordBatch]:
    """One row an anchor; the rows of those that come more than once are known to be alive."""
    if not held:
        return
    key, doc, pos, count = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key, kind="stable")
    new = fresh(key[order])
    lead = np.sort(order[new])
    yield from out.keyed(key[lead], tuple(c[lead] for c in (key, doc, pos, count)))
    group = np.cumsum(new) - 1
    rest = np.sort(order[np.bincount(group)[group] > 1]) if len(group) else order
    yield from out.known(doc[rest], pos[rest], _unpacked(count[rest]))


def _unpacked(count: np.ndarray) -> np.ndarray:
    count = count.astype(np.int64)
    return np.where(count & _TWIN_PACKED, (count & (_TWIN_PACKED - 1)) | _TWIN, count)


def _anchors(length: int, buckets: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, rows = Exchange(buckets, _ANCHOR_WIDTHS), [], 0
        for batch in batches:
            ids, base = batch.column(0).to_numpy(), bases(batch)
            for block in blocks(batch.column(1)):
                s = _Strings(block, length)
                lead, many = s.once(s.key)
                at = np.flatnonzero(lead == np.arange(len(lead)))
                own = s.doc[at]
                held.append((s.key[at], ids[block.rows][own], s.begin[at] - block.at[own] + base[block.rows][own], s.count[at] + many[at] * _TWIN_PACKED))
                rows += len(at)
                if rows >= 1 << 19:
                    yield from _send_anchors(out, held)
                    held, rows = [], 0
        yield from _send_anchors(out, held)

    return run


def _alive(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Fragments whose anchor comes more than once."""
    order = np.argsort(key, kind="stable")
    group = np.cumsum(fresh(key[order])) - 1
    rest = np.sort(order[np.bincount(group)[group] > 1]) if len(group) else order
    yield places(doc[rest].view(np.int64), pos[rest].view(np.int64), _unpacked(count[rest]))


#: anchor, fragment hashes, doc, first string, strings
_CONTENT_WIDTHS = (5, 8, 4, -8, 4, 2)


def _fragments_of(block: Block, batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first string and number of strings of the marked fragments, with the others of their anchors; and whether a document may hold one twice."""
    row, pos, count = mark_arrays(batch, block.rows, np.diff(block.at))
    begin, index = np.unique(block.at[row] + pos, return_index=True)
    row, count = row[index], count[index]
    twin = (count & _TWIN) != 0
    count = count & _COUNT
    twins = np.unique(row[twin])
    if not len(twins):
        return row, begin, count, twin
    # documents that have an anchor in several places are cut anew
    own, place = _part(block, twins)
    s = _Strings(own, length)
    lead, _ = s.once(s.key)
    at = np.flatnonzero(np.isin(place[s.begin[lead]], begin)) if len(lead) else lead
    rest = ~np.isin(row, twins)
    return (
        np.concatenate([row[rest], twins[s.doc[at]]]),
        np.concatenate([begin[rest], place[s.begin[at]]]),
        np.concatenate([count[rest], s.count[at]]),
        np.concatenate([twin[rest], np.ones(len(at), dtype=bool)]),
    )


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_A.spans(BYTE_A.sums(data), begin, end) ^ count.astype(np.uint64), BYTE_B.spans(BYTE_B.sums(data), begin, end)


def _contents(length: int, buckets: list[int]):
    """Hashes of the fragments of surviving anchors; those seen before in the task are known repeats."""

    def flush(out: Exchange, held: list[Columns]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        anchor, h, g, doc, pos, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((pos, doc, g, h))
        later = beyond_first(fresh(h[order], g[order]), doc[order])
        # the first document's rows stay, but a row that comes twice counts once
        lead, rest = np.sort(order[~later & fresh(h[order], g[order], doc[order], pos[order])]), np.sort(order[later])
        yield from out.keyed(anchor[lead], tuple(c[lead] for c in (anchor, h, g, doc, pos, count)))
        yield from out.known(doc[rest], pos[rest], _unpacked(count[rest]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, rows = Exchange(buckets, _CONTENT_WIDTHS), [], 0
        for batch in batches:
            ids, base = batch.column(0).to_numpy(), bases(batch)
            for block in blocks(batch.column(1)):
                row, begin, count, twin = _fragments_of(block, batch, length)
                if not len(row):
                    continue
                h, g = _hashes(block.data, begin, begin + count + length - 1, count)
                again = np.flatnonzero(twin)
                keep, more = np.ones(len(row), dtype=bool), np.zeros(len(row), dtype=bool)
                if len(again):
                    # of one content in one document only the first is sent
                    order = again[np.lexsort((begin[again], g[again], h[again], row[again]))]
                    new = fresh(row[order], h[order], g[order])
                    keep[order[~new]] = False
                    group = np.cumsum(new) - 1
                    more[order] = np.bincount(group)[group] > 1
                at = np.flatnonzero(keep)
                own = row[at]
                held.append((_anchor_keys(block.data, begin[at], length), h[at], g[at], ids[block.rows][own], begin[at] - block.at[own] + base[block.rows][own], count[at] + more[at] * _TWIN_PACKED))
                rows += len(at)
                if rows >= 1 << 18:
                    yield from flush(out, held)
                    held, rows = [], 0
        yield from flush(out, held)

    return run


def _compare(most: int):
    """Fragments that an earlier document has whole are known; those of anchors of different contents are looked at again."""

    def judge(anchor: np.ndarray, h: np.ndarray, g: np.ndarray, doc: np.ndarray, pos: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, pos, count = doc.view(np.int64), pos.view(np.int64), _unpacked(count)
        order = np.lexsort((pos, doc, g, h, anchor))
        new = fresh(anchor[order], h[order], g[order])
        later = beyond_first(new, doc[order])
        rest = order[later]
        yield places(doc[rest], pos[rest], count[rest], KNOWN)
        lead = order[~later & fresh(anchor[order], h[order], g[order], doc[order], pos[order])]
        if not len(lead):
            return
        group = np.cumsum(fresh(anchor[lead])) - 1
        contents = np.bincount(group, fresh(anchor[lead], h[lead], g[lead]))[group]
        held = np.bincount(group)[group]
        again = lead[contents > 1]
        apart = np.where(held[contents > 1] > most, _APART, 0)
        yield places(doc[again], pos[again], count[again] | apart, AGAIN)

    return judge


FRAGMENT = PACKED + ", anchor long, doc_id long, pos long, len long"


def _fragments(length: int, buckets: list[int]):
    """The fragments to look at again: their bytes, or, of anchors of too many, packed rows of their strings."""
    to = np.array(buckets)

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        n, fill = rows.num_rows, {f: pa.nulls(rows.num_rows, pa.int64()) for f in ("anchor", "doc_id", "pos", "len")}
        return pa.RecordBatch.from_arrays([*rows.columns, *fill.values()], names=[*rows.schema.names, *fill]) if n else rows

    def flush(out: Exchange, held: list[Columns]) -> Iterator[pa.RecordBatch]:
        """Of each string the rows of the least document in the task go on, the others are known repeats."""
        if not held:
            return
        h, g, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((pos, doc, g, h))
        later = beyond_first(fresh(h[order], g[order]), doc[order])
        lead, rest = np.sort(order[~later & fresh(h[order], g[order], doc[order], pos[order])]), order[later]
        yield from map(whole, out.keyed(h[lead], tuple(c[lead] for c in (h, g, doc, pos))))
        yield from map(whole, out.known(*merged(doc[rest], pos[rest], np.ones(len(rest), dtype=np.int64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, rows = Exchange(buckets, FIRST_WIDTHS), [], 0
        for batch in batches:
            ids, base = batch.column(0).to_numpy(), bases(batch)
            for block in blocks(batch.column(1)):
                row, pos, count = mark_arrays(batch, block.rows, np.diff(block.at))
                begin, apart = block.at[row] + pos, (count & _APART) != 0
                doc, place = ids[block.rows][row], pos + base[block.rows][row]
                if apart.any():
                    of = np.repeat(np.flatnonzero(apart), count[apart] & _COUNT)
                    at = ragged(begin[apart], count[apart] & _COUNT)
                    h, g = _hashes(block.data, at, at + length, np.zeros(len(at)))
                    held.append((h, g, doc[of], place[of] + at - begin[of]))
                    rows += len(at)
                    # that a document has a fragment twice is told by an empty mark
                    twin = np.flatnonzero(apart & ((count & _TWIN) != 0))
                    yield from map(whole, out.known(doc[twin], place[twin], np.full(len(twin), _TWIN)))
                    if rows >= 1 << 19:
                        yield from flush(out, held)
                        held, rows = [], 0
                k = np.flatnonzero(~apart)
                if len(k):
                    size = (count[k] & _COUNT) + length - 1
                    packed = block.data[ragged(begin[k], size)]
                    offsets = np.concatenate([[0], np.cumsum(size)])
                    part = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
                    key = _anchor_keys(packed, offsets[:-1], length)
                    sent = table("bucket:i,sub:i,kind:i,anchor:l,doc_id:l,pos:l,len:l", bucket=to[(key >> U64(40)).astype(np.int64) % len(to)], sub=np.zeros(len(k)), kind=np.full(len(k), AGAIN), anchor=signed(key), doc_id=doc[k], pos=place[k], len=count[k])
                    yield pa.RecordBatch.from_arrays([*sent.columns[:3], part, *sent.columns[3:]], names=["bucket", "sub", "kind", "data", "anchor", "doc_id", "pos", "len"])
        yield from flush(out, held)

    return run


def _judge(length: int):
    """Longest previous factors over whole groups of fragments, and the later documents of packed strings, which come first."""

    def front(batches: Iterator[pa.RecordBatch], rest: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = int(np.searchsorted(batch["kind"].to_numpy(), AGAIN))
            if n:
                yield batch.slice(0, n)
            if n < batch.num_rows:
                rest.append(batch.slice(n))
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        yield from receive(not_first_doc, FIRST_WIDTHS)(front(batches, rest))
        for part in grouped(chain(rest, batches), ["anchor"], 1 << 20):
            doc, pos, count = (part[k].combine_chunks().to_numpy() for k in ("doc_id", "pos", "len"))
            twin, count = count & _TWIN, count & _COUNT
            block = next(blocks(part["data"], 1 << 62))
            start = ragged(block.at[:-1], count)
            owner = np.repeat(np.arange(len(doc)), count)
            order, common = sorted_suffixes(block.data, start, length)
            gone = np.zeros(len(start), dtype=bool)
            gone[order] = longest_previous_factors(doc[owner[order]], common, length) >= length
            a, b = runs(gone)
            # a run must not pass from one fragment to the next
            cut = np.flatnonzero(gone[1:] & gone[:-1] & (owner[1:] != owner[:-1])) + 1
            a, b = np.sort(np.concatenate([a, cut])), np.sort(np.concatenate([b, cut]))
            own = owner[a]
            yield places(doc[own], pos[own] + start[a] - block.at[own], (b - a) | twin[own])

    return run


def _cut(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                row, pos, count = mark_arrays(batch, block.rows, np.diff(block.at))
                n = len(block.data)
                if len(row):
                    twins, count = np.unique(row[(count & _TWIN) != 0]), count & _COUNT
                    begin = block.at[row] + pos
                    string = cover(n, begin, np.minimum(begin + count, block.at[row + 1]))
                    if len(twins):
                        # fragments of one content in one document share one fate
                        own, place = _part(block, twins)
                        s = _Strings(own, length)
                        lead, _ = s.once(*_hashes(own.data, s.begin, s.begin + s.count + length - 1, s.count))
                        twin = np.flatnonzero(lead != np.arange(len(lead)))
                        string[place[ragged(s.begin[twin], s.count[twin])]] = string[place[ragged(s.begin[lead[twin]], s.count[twin])]]
                    a, b = runs(string)
                    cut = block.at[1:-1]
                    cut = cut[(cut > 0) & (cut < n)]
                    cut = np.unique(cut[string[cut] & string[cut - 1]])
                    a, b = np.sort(np.concatenate([a, cut])), np.sort(np.concatenate([b, cut]))
                    gone = cover(n, a, b + length - 1)
                else:
                    gone = np.zeros(n, dtype=bool)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[block.at[1:]] - total[block.at[:-1]]
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                edge = block.at[:-1]
                edge = edge[edge < n]
                opens[edge] = gone[edge]
                spans = np.concatenate([[0], np.cumsum(opens)])
                kept = block.data[~gone]
                at = block.at - total[block.at]
                view = memoryview(kept.tobytes())
                parts = [view[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out = table("n_bytes:l,n_removed:l,n_spans:l,kept_sha256:s", n_bytes=np.diff(block.at), n_removed=removed, n_spans=spans[block.at[1:]] - spans[block.at[:-1]], kept_sha256=[hashlib.sha256(x).hexdigest() for x in parts])
                columns, names = [batch.column(0).slice(block.rows.start, len(block)), *out.columns], ["doc_id", *out.schema.names]
                if keep_text:
                    columns.append(pa.array([bytes(x) for x in parts], type=pa.binary()))
                    names.append("kept_bytes")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_strings(docs: DataFrame, length: int = 50, most_fragments: int = MOST_FRAGMENTS) -> DataFrame:
    """(doc_id, mark, kind) of ``based`` documents: runs of strings that also start in a document with a smaller doc_id.

    A mark is first byte * 2**32 + strings, with bit 31 set where the document holds
    the fragment elsewhere too: of fragments of one content only the first is listed.
    """
    if not 2 * ANCHOR <= length < _TWIN_PACKED:
        raise ValueError(f"length must be {2 * ANCHOR} or more, and less than {_TWIN_PACKED}")
    known = docs.where("doc_id is not null")
    buckets = bucket_ids(docs.sparkSession)
    n = len(buckets)
    anchors = exchanged(known.mapInArrow(_anchors(length, buckets), PACKED), n, _alive, _ANCHOR_WIDTHS)
    contents = exchanged(marked(docs, anchors).mapInArrow(_contents(length, buckets), PACKED), n, _compare(most_fragments), _CONTENT_WIDTHS)
    met = marked(docs, contents.where(F.col("kind") == AGAIN)).mapInArrow(_fragments(length, buckets), FRAGMENT)
    judged = met.repartition(n, "bucket").sortWithinPartitions("kind", "sub", "anchor").mapInArrow(_judge(length), PLACES)
    return contents.where(F.col("kind") == KNOWN).union(judged)


def drop_repeated_strings(documents: DataFrame, length: int = 50, keep_text: bool = False, most_fragments: int = MOST_FRAGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_bytes]) of every row.

    A byte of a UTF-8 text goes if a ``length``-byte string over it also starts in
    a document with a smaller doc_id; strings are judged on the input and never
    cross documents or rows. Null texts are empty. Rows whose doc_id is null lose nothing
    and are no one's earlier copy; rows that repeat a doc_id are one document, each
    judged by its own text. No rows in, none out.
    """
    docs = based(documents)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if keep_text else "")
    return marked(docs, repeated_strings(docs, length, most_fragments), keep_all=True).mapInArrow(_cut(length, keep_text), schema)


#: DuckDB form of op2's rows with strings of 50 bytes; {documents} names the table. Bytes are pairs of hexadecimal digits.
SQL = r"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM {documents}
), strings AS (
  SELECT doc_id, start, substr(digits, 2 * start - 1, 100) AS string
  FROM (SELECT doc_id, digits, unnest(range(1, n_bytes - 48)) AS start FROM texts WHERE n_bytes >= 50)
), later AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, min(doc_id) OVER (PARTITION BY string) AS least FROM strings) WHERE doc_id > least
), bytes AS (
  SELECT doc_id, pos, substr(digits, 2 * pos - 1, 2) AS byte FROM (SELECT doc_id, digits, unnest(range(1, n_bytes + 1)) AS pos FROM texts)
), flagged AS (
  SELECT b.doc_id, b.pos, b.byte, coalesce(b.pos - max(l.start) OVER (PARTITION BY b.doc_id ORDER BY b.pos ROWS UNBOUNDED PRECEDING) < 50, false) AS gone
  FROM bytes b LEFT JOIN later l ON l.doc_id = b.doc_id AND l.start = b.pos
), opened AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM flagged
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (WHERE NOT gone) AS digits
  FROM opened GROUP BY doc_id
)
SELECT t.doc_id, t.n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.digits, ''))) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
