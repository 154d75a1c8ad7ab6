"""Benchmark passages in documents, under word edits.

An item is held where some run of words lies within the item's allowed edit
distance. Windows of as many words as the item has are looked at: one that starts
where such a run starts shares all but three 3-word grams an edit with the item
(an inserted word breaks two grams and pushes a third out of the window), so
windows with fewer are left out. The others and the items walk the CGK embedding:
a random walk over the words that repeats or advances by shared random bits, so
that edits become few differing coordinates. Samples of the coordinates are hash
keys, repeated until the target recall; where keys collide, the item is aligned
with the window and its surroundings by exact edit distance. Items too short for
an edit are looked up as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import table, texts
from ._text import BYTE_A, U64, WORD_A, Block, Words, blocks, cover, inside, lowered, mix, ragged, runs

#: Items of fewer words allow no edit: all their windows are looked up by hash and compared.
EDITED_WORDS = 6
#: Items and their bytes that are sent out at once; more go in further passes.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
#: Part of sampled coordinates that a pair at the allowed distance still shares, recall aimed at, coordinates a key.
AGREE, RECALL, SAMPLED = 0.4, 0.999, 2
_WINDOWS = 2048

_DROPPED = np.zeros(256, dtype=bool)
_DROPPED[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def repetitions(agree: float = AGREE, sampled: int = SAMPLED, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled))


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the documents, without ASCII punctuation and case, and their offsets."""
    keep = ~_DROPPED[block.data]
    at = np.concatenate([[0], np.cumsum(keep)])[block.at]
    words = Words(Block(lowered(block.data[keep]), at, block.rows))
    return words.hashes(BYTE_A), words.at


def _scores(a: list, b: list, anywhere: bool) -> Iterator[int]:
    """Edit distance of ``a`` to each beginning of ``b``, or to the nearest run that ends there, by bit-parallel columns."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        eq = where.get(x, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        hp, hn = down | (full & ~(across | up)), up & across
        score += bool(hp & top) - bool(hn & top)
        yield score
        hp, hn = (hp << 1 | (not anywhere)) & full, hn << 1 & full
        up, down = hn | (full & ~((eq | down) | hp)), hp & (eq | down)


def edit_distance(a: list, b: list, most: int) -> int:
    """Levenshtein distance of two sequences; most + 1 if it is above ``most``."""
    if not a:
        return min(len(b), most + 1)
    score = len(a)
    for j, score in enumerate(_scores(a, b, False)):
        if score - (len(b) - j - 1) > most:
            return most + 1
    return min(score, most + 1)


def best_run(a: list, b: list) -> tuple[int, int]:
    """Least edit distance of ``a`` to any run of ``b``, and the end of the first run of that distance."""
    best, end = len(a), 0
    for j, score in enumerate(_scores(a, b, True)):
        if score < best:
            best, end = score, j + 1
    return best, end


class Walks:
    """CGK walks of word sequences, sampled; the same bits for documents and items."""

    def __init__(self, repeats: int, sampled: int):
        rng = np.random.default_rng(707)
        self.repeats = repeats
        self.seed = rng.integers(0, 2**64, repeats, dtype=np.uint64)
        #: Sampled steps as parts of the first 2n; later ones mostly see the padding.
        self.part = rng.uniform(0, 2, (repeats, sampled))

    def keys(self, words: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Keys (sequences x repeats) of the sequences words[start : start + n]."""
        step = np.floor(self.part[None] * n[:, None, None]).astype(np.int64)
        out = np.repeat(self.seed[None], len(n), 0) + n[:, None].astype(np.uint64)
        seat = np.zeros(out.shape, dtype=np.int64)
        padded = np.append(words, U64(0))
        for j in range(int(step.max(initial=-1)) + 1):
            done = seat >= n[:, None]
            word = padded[np.where(done, len(words), start[:, None] + seat)]
            hit = (step == j).any(2)
            out = np.where(hit, mix(out ^ mix(word + U64(j))), out)
            bits = (word ^ self.seed) * U64(0x9E3779B97F4A7C15 + 2 * j)
            seat += ((bits >> U64(63)) != 0) & ~done
        return out


class Index:
    """Items of one block: their words, the grams of each length, and LSH keys."""

    def __init__(self, ids: list[int], items: list[str], tolerance: float):
        self.walks = Walks(repetitions(), SAMPLED)
        seqs, owner = [], []
        #: Items that allow no edit, by their number of words and their words.
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for block in blocks(pa.array(items, type=pa.string())):
            words, at = tokens(block)
            for i in range(len(block)):
                s, item = words[at[i] : at[i + 1]], ids[block.rows.start + i]
                if len(s) >= EDITED_WORDS:
                    seqs.append(s)
                    owner.append(item)
                elif len(s):
                    self.short.setdefault(len(s), {}).setdefault(s.tobytes(), []).append(item)
        self.short_keys = {n: np.unique(WORD_A.grams(np.frombuffer(b"".join(held), dtype=np.uint64), n)[::n]) for n, held in self.short.items()}
        self.owner = np.array(owner, dtype=np.int64)
        self.n = np.array([len(s) for s in seqs], dtype=np.int64)
        self.most = np.floor(tolerance * self.n + 1e-9).astype(np.int64)
        self.lists = [s.tolist() for s in seqs]
        if not seqs:
            return
        words = np.concatenate(seqs)
        start = np.cumsum(self.n) - self.n
        at = np.concatenate([start, [len(words)]])
        self.sizes, size = np.unique(self.n, return_inverse=True)
        self.allowed = np.floor(tolerance * self.sizes + 1e-9).astype(np.int64)
        self.need = np.maximum(self.sizes - 2 - 3 * self.allowed, 1)
        place = np.flatnonzero(inside(at, 3))
        gram = WORD_A.grams(words, 3)[place]
        pair = np.unique(np.stack([gram, size[np.repeat(np.arange(len(self.n)), self.n)[place]].astype(np.uint64)]), axis=1)
        #: Sorted grams, and for each the sizes (by number) of the items that hold it.
        self.gram, first = np.unique(pair[0], return_index=True)
        self.gram_at = np.append(first, pair.shape[1])
        self.gram_size = pair[1].astype(np.int64)
        keys = np.concatenate([self.walks.keys(words, start[a : a + _WINDOWS], self.n[a : a + _WINDOWS]) for a in range(0, len(start), _WINDOWS)])
        flat = keys.ravel()
        order = np.argsort(flat, kind="stable")
        self.key, self.key_item = flat[order], order // keys.shape[1]

    def candidates(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (start, size number) with grams enough, in documents laid end to end."""
        none = np.zeros(0, dtype=np.int64)
        place = np.flatnonzero(inside(at, 3))
        if not len(self.n) or not len(place):
            return none, none
        gram = WORD_A.grams(words, 3)[place]
        slot = np.searchsorted(self.gram, gram)
        hit = slot < len(self.gram)
        hit[hit] = self.gram[slot[hit]] == gram[hit]
        place, slot = place[hit], slot[hit]
        many = self.gram_at[slot + 1] - self.gram_at[slot]
        size = self.gram_size[ragged(self.gram_at[slot], many)]
        place = np.repeat(place, many)
        order = np.lexsort((place, size))
        size, place = size[order], place[order]
        doc = np.searchsorted(at, place, "right") - 1
        starts, sizes = [], []
        for k in np.unique(size).tolist():
            a, b = np.searchsorted(size, k), np.searchsorted(size, k, "right")
            p, d, need, n = place[a:b], doc[a:b], int(self.need[k]), int(self.sizes[k])
            if len(p) < need:
                continue
            first, last = p[: len(p) - need + 1], p[need - 1 :]
            ok = (d[: len(p) - need + 1] == d[need - 1 :]) & (last - first <= n - 3)
            lo = np.maximum(last[ok] - (n - 3), at[d[need - 1 :][ok]])
            hi = np.minimum(first[ok], at[d[need - 1 :][ok] + 1] - n)
            real = lo <= hi
            if not real.any():
                continue
            base = int(lo[real].min())
            x, y = runs(cover(int(hi[real].max()) - base + 1, lo[real] - base, hi[real] - base + 1))
            s = ragged(x + base, y - x)
            # runs of neighbouring documents may touch: a window must lie in one
            own = np.searchsorted(at, s, "right") - 1
            s = s[s + n <= at[own + 1]]
            starts.append(s)
            sizes.append(np.full(len(s), k))
        if not starts:
            return none, none
        return np.concatenate(starts), np.concatenate(sizes)

    def exact(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, start, 0) of the short items, where their words stand."""
        for n, held in self.short.items():
            place = np.flatnonzero(inside(at, n))
            for s in place[np.isin(WORD_A.grams(words, n)[place], self.short_keys[n])].tolist():
                d = int(np.searchsorted(at, s, "right")) - 1
                for item in held.get(words[s : s + n].tobytes(), ()):
                    yield d, item, int(s - at[d]), 0

    def padded(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents shorter than an item that they may hold are drawn out by words that nothing has."""
        n = np.diff(at)
        if not len(self.n):
            return words, at
        more = np.where((n >= (self.sizes - self.allowed).min()) & (n < self.sizes.max()), self.allowed.max(), 0)
        return np.insert(words, np.repeat(at[1:], more), U64(1)), at + np.concatenate([[0], np.cumsum(more)])

    def matches(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, start, distance) of verified places; windows that overlap are verified as one."""
        yield from self.exact(words, at)
        words, at = self.padded(words, at)
        start, size = self.candidates(words, at)
        found = [np.zeros((2, 0), dtype=np.int64)]
        for a in range(0, len(start), _WINDOWS):
            s, n = start[a : a + _WINDOWS], self.sizes[size[a : a + _WINDOWS]]
            keys = self.walks.keys(words, s, n).ravel()
            lo, hi = np.searchsorted(self.key, keys), np.searchsorted(self.key, keys, "right")
            window = np.repeat(np.repeat(np.arange(len(s)), self.walks.repeats), hi - lo)
            item = self.key_item[ragged(lo, hi - lo)]
            met = self.n[item] == n[window]
            found.append(np.unique(np.stack([item[met], s[window[met]]]), axis=1))
        item, s = np.unique(np.concatenate(found, axis=1), axis=1)
        if not len(s):
            return
        d = np.searchsorted(at, s, "right") - 1
        new = np.ones(len(s), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (d[1:] != d[:-1]) | (s[1:] - s[:-1] > self.n[item[1:]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1
        seen: dict = {}
        for i, doc, a, b in zip(item[first].tolist(), d[first].tolist(), s[first].tolist(), s[last].tolist(), strict=True):
            n, most = int(self.n[i]), int(self.most[i])
            a, b = max(a - most, int(at[doc])), min(b + n + most, int(at[doc + 1]))
            own = words[a:b]
            k = (own.tobytes(), i)
            if k not in seen:
                seen[k] = best_run(self.lists[i], own.tolist())
            distance, end = seen[k]
            if distance <= most:
                yield doc, int(self.owner[i]), max(a + end - n - int(at[doc]), 0), distance


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                words, at = tokens(block)
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for d, item, s, distance in index.matches(words, at):
                    best[d, item] = min(best.get((d, item), (distance, s)), (distance, s))
                if best:
                    yield table("doc_id:l,item_id:l,distance:l,start:l", doc_id=[ids[block.rows][d] for d, _ in best], item_id=[i for _, i in best], distance=[x for x, _ in best.values()], start=[s for _, s in best.values()])

    return run


def _texts_without(index: Index, column: int):
    """Rows whose text holds no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for block in blocks(batch.column(column).cast(pa.string())):
                words, at = tokens(block)
                for d, *_ in index.matches(words, at):
                    clean[block.rows.start + d] = False
            yield batch.filter(pa.array(clean))

    return run


def _indexes(benchmark: DataFrame, tolerance: float) -> Iterator[Index]:
    """The items in blocks of bounded size, each to be sent out by itself."""
    if not 0 <= tolerance <= 0.2:
        raise ValueError("tolerance must lie in 0..0.2: beyond, windows need not share a gram")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).where("item_id is not null and item is not null")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()
    passes = max(math.ceil(n / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES), 1)
    for i in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(passes)) == i).orderBy("item_id", "item").collect()
        yield Index([r.item_id for r in rows], [r.item for r in rows], tolerance)


def find(documents: DataFrame, benchmark: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """(doc_id, item_id, distance, start): each item that a document holds, at its best window.

    Words are compared without case (A-Z) and ASCII punctuation. An item is held
    if some run of words has a word edit distance to it of at most ``tolerance``
    times its words; items of one to five words must occur as they are.
    ``distance`` is that of the best run, and ``start`` the first word of the item-sized
    window that ends with it (the first such run; 0 if the window would begin before the text). Null texts and null ids are not
    looked for or into, nor are items without words. Rows that repeat a doc_id or
    an item_id give one row, of the least (distance, start). Empty tables give no
    rows.
    """
    docs = texts(documents).where("doc_id is not null and text is not null")
    out = None
    for index in _indexes(benchmark, tolerance):
        found = docs.mapInArrow(_scan(index), "doc_id long, item_id long, distance long, start long")
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start")).alias("m")).select("doc_id", "item_id", "m.distance", "m.start")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """The rows whose text holds no item; columns stay as they are.

    Rows are judged where they are read, each by its own text: repeated and null
    doc_ids change nothing, null and empty texts hold nothing and stay.
    """
    out = documents
    for index in _indexes(benchmark, tolerance):
        out = out.mapInArrow(_texts_without(index, documents.columns.index("text")), documents.schema)
    return out
