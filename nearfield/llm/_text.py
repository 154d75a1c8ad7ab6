"""Vectorised text primitives shared by the Arrow stages of the operators.

Every function works on a *block*: the UTF-8 bytes of several documents laid
end to end, with their offsets. Blocks are cut from Arrow batches by bytes, so
the memory of a task depends on the longest single text and not on how many
rows a batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20
#: Whitespace of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _rolling(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 2**64, 256, dtype=np.uint64)
    base = int(rng.integers(0, 2**61)) * 8 + 5
    return table, base, pow(base, -1, 2**64)


class Rolling:
    """Polynomial hash modulo 2**64 with a random byte table and an odd base.

    ``spans`` hashes any slice from two prefix sums, whatever its place.
    """

    def __init__(self, seed: int):
        self.table, base, inverse = _rolling(seed)
        self._base, self._inverse = np.uint64(base), np.uint64(inverse)
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, 2 * len(self._up))
            for name, base in (("_up", self._base), ("_down", self._inverse)):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self._up, self._down

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums over 64-bit values; bytes go through the table first."""
        if values.dtype == np.uint8:
            values = self.table[values]
        up, _ = self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(sums))
        return mix((sums[end] - sums[start]) * down[start])

    def grams(self, values: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of k values; documents are not told apart here."""
        if len(values) < k:
            return np.zeros(0, dtype=np.uint64)
        s = self.sums(values)
        n = len(values) - k + 1
        return mix((s[k : k + n] - s[:n]) * self._powers(len(s))[1][:n])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads entropy over all 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_A, BYTE_B, WORD_A, WORD_B = Rolling(11), Rolling(12), Rolling(13), Rolling(14)


class Block:
    """Documents laid end to end: ``data`` (uint8) and ``at`` (n + 1 offsets)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, rows: slice):
        self.data, self.at, self.rows = data, at, rows

    def __len__(self) -> int:
        return len(self.at) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Block(data[at[i] : at[j]], at[i : j + 1] - at[i], slice(i, j))
        i = j


class Words:
    """Word starts and ends in a block; ``at`` gives each document's range of words."""

    def __init__(self, block: Block, lower: bool = False):
        data = block.data
        word = ~SPACE[data]
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = block.at[1:-1]
        inner = inner[inner < len(word)]
        before[inner] = False
        inner = inner[inner > 0]
        after[inner - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.at = np.searchsorted(self.start, block.at)
        self.block, self.data = block, lowered(data) if lower else data

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, rolling: Rolling = BYTE_A) -> np.ndarray:
        return rolling.spans(rolling.sums(self.data), self.start, self.end)

    def doc(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.block)), np.diff(self.at))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def inside(at: np.ndarray, k: int) -> np.ndarray:
    """For items split at ``at``: which starts have k items left in their own part."""
    n = int(at[-1])
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    return (left >= k)[: max(n - k + 1, 0)]


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Position of the least key of each run of w keys, by block prefix and suffix minima.

    Positions ride in the low 30 bits, so equal contents choose equal places.
    """
    n = len(keys) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    place = np.arange(len(keys), dtype=np.uint64)
    low = U64((1 << 30) - 1)
    if len(keys) > 1 << 30:
        raise ValueError("a text of over 1 GB")
    k = (keys & ~low) | place
    pad = -len(k) % w
    k = np.concatenate([k, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    head = np.minimum.accumulate(k, axis=1).ravel()
    tail = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[:n], head[w - 1 : w - 1 + n]) & low).astype(np.int64)


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in at least one of the spans."""
    if not len(start):
        return np.zeros(n, dtype=bool)
    d = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), then start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(start, count)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
