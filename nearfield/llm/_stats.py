"""Statistics of documents, counted in one vectorised pass over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import table, texts
from ._text import BYTE_A, U64, WORD_A, Block, Words, blocks, inside, mix

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_ends", "n_wide", "n_single")
SYMBOLS = b"#*$%&|<>"

_SYMBOL, _UPPER, _DIGIT, _MARK = (np.zeros(256, dtype=bool) for _ in range(4))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?;:/\\=_~^@+{}[]()")] = True


def _per(at: np.ndarray, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), dtype=bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    many = same.copy()
    many[:-1] |= same[1:]
    out = np.zeros((2, len(keys)), dtype=bool)
    out[0, order], out[1, order] = many, same
    return out[0], out[1]


def count(block: Block) -> dict[str, np.ndarray]:
    """Counts of each document of a block.

    word_chars: code points in words; n_symbols: characters of #*$%&|<>; n_dup_lines:
    lines with a word that equal an earlier line; n_repeat_words: words in 3-word
    windows found twice or more; n_distinct: different words; n_marks, n_ends:
    uncommon punctuation, and words that end in . , ! or ?; n_wide: words of over 18
    bytes; n_single: words of one byte.
    """
    words, data, at = Words(block), block.data, block.at
    doc = words.doc()
    salt = mix(np.arange(len(block), dtype=np.uint64) + U64(77))
    hashes = words.hashes()
    sums = BYTE_A.sums(data)
    letter = (data & 0xC0) != 0x80
    in_word = np.zeros(len(data) + 1, dtype=np.int8)
    in_word[words.start] += 1
    in_word[words.end] -= 1
    in_word = np.cumsum(in_word[:-1]).astype(bool)
    # lines: cut at \n and at the documents' ends
    feed = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([feed + 1, at[:-1]]))
    owner = np.concatenate([np.searchsorted(at, feed, "right") - 1, np.arange(len(block))])
    owner.sort()
    end = np.minimum(np.append(begin[1:], len(data)), at[owner + 1])
    end = np.where((end > begin) & (end < at[owner + 1]), end - 1, end)
    tail = np.flatnonzero((end == at[owner + 1]) & (end > begin))
    tail = tail[(data[end[tail] - 1] == 10)]
    end[tail] -= 1
    end = np.maximum(end, begin)
    held = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    line = BYTE_A.spans(sums, begin[held], end[held]) ^ salt[owner[held]]
    dup = np.bincount(owner[held][_twice(line)[1]], minlength=len(block))
    start = np.flatnonzero(inside(words.at, 3))
    many = np.zeros(len(words) + 2, dtype=bool)
    many[2:][start[_twice(WORD_A.grams(hashes, 3)[start] ^ salt[doc[start]])[0]]] = True
    covered = many[2:] | many[1:-1] | many[:-2]
    again = _twice(hashes ^ salt[doc])[1]
    last = data[words.end - 1]
    size = words.end - words.start
    return {
        "n_words": np.diff(words.at),
        "word_chars": _per(at, letter & in_word),
        "n_symbols": _per(at, _SYMBOL[data]),
        "n_dup_lines": dup,
        "n_repeat_words": _per(words.at, covered),
        "n_lines": np.bincount(owner[held], minlength=len(block)),
        "n_distinct": np.diff(words.at) - _per(words.at, again),
        "n_upper": _per(at, _UPPER[data]),
        "n_digits": _per(at, _DIGIT[data]),
        "n_marks": _per(at, _MARK[data]),
        "n_ends": _per(words.at, (last == 46) | (last == 44) | (last == 33) | (last == 63)),
        "n_wide": _per(words.at, size > 18),
        "n_single": _per(words.at, size == 1),
    }


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            out = table(",".join(f"{n}:l" for n in NAMES), **count(block))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(block)), *out.columns], names=["doc_id", *NAMES])


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of ``NAMES`` of every row; null and empty texts count 0."""
    return texts(documents).mapInArrow(_run, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES))


#: Ratios over the counts: name, numerator, denominator (0 where it is 0).
RATIOS = (
    ("word_length", "word_chars", "n_words"),
    ("symbol_rate", "n_symbols", "n_words"),
    ("dup_line_rate", "n_dup_lines", "n_lines"),
    ("repeat_rate", "n_repeat_words", "n_words"),
    ("distinct_rate", "n_distinct", "n_words"),
    ("upper_rate", "n_upper", "word_chars"),
    ("digit_rate", "n_digits", "word_chars"),
    ("mark_rate", "n_marks", "n_words"),
    ("end_rate", "n_ends", "n_words"),
    ("wide_rate", "n_wide", "n_words"),
    ("single_rate", "n_single", "n_words"),
    ("line_words", "n_words", "n_lines"),
)
FEATURES = (*(n for n, _, _ in RATIOS), "n_words")


def feature(name: str) -> Column:
    if name in NAMES:
        return F.col(name).cast("double")
    _, top, below = next(r for r in RATIOS if r[0] == name)
    return F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(F.lit(0.0))
