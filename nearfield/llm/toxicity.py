"""Toxicity by a subsequence string kernel and a Nyström support vector machine.

The kernel compares words by their common subsequences of three bytes within a
span of five, each gap at a discount, so gapped and inserted-character insults
stay near the insult. Training rows are labelled texts, and the machine sees a text
through its highest word: a clean text has no toxic word, a toxic one has at
least one. Which word that is, is learned in turns: first words that toxic texts
hold significantly more often than clean ones count as toxic; then, with the
machine fitted, each toxic text enters by its highest word if that lies on the toxic
side (else its label is taken for noise), and each clean text by its highest word
and by words drawn from it. Near copies of a text count once. Nyström landmarks span the
space in which the squared-hinge machine is solved. As scores are linear in the kernel's
explicit features, the landmarks fold into one weight for each subsequence. A sigmoid
fitted on the training texts turns the highest word's output into the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed, table, texts
from ._text import BYTE_A, Block, Words, blocks, lowered, mix, ragged
from .decontaminate import _DROPPED
from .quality_classifier import held_out

#: Labelled texts of either kind that are learned from, at most (those of least hash).
SAMPLE_TEXTS = 6000
#: Nyström landmarks, words drawn from each clean text, and turns of choosing the highest words.
LANDMARKS, DRAWN, TURNS = 400, 1, 2
#: A witness is this many times as frequent in toxic texts as in clean ones, at least.
RATIO = 8
#: The part of clean texts whose highest word a toxic text's must exceed to count.
CLEAR = 0.995
#: Hashes of a text's words that are compared to find near copies among toxic texts, and how many must agree.
SIGNATURE, ALIKE = 16, 12
GAP, BITS, PIECE, STEP = 0.6, 16, 30, 24
_PATTERNS = ((1, 2, 1.0), (1, 3, GAP), (2, 3, GAP), (1, 4, GAP**2), (2, 4, GAP**2), (3, 4, GAP**2))


def units(block: Block) -> Words:
    """Lower-case words without ASCII punctuation; runs of single letters are one word."""
    data = lowered(block.data)
    high = np.zeros(len(data), dtype=bool)
    high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = data + high.astype(np.uint8) * np.uint8(32)
    keep = ~_DROPPED[data]
    at = np.concatenate([[0], np.cumsum(keep)])[block.at]
    words = Words(Block(data[keep], at, block.rows))
    single = words.end - words.start == 1
    doc = words.doc()
    join = np.flatnonzero(single[:-1] & single[1:] & (doc[:-1] == doc[1:]))
    if len(join):
        data = words.data
        keep = np.ones(len(data), dtype=bool)
        keep[ragged(words.end[join], words.start[join + 1] - words.end[join])] = False
        at = np.concatenate([[0], np.cumsum(keep)])[words.block.at]
        words = Words(Block(data[keep], at, block.rows))
    return words


def _pieces(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of at most PIECE bytes that overlap, and the word of each."""
    size = end - start
    many = np.maximum(1, -(-(size - PIECE) // STEP) + 1)
    word = np.repeat(np.arange(len(start)), many)
    begin = start[word] + STEP * ragged(np.zeros(len(start), dtype=np.int64), many)
    return begin, np.minimum(begin + PIECE, end[word]), word


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For spans of similar size: their numbers, feature slots and feature weights (0 where none)."""
    size = end - start + 2
    padded = np.append(data, np.uint8(0))
    for low, high in ((0, 8), (8, 14), (14, PIECE + 2)):
        rows = np.flatnonzero((size > low) & (size <= high))
        for a in range(0, len(rows), 1 << 14):
            r = rows[a : a + (1 << 14)]
            k = np.arange(high)
            inside = k[None] < size[r][:, None]
            char = padded[np.where(inside, start[r][:, None] + k[None] - 1, len(data))].astype(np.uint32)
            char[:, 0] = 1
            char[np.arange(len(r)), size[r] - 1] = 2
            slots, weights = [], []
            for i, j, w in _PATTERNS:
                if high <= j:
                    continue
                x = char[:, : high - j] * np.uint32(0x9E3779B1) + char[:, i : high - j + i] * np.uint32(0x85EBCA77) + char[:, j:] * np.uint32(0xC2B2AE3D)
                x ^= x >> np.uint32(15)
                slots.append(((x * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int32))
                weights.append(np.where(inside[:, j:], np.float32(w), np.float32(0)))
            if slots:
                yield r, np.hstack(slots), np.hstack(weights)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Machine outputs of words, and the piece of each that gives it."""
        begin, stop, word = _pieces(start, end)
        out = np.full(len(begin), self.bias)
        for r, slot, w in _features(data, begin, stop):
            norm = np.sqrt((w * w).sum(1))
            out[r] += (self.weights[slot] * w).sum(1) / np.maximum(norm, 1e-6)
        order = np.lexsort((out, word))
        last = order[np.append(np.flatnonzero(np.diff(word[order])), len(order) - 1)] if len(order) else order
        return out[last], begin[last], stop[last]

    def texts(self, block: Block) -> np.ndarray:
        """The highest word of each text; -9 for texts without words."""
        words = units(block)
        out = np.full(len(block), -9.0)
        if len(words):
            _, first, back = np.unique(words.hashes(BYTE_A), return_index=True, return_inverse=True)
            f = self.words(words.data, words.start[first], words.end[first])[0][back]
            some = np.flatnonzero(np.diff(words.at))
            out[some] = np.maximum.reduceat(f, words.at[:-1][some])
        return np.maximum(out, -9.0)

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40)))


def _normalised(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of words of at most PIECE bytes: their numbers, slots and normalised weights."""
    end = np.cumsum([len(w) for w in words], dtype=np.int64)
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)
    for r, slot, w in _features(np.frombuffer(b"".join(words), dtype=np.uint8), start, end):
        yield r, slot, w / np.maximum(np.sqrt((w * w).sum(1)), 1e-6)[:, None]


def _matrix(words: list[bytes]) -> np.ndarray:
    """Normalised explicit features, dense over the slots."""
    out = np.zeros((len(words), 1 << BITS), dtype=np.float32)
    for r, slot, w in _normalised(words):
        np.add.at(out, (np.repeat(r, slot.shape[1]), slot.ravel()), w.ravel())
    return out


def _against(words: list[bytes], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of words with the landmarks."""
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    by_slot = np.ascontiguousarray(landmarks.T)
    for r, slot, w in _normalised(words):
        for a in range(0, len(r), 64):
            part = slice(a, a + 64)
            out[r[part]] = np.matmul(w[part][:, None, :], by_slot[slot[part]])[:, 0]
    return out


def cut(word: bytes) -> list[bytes]:
    """A word's pieces of at most PIECE bytes, which overlap."""
    begin, stop, _ = _pieces(np.array([0]), np.array([len(word)]))
    return [word[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]


def svm(phi: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Squared-hinge machine by Newton steps on the support; the last weight is the bias."""
    x = np.hstack([phi, np.ones((len(phi), 1))]).astype(float)
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        on = y * (x @ w) < 1
        xs, c = x[on], cost[on]
        new = np.linalg.solve(keep + xs.T @ (xs * c[:, None]), xs.T @ (c * y[on]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _machine(positive: Counter, negative: Counter) -> Model:
    """The machine over rows (words, with the number of texts that enter by them); both sides weigh the same."""
    bad, good = ([w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))] for c in (positive, negative))
    half = min(len(bad), LANDMARKS // 2)
    marks = bad[:half] + good[: LANDMARKS - half]
    spread = _matrix(marks)
    value, vector = np.linalg.eigh((spread @ spread.T).astype(float))
    some = value > 1e-4
    root = vector[:, some] / np.sqrt(value[some])
    phi = _against(bad + good, spread) @ root
    y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
    weight = [np.sqrt(np.array([c[w] for w in side], dtype=float)) for c, side in ((positive, bad), (negative, good))]
    cost = np.concatenate([32.0 * x / x.mean() for x in weight])
    w = svm(phi, y, cost)
    return Model((spread.T @ (root @ w[:-1])).astype(np.float32), float(w[-1]))


def _words_of(block: Block) -> tuple[Words, np.ndarray]:
    """The words of a block, and the first place of each different one within its text."""
    words = units(block)
    if not len(words):
        return words, np.zeros(0, dtype=np.int64)
    _, first = np.unique(np.stack([words.doc().astype(np.uint64), words.hashes(BYTE_A)]), axis=1, return_index=True)
    return words, first


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(type, toxic) once for each text."""
    for batch in batches:
        toxic = batch["toxic"].to_numpy(zero_copy_only=False)
        for block in blocks(batch["text"]):
            words, first = _words_of(block)
            if len(first):
                raw = words.data.tobytes()
                kind = [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
                yield table("type:z,toxic:l", type=kind, toxic=toxic[block.rows][words.doc()[first]])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sig): least hashes of the words of each text."""
    for batch in batches:
        for block in blocks(batch["text"]):
            words, first = _words_of(block)
            h = words.hashes(BYTE_A)[first] if len(first) else np.zeros(0, dtype=np.uint64)
            at = np.searchsorted(words.doc()[first], np.arange(len(block) + 1)) if len(first) else np.zeros(len(block) + 1, dtype=np.int64)
            some = np.flatnonzero(np.diff(at))
            low = np.zeros((len(block), SIGNATURE), dtype=np.uint64)
            for j in range(SIGNATURE if len(some) else 0):
                low[some, j] = np.minimum.reduceat(mix(h + np.uint64(j)), at[:-1][some])
            yield table("doc_id:l,sig:L", doc_id=batch["doc_id"].slice(block.rows.start, len(block)), sig=low.view(np.int64).tolist())


def copies(ids: list[int], sigs: np.ndarray) -> list[int]:
    """The ids that near-repeat one of a lesser id that stays."""
    gone, kept, n = [], np.empty_like(sigs), 0
    for k in np.argsort(ids, kind="stable").tolist():
        if n and (kept[:n] == sigs[k]).sum(1).max() >= ALIKE:
            gone.append(ids[k])
        else:
            kept[n] = sigs[k]
            n += 1
    return gone


def _tops(model: Model):
    """(toxic, top, raw, drawn) of each text: its highest piece of a word, the machine's output for it, and pieces drawn by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False)
            for block in blocks(batch["text"]):
                words, first = _words_of(block)
                if not len(first):
                    continue
                raw, begin, stop = model.words(words.data, words.start[first], words.end[first])
                doc, data = words.doc()[first], words.data.tobytes()
                draw = words.hashes(BYTE_A)[first]
                order = np.lexsort((draw, -raw, doc))
                lead = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
                by_hash = np.lexsort((draw, doc))
                edge = np.flatnonzero(np.diff(doc[by_hash], prepend=-1))
                sizes = np.diff(np.append(edge, len(by_hash)))
                text = lambda i: data[begin[i] : stop[i]]  # noqa: B023, E731
                drawn = [b"\0".join(text(i) for i in by_hash[a : a + min(n, DRAWN)]) for a, n in zip(edge.tolist(), sizes.tolist(), strict=True)]
                yield table("toxic:l,top:z,raw:d,drawn:z", toxic=toxic[block.rows][doc[lead]], top=[text(i) for i in lead], raw=raw[lead], drawn=drawn)

    return run


def _raw(model: Model, *keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [model.texts(b) for b in blocks(batch["text"])]
            raw = np.concatenate(raw) if raw else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), pa.array(raw)], names=[*keep, "raw"])

    return run


def _sigmoid(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not falling) and shift of a logistic fit, by Newton steps with a little ridge."""
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 0.02 * w
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.02 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(train: DataFrame) -> Model | None:
    """Learn from a bounded table of rows of doc_id, text and toxic (0 or 1); None without both kinds."""
    n = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    toxic = train.where("toxic = 1")
    held = toxic.mapInArrow(_signatures, "doc_id long, sig array<long>").toPandas()
    gone = copies(held["doc_id"].tolist(), np.array(held["sig"].tolist()))
    again = train.sparkSession.createDataFrame([(int(i),) for i in gone], "doc_id long")
    once = train.where("toxic = 0").unionByName(toxic.join(F.broadcast(again), "doc_id", "left_anti").select(train.columns))
    bad = significant(once, n[0], n[1] - len(gone))
    if not bad:
        # where no word stands out, the best cover by words of two texts or more has to do
        counts = _counted(train).where("bad >= 2").where(F.col("good") * F.lit(RATIO * n[1]) <= F.col("bad") * F.lit(n[0]))
        pool = [bytes(r.type) for r in counts.orderBy(F.desc("bad"), "type").collect()]
        bad = witnesses([np.array(r.places) for r in _incidence(toxic, pool).collect()], pool)
    if not bad:
        return None
    positive, blank = Counter(p for w in bad for p in cut(w)), Model(np.zeros(1 << BITS, dtype=np.float32), 0.0)
    # no word is higher than another yet: clean texts enter by drawn words alone
    rows = train.where("toxic = 0").mapInArrow(_tops(blank), _TOP).collect()
    negative = Counter(p for r in rows for p in bytes(r.drawn).split(b"\0") if p not in positive)
    if not negative:
        return None
    model = _machine(positive, negative)
    sure, drawn = positive, negative
    for _ in range(TURNS):
        rows = once.mapInArrow(_tops(model), _TOP).collect()
        hard = Counter(bytes(r.top) for r in rows if not r.toxic)
        # a toxic text whose highest word is no higher than those of clean ones has none
        bar = max(0.0, float(np.quantile([r.raw for r in rows if not r.toxic], CLEAR)))
        positive = sure + Counter(bytes(r.top) for r in rows if r.toxic and r.raw > bar and not hard[bytes(r.top)])
        negative = drawn + Counter({w: k for w, k in hard.items() if w not in positive})
        model = _machine(positive, Counter({w: k for w, k in negative.items() if w not in positive}))
    found = train.select("text", "toxic").mapInArrow(_raw(model, "toxic"), "toxic int, raw double").toPandas()
    model.slope, model.shift = _sigmoid(found["raw"].to_numpy(), found["toxic"].to_numpy(dtype=float))
    return model


_TOP = "toxic long, top binary, raw double, drawn binary"


def _counted(rows: DataFrame) -> DataFrame:
    """(type, bad, good): in how many toxic and clean texts each word is."""
    return rows.mapInArrow(_types, "type binary, toxic long").groupBy("type").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def significant(rows: DataFrame, clean: int, toxic: int) -> list[bytes]:
    """Words RATIO times as frequent in toxic texts as in clean ones, in more of them than chance explains.

    Were toxic texts no likelier to hold a word than clean ones, the chance of its counts would be
    below exp(-n * KL) (Chernoff); it must be so small that less than one of all words would do as well.
    """
    counts = checkpointed(_counted(rows).where("bad >= 2"))
    tried, share = max(counts.count(), 2), toxic / (clean + toxic)
    n, part = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    rest = F.when(F.col("good") == 0, F.lit(0.0)).otherwise((1 - part) * F.log((1 - part) / F.lit(1 - share)))
    clear = n * (part * F.log(part / F.lit(share)) + rest) >= F.lit(math.log(tried))
    often = F.col("good") * F.lit(RATIO * toxic) <= F.col("bad") * F.lit(clean)
    return [bytes(r.type) for r in counts.where(often & clear).orderBy(F.desc("bad"), "type").collect()]


def _incidence(toxic: DataFrame, bad: list[bytes]) -> DataFrame:
    """For each toxic text the numbers of the candidate words that it holds."""
    number = {t: i for i, t in enumerate(bad)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = []
            for block in blocks(batch["text"]):
                words = units(block)
                raw = words.data.tobytes()
                for i in range(len(block)):
                    seen = range(words.at[i], words.at[i + 1])
                    out.append(sorted({number[w] for k in seen if (w := raw[words.start[k] : words.end[k]]) in number}))
            yield table("places:L", places=out)

    return toxic.select("text").mapInArrow(run, "places array<long>").where("size(places) > 0")


def witnesses(held: list[np.ndarray], bad: list[bytes]) -> list[bytes]:
    """Words that cover the toxic texts, greedily: the word of most texts that have none yet comes next, if it has two."""
    texts_of: list[list[int]] = [[] for _ in bad]
    for d, places in enumerate(held):
        for t in places.tolist():
            texts_of[t].append(d)
    chosen: list[int] = []
    bare = np.ones(len(held), dtype=bool)
    gain = np.array([len(x) for x in texts_of], dtype=np.int64)
    while len(gain) and gain[t := int(np.argmax(gain))] >= 2:
        chosen.append(t)
        for d in texts_of[t]:
            if bare[d]:
                bare[d] = False
                np.subtract.at(gain, held[d], 1)
        gain[t] = 0
    return [bad[t] for t in chosen]


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                score = np.zeros(batch.num_rows)
            else:
                raw = [model.texts(b) for b in blocks(batch["text"])]
                score = model.score(np.concatenate(raw)) if raw else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score)], names=["doc_id", "held_out", "score"])

    return run


def classify(documents: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1, threshold: float = 0.7, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Learned from labelled rows that are not held out, by the text alone. Null and
    empty texts score as texts without words. Without labelled texts of both kinds
    all scores are 0. Labels that repeat a doc_id count once, by the greatest; null
    labels do not count; rows that repeat a doc_id are scored each by its own text.
    """
    docs = texts(documents).withColumn("held_out", held_out(folds, out))
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    # of each kind no more marks than texts are wanted, so these may be sent out whole
    kept = marks.where(~F.coalesce(F.pmod(F.crc32(F.col("_labelled").cast("string")), F.lit(folds)) == out, F.lit(False)))
    chosen = [kept.where(F.col("toxic") == k).orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample_texts) for k in (0, 1)]
    some = F.broadcast(chosen[0].union(chosen[1]))
    train = checkpointed(docs.where("not held_out").join(some, F.col("doc_id") == F.col("_labelled")).select("doc_id", "text", "toxic").dropDuplicates(["doc_id"]))
    model = fit(train)
    return docs.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
