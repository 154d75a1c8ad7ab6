"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over document statistics. Each
partition sums its part of the normal equations, so the driver receives a number
of sums that depends on the number of features only. A monotone step from raw to
calibrated scores is fitted on the sums of a fixed number of score bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed, table
from ._stats import FEATURES, NAMES, RATIOS, statistics

FOURIER, WIDTH, RIDGE, BINS, SEED = 128, 2.5, 1e-4, 400, 4


def columns(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The feature matrix from the counts; sizes enter by their logarithm."""
    out = []
    for name, top, below in RATIOS:
        a, b = counts[top].astype(float), counts[below].astype(float)
        r = np.divide(a, b, out=np.zeros_like(a), where=b > 0)
        out.append(np.log1p(r) if name in ("word_length", "line_words") else r)
    out.append(np.log1p(counts["n_words"].astype(float)))
    return np.stack(out, axis=1)


@dataclass
class Model:
    """Standardisation, projection, ridge weights and calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    at: np.ndarray | None = None
    level: np.ndarray | None = None

    def fourier(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(x.shape[1], FOURIER)) / WIDTH
        b = rng.uniform(0, 2 * np.pi, FOURIER)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FOURIER) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.at, self.level), 0, 1)


def isotonic(at: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by ``at``: centres and rising levels of the pools."""
    pools: list[list[float]] = []
    for x, n, g in zip(at.tolist(), total.tolist(), good.tolist(), strict=True):
        pools.append([x * n, n, g])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 1], p[:, 2] / p[:, 1]


def held_out(folds: int = 5, out: int = 0) -> Column:
    """Whether crc32 of doc_id as text leaves ``out``; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == out, F.lit(False))


def _counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {k: batch[k].to_numpy(zero_copy_only=False) for k in NAMES}


def _normal(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FOURIER + 1
        total = np.zeros((d, d + 1))
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                phi = model.fourier(columns(_counts(part)))
                y = part["quality"].to_numpy(zero_copy_only=False).astype(float)
                total += phi.T @ np.hstack([phi, y[:, None]])
        if total.any():
            yield table("k:i,v:d", k=np.arange(total.size, dtype=np.int32), v=total.ravel())

    return run


def _binned(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(columns(_counts(batch)))
            slot = np.clip(((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            n = np.bincount(slot, minlength=BINS)
            some = np.flatnonzero(n)
            y = batch["quality"].to_numpy(zero_copy_only=False).astype(float)
            yield table("k:i,n:d,g:d,r:d", k=some.astype(np.int32), n=n[some].astype(float), g=np.bincount(slot, y, BINS)[some], r=np.bincount(slot, raw, BINS)[some])

    return run


def fit(rows: DataFrame) -> Model:
    """Fit on rows of statistics with a quality column (0 or 1)."""
    x = {n: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)) for n, a, b in RATIOS} | {"n_words": F.col("n_words").cast("double")}
    x = {n: F.log1p(c) if n in ("word_length", "line_words", "n_words") else c for n, c in x.items()}
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *(f(x[n]).alias(f"{n}_{k}") for n in FEATURES for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not sums["n"]:
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    model = Model(np.array([sums[f"{n}_m"] for n in FEATURES]), np.maximum(np.array([sums[f"{n}_s"] for n in FEATURES]), 1e-6))
    d = FOURIER + 1
    flat = np.zeros(d * (d + 1))
    for k, v in rows.mapInArrow(_normal(model), "k int, v double").groupBy("k").agg(F.sum("v")).collect():
        flat[k] = v
    total = flat.reshape(d, d + 1)
    model.weights = np.linalg.solve(total[:, :d] + RIDGE * sums["n"] * np.eye(d), total[:, d])
    bins = sorted(rows.mapInArrow(_binned(model), "k int, n double, g double, r double").groupBy("k").agg(F.sum("n"), F.sum("g"), F.sum("r")).collect())
    n, g, r = (np.array([b[i] for b in bins]) for i in (1, 2, 3))
    model.at, model.level = isotonic(r / n, n, g)
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.score(columns(_counts(batch))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], score], names=["doc_id", "held_out", "score"])

    return run


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Learned from the labelled rows that are not held out; only statistics of the
    text enter a score. Null and empty texts are scored by their zero counts.
    Without labels all scores are 0.5; with labels of one kind they are that label.
    Rows that repeat a doc_id are scored each by its own text; labels that repeat
    one count once, by the least quality; null labels do not count.
    """
    stats = checkpointed(statistics(documents)).withColumn("held_out", held_out(folds, out))
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.min("quality").cast("int").alias("quality"))
    train = stats.where("not held_out").join(marks, stats.doc_id == marks._labelled)
    model = fit(checkpointed(train.select(*NAMES, "quality")))
    return stats.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
