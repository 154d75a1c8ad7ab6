"""Quality rules: a decision list learned by sequential covering.

Rules reject. Each is a conjunction of thresholds on document statistics, grown
on two thirds of the labelled rows by information gain and pruned on the rest;
rows that it covers leave before the next one is grown. The list comes out as
one Spark CASE expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._spark import checkpointed, table, texts
from ._stats import FEATURES, NAMES, count, feature, statistics
from ._text import blocks

#: Labelled rows that the list is learned from, at most (those of least hash).
SAMPLE_ROWS = 20_000


#: The rows that the base rejects.
BASE_SQL = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Test:
    name: str
    at_least: bool
    value: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.value if self.at_least else x[self.name] < self.value

    def expression(self) -> Column:
        return feature(self.name) >= F.lit(self.value) if self.at_least else feature(self.name) < F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.value:.6g}"


Rule = tuple[Test, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for t in rule:
        out &= t.covers(x)
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray, cuts: dict[str, np.ndarray]) -> tuple[float, Test | None]:
    """The test of most gain: p * (log2 of the precision after - before)."""
    p0, n0 = int((live & bad).sum()), int(live.sum())
    best, found = 1e-9, None
    for name, values in cuts.items():
        if not len(values):
            continue
        slot = np.searchsorted(values, x[name][live], "right")
        pos = np.bincount(slot[bad[live]], minlength=len(values) + 1)
        total = np.bincount(slot, minlength=len(values) + 1)
        up_p, up_n = pos[::-1].cumsum()[::-1][1:], total[::-1].cumsum()[::-1][1:]
        for at_least, p, n in ((True, up_p, up_n), (False, p0 - up_p, n0 - up_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Test(name, at_least, float(values[k]))
    return best, found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, most_rules: int = 24, most_tests: int = 4, precision: float = 0.75) -> list[Rule]:
    """Ordered rejecting rules from feature columns, labels and a fold (0 prunes, others grow).

    No rows, or rows of one label only, give no rules.
    """
    n = len(bad)
    rules: list[Rule] = []
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, 129)[1:-1])) if n else np.zeros(0) for k, v in x.items()}
    # midpoints generalise better than values that occur
    cuts = {k: (v[1:] + v[:-1]) / 2 for k, v in cuts.items()}
    open_ = np.ones(n, dtype=bool)
    while len(rules) < most_rules:
        grow, prune = open_ & (fold != 0), open_ & (fold == 0)
        if not (grow & bad).any() or not (grow & ~bad).any():
            break
        rule: Rule = ()
        live = grow.copy()
        while len(rule) < most_tests and (live & ~bad).any():
            _, test = _best(x, bad, live, cuts)
            if test is None:
                break
            rule = (*rule, test)
            live &= test.covers(x)
        worth = []
        for k in range(1, len(rule) + 1):
            c = _covered(rule[:k], x, n) & prune
            p, q = int((c & bad).sum()), int((c & ~bad).sum())
            worth.append(((p - q) / (p + q) if p + q else -1.0, p, -k))
        if not worth:
            break
        value, p, k = max(worth)
        if (value + 1) / 2 < precision or p < 2:
            break
        rules.append(rule[:-k])
        open_ &= ~_covered(rule[:-k], x, n)
    return rules


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled ids, chosen by a hash of doc_id; only their texts are counted."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.min("quality").alias("_quality"))
    sample = F.broadcast(checkpointed(marks.orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample_rows)))
    some = texts(documents).join(sample, F.col("doc_id") == F.col("_labelled"), "left_semi")
    rows = statistics(some).join(sample, F.col("doc_id") == F.col("_labelled"))
    # rows that repeat an id are learned from once, by the least counts
    rows = rows.groupBy("doc_id", "_quality").agg(F.min(F.struct(*NAMES)).alias("m")).select("doc_id", "_quality", "m.*")
    found = rows.select(*(feature(k).alias(k) for k in FEATURES), "_quality", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).alias("_fold"), "doc_id").toPandas().sort_values("doc_id")
    x = {k: found[k].to_numpy(dtype=float) for k in FEATURES}
    return learn(x, found["_quality"].to_numpy() == 0, found["_fold"].to_numpy())


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered Spark conditional: false at the first rule that fires, else true."""
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        fires = F.lit(True)
        for t in rule:
            fires = fires & t.expression()
        out = out.when(fires, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics of every row with base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word
    windows. kept: not failed, and no learned rule fires. Null and empty texts have
    no words and fail. Rows that repeat a doc_id are judged each by its own text.
    Without labelled rows of both kinds nothing but the base rejects.
    """
    rules = fit(documents, labels, sample_rows)
    return statistics(documents).withColumn("base_failed", F.expr(BASE_SQL)).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def _counted(column: int):
    """Rows as they are, with the counts of their texts beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for block in blocks(rows.flatten()[column].cast(pa.string())):
                counts = table(",".join(f"{n}:l" for n in NAMES), **count(block))
                yield pa.RecordBatch.from_arrays([rows.slice(block.rows.start, len(block)), *counts.columns], names=["row", *NAMES])

    return run


def keep_good(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of the table whose text is kept; columns stay as they are.

    Rows are judged where they are read by the learned conditional, each by its own text, whatever its doc_id
    (null and repeated ones too); null and empty texts go.
    """
    rules = fit(documents, labels, sample_rows)
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    schema = StructType([StructField("row", rows.schema["row"].dataType), *(StructField(n, LongType()) for n in NAMES)])
    counted = rows.mapInArrow(_counted(documents.columns.index("text")), schema)
    return counted.where(~F.expr(BASE_SQL) & verdict(rules)).select("row.*")
