"""Plan-side helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

#: The word pattern, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage in the shared folder of ``spark.checkpoint.dir``; local sessions that name none get one, clusters an error."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each drawn out by underscores until no column has it."""
    held = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in held:
            n += "_"
        held.add(n.lower())
        out.append(n)
    return out


def texts(documents: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table holds.

    Columns of the right type pass as they are: an alias would keep Spark from
    seeing that two exchanges of the texts are the same.
    """
    kinds = dict(documents.dtypes)
    return documents.select(*(F.col(c) if kinds[c] == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))))


def table(schema: str, **columns) -> pa.RecordBatch:
    """A record batch of numpy arrays, typed by a short schema string (name:type,...)."""
    kinds = {"l": pa.int64(), "i": pa.int32(), "b": pa.bool_(), "d": pa.float64(), "s": pa.string(), "z": pa.binary(), "L": pa.list_(pa.int64())}
    fields = [x.split(":") for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], type=kinds[t]) for n, t in fields], names=[n for n, _ in fields])


def grouped(batches: Iterator[pa.RecordBatch], key: list[str], limit: int = 1 << 22) -> Iterator[pa.Table]:
    """From batches sorted by key: tables of whole groups, of ``limit`` bytes or one group each."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes < limit:
            continue
        whole = pa.Table.from_batches(held)
        last = [whole[k].chunk(whole[k].num_chunks - 1)[-1].as_py() for k in key]
        differs = np.zeros(whole.num_rows, dtype=bool)
        for k, v in zip(key, last, strict=True):
            differs |= whole[k].to_numpy() != v
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
            held_bytes = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held)
