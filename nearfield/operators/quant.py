"""Scalar quantisation: 8-bit unsigned with rerank, 8-bit signed, half precision.

Rows are quantised where they are scanned; codes meet a block of queries as matrices.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import quantized_u8
from .flat import Kernel, asked, matrix, rerank, scan
from .topk import ranked, vector_columns


def u8_params(base: DataFrame) -> DataFrame:
    """(low, high, step): the range of all components; a constant table gets a range of 1e-6."""
    r = vector_columns(base).agg(F.min(F.array_min("v")).cast("double").alias("low"), F.max(F.array_max("v")).cast("double").alias("top"))
    r = r.withColumn("high", F.when(F.col("top") > F.col("low"), F.col("top")).otherwise(F.col("low") + 1e-6))
    return r.select("low", "high", ((F.col("high") - F.col("low")) / 255).alias("step"))


def u8_codes(base: DataFrame) -> DataFrame:
    """(vec_id, code, total, bias): codes, their sum, and low * step * sum."""
    p = F.broadcast(u8_params(base))
    rows = vector_columns(base).join(p).withColumn("code", quantized_u8(F.col("v"), F.col("low"), F.col("step")))
    total = F.aggregate("code", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn("total", total).select("vec_id", "code", "total", (F.col("low") * F.col("step") * F.col("total")).alias("bias"))


def u8_search(base: DataFrame, queries: DataFrame, k: int = 10, top_p: int = 50) -> DataFrame:
    """Candidates by the score low * step * sum + step^2 * codes . query codes, then exact distances."""
    p = u8_params(base).first()
    low, step = p["low"], p["step"]

    def kernel_of(q: np.ndarray) -> Kernel:
        code = lambda x: np.clip(np.floor((x - low) / step + 0.5), 0, 255)
        qc = code(q)

        def kernel(which: np.ndarray, part) -> np.ndarray:
            x = code(matrix(part["v"], q.shape[1]))
            return -(low * step * x.sum(1)[None] + step * step * (qc[which] @ x.T))

        return kernel

    if low is None:
        return ranked(scan(vector_columns(base).limit(0), asked(queries), kernel_of, k), k)
    near = ranked(scan(vector_columns(base), asked(queries), kernel_of, max(k, top_p)), max(k, top_p))
    return rerank(near, vector_columns(base), asked(queries), k)


def i8_scale(base: DataFrame, queries: DataFrame) -> DataFrame:
    """127 over the greatest absolute component of rows and queries."""
    both = base.select("embedding").unionByName(queries.select("embedding"))
    top = F.max(F.greatest(F.array_max("embedding").cast("double"), -F.array_min("embedding").cast("double")))
    return both.agg(top.alias("top")).select(F.when(F.col("top") > 0, 127.0 / F.col("top")).otherwise(F.lit(1.0)).alias("scale"))


def i8_search(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The distance is minus the integer product of the codes."""
    scale = i8_scale(base, queries).first()["scale"]
    code = lambda x: np.clip(np.rint(x * scale), -127, 127)

    def kernel_of(q: np.ndarray) -> Kernel:
        qc = code(q)
        return lambda which, part: 0.0 - qc[which] @ code(matrix(part["v"], q.shape[1])).T

    return ranked(scan(vector_columns(base), asked(queries), kernel_of, k), k)


def half_search(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Inner product distance of vectors rounded to half precision."""
    half = lambda x: x.astype(np.float16).astype(np.float64)

    def kernel_of(q: np.ndarray) -> Kernel:
        qh = half(q)
        return lambda which, part: 1 - qh[which] @ half(matrix(part["v"], q.shape[1])).T

    return ranked(scan(vector_columns(base), asked(queries), kernel_of, k), k)
