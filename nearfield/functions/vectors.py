"""Vector functions: Column builders for plans, and the metric registry of the Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-30


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def ip_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def normalized(a: Column) -> Column:
    scale = F.sqrt(squared_norm(a)) + F.lit(EPSILON)
    return F.transform(a, lambda x: x.cast("double") / scale)


def cosine_distance(a: Column, b: Column) -> Column:
    return ip_distance(normalized(a), normalized(b))


def integer_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of integer vectors, exact."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def integer_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def jittered(a: Column, key: Column, spread: float) -> Column:
    """Each component moved by up to half of ``spread`` either way, as a hash of the key and its place says."""
    return F.transform(a, lambda x, i: x.cast("double") + (F.pmod(F.xxhash64(key, i), F.lit(1_000_003)) / F.lit(1_000_003.0) - 0.5) * spread)


def truncated(a: Column, dims: int) -> Column:
    return F.slice(a, 1, dims)


def subvector(a: Column, m: int | Column, dsub: int) -> Column:
    return F.slice(a, m * dsub + 1, F.lit(dsub))


def quantized_u8(a: Column, low: Column, step: Column) -> Column:
    """0..255, rounded half away from zero."""
    return F.transform(a, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round((x.cast("double") - low) / step).cast("int"))))


def quantized_i8(a: Column, scale: Column) -> Column:
    """-127..127, rounded half to even."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x.cast("double") * scale).cast("int"))))


def halved(a: Column) -> Column:
    """Rounded to half precision (round half to even, subnormals included)."""

    def one(x: Column) -> Column:
        v = x.cast("double")
        unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14)) - 10)
        return F.when(v == 0, F.lit(0.0)).otherwise(F.rint(v / unit) * unit)

    return F.transform(a, one)


def lookup_distance(codes: Column, table: Column) -> Column:
    """Asymmetric distance: the sum of each code's entry in its sub-space's table.

    Rounded, so that rows of equal codes tie whatever the order of the sum.
    """
    return F.round(_sum(F.zip_with(codes, table, lambda c, row: F.element_at(row, (c + 1).cast("int")))), 12)


def cluster_key(probes: Column) -> Column:
    """Up to four list ids, 16 bits each, packed into one key; absent ones are 0xffff."""
    key = F.lit(0).cast("long")
    for i in range(4):
        part = F.coalesce(F.get(probes, F.lit(i)).cast("long"), F.lit(0xFFFF))
        key = key.bitwiseOR(F.shiftleft(part, 16 * i))
    return key


def _np_l2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0.0)


def _np_unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(1, keepdims=True)) + EPSILON)


#: name -> (Column builder, numpy kernel of a query block against a row block)
METRICS: dict[str, tuple[Callable[[Column, Column], Column], Callable[[np.ndarray, np.ndarray], np.ndarray]]] = {
    "ip": (ip_distance, lambda q, x: 1 - q @ x.T),
    "l2": (l2_distance, _np_l2),
    "cosine": (cosine_distance, lambda q, x: 1 - _np_unit(q) @ _np_unit(x).T),
    "int_l2": (lambda a, b: integer_l2(a, b).cast("double"), lambda q, x: _np_l2(np.rint(q), np.rint(x))),
}


def register_metric(name: str, column: Callable[[Column, Column], Column], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Add a distance: smaller is nearer."""
    METRICS[name] = (column, kernel)
