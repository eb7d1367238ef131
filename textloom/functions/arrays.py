"""Array and vector mathematics as Column expressions, accumulated in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also when a lambda inside uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, total(v) / F.size(v))


def variance(v: Column) -> Column:
    """Population variance."""
    squares = let(mean(v), lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m)))
    return F.when(F.size(v) > 0, squares / F.size(v))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    moments = F.struct(mean(v).alias("m"), F.sqrt(variance(v) + F.lit(eps)).alias("sd"))
    return let(moments, lambda s: F.transform(v, lambda x: (x.cast("double") - s["m"]) / s["sd"]))


def fit(v: Column, length: int, pad: Column) -> Column:
    """Cut or pad an array on the right to ``length`` items."""
    return F.concat(F.slice(v, 1, length), F.array_repeat(pad, F.greatest(F.lit(0), F.lit(length) - F.size(v))))


def keep_last(v: Column, length: int) -> Column:
    """The last ``length`` items, all of a shorter array."""
    return F.slice(v, F.greatest(F.lit(1), F.size(v) - length + 1), length)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased chance that one of ``k`` of ``n`` samples, ``c`` of them correct, passes; null where n < k."""
    low, high = F.greatest(n - c + 1, F.lit(1)).cast("int"), F.greatest(n, F.lit(1)).cast("int")
    miss = F.aggregate(F.sequence(F.least(low, high), high), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    return F.when(n < k, None).when(n - c < k, 1.0).when(c <= 0, 0.0).otherwise(1 - miss)


def quantize_int8(v: Column) -> Column:
    """Symmetric per-vector INT8 codes; the scale is the largest magnitude over 127 (half to even)."""
    return let(quantize_scale(v), lambda scale: F.transform(v, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.rint(x.cast("double") / scale))).cast("int")))


def quantize_scale(v: Column) -> Column:
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, top / 127).otherwise(F.lit(1.0))
