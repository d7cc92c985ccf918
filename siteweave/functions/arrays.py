"""Vectors and flattened patches as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), l2(a) * l2(b))


def relative_l2(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """The distance of a from b by the length of b, the base."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(d) / (l2(b) + eps)


def centre_crop(patch: Column, p: int, q: int, c: int) -> Column:
    """The q x q x c centre of a flattened p x p x c patch."""
    if q > p:
        raise ValueError("the crop is larger than the patch")
    off = (p - q) // 2
    return F.flatten(F.transform(F.sequence(F.lit(off), F.lit(off + q - 1)), lambda r: F.slice(patch, (r * p + off) * c + 1, F.lit(q * c))))
