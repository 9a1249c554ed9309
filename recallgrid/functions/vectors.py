"""Vector arithmetic as built-in expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _double(vector: Column) -> Column:
    return vector.cast("array<double>")


def squared_l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def inner_product(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def inner_product_distance(a: Column, b: Column) -> Column:
    return 1 - inner_product(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    """dot / (|a| |b| + epsilon): a zero vector gives 0."""
    return inner_product(a, b) / (norm(a) * norm(b) + epsilon)


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def normalized(a: Column) -> Column:
    """a over its norm; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_double(a), lambda x: x / n)).otherwise(_double(a))


def fitted(a: Column, dim: int) -> Column:
    """Cut or padded with zeros to dim components."""
    return F.slice(F.concat(_double(a), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def _half_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def own_scale(a: Column) -> Column:
    """The scale of a vector stored with 8 bits: its largest part over 127 (1 for a zero vector)."""
    most = F.array_max(F.transform(_double(a), lambda x: F.abs(x)))
    return F.when(most > 0, most / 127).otherwise(F.lit(1.0))


def quantized(a: Column, scale: Column) -> Column:
    """8-bit parts, rounded half away from zero and held to -127..127."""
    return F.transform(_double(a), lambda x: F.greatest(F.least(_half_away(x / scale), F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))


def dequantized(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * scale)


def int8_squared_l2(a: Column, b: Column, scale: Column) -> Column:
    """Of vectors with one common scale; the sum is exact."""
    whole = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("bigint") - y) * (x.cast("bigint") - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return whole * scale * scale
