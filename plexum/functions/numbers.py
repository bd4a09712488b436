"""Numeric and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector over its norm; for a zero vector the uniform unit vector."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: F.lit(1.0) / F.sqrt(F.size(v).cast("double"))))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def bits(code: Column, n: int) -> Column:
    """The n lowest bits, least first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(F.floor(code / F.pow(F.lit(2.0), i)), F.lit(2)).cast("int"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def phase(y: Column, x: Column, offset: float = 0.0) -> Column:
    """The angle of (x, y) plus an offset, in (-pi, pi]."""
    turn = F.atan2(y, x) + F.lit(offset)
    return F.lit(3.141592653589793) - F.pmod(F.lit(3.141592653589793) - turn, F.lit(6.283185307179586))


def rotate_xy(x: Column, y: Column, cx: Column, cy: Column, degrees: float) -> tuple[Column, Column]:
    """Points turned about a centre, clockwise for positive degrees."""
    a = F.radians(F.lit(-degrees))
    dx, dy = x - cx, y - cy
    return cx + dx * F.cos(a) - dy * F.sin(a), cy + dx * F.sin(a) + dy * F.cos(a)


def quantile_nearest(values: Column, q: float) -> Column:
    """The element of an array at the rounded rank q * (n - 1)."""
    kept = F.array_sort(F.array_compact(values))
    return F.when(F.size(kept) > 0, F.get(kept, F.round(F.lit(q) * (F.size(kept) - 1), 0).cast("int")))


def uniform(key: Column) -> Column:
    """A number in [0, 1) that a string decides, the same in any engine."""
    return F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("long") / 16_777_216.0


def normal(key: Column) -> Column:
    """A standard normal number that a string decides."""
    radius = F.sqrt(-2 * F.ln(1 - uniform(F.concat(key, F.lit("|a")))))
    return radius * F.cos(2 * F.pi() * uniform(F.concat(key, F.lit("|b"))))


def random_bases(key: Column) -> Column:
    """32 bases that a string decides."""
    return F.translate(F.md5(key), "0123456789abcdef", "ACGT" * 4)


def digitise(value: Column, edges: list[float]) -> Column:
    """How many of the ascending edges a value has reached."""
    return F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(0), lambda s, e: s + F.when(value >= e, 1).otherwise(0))
