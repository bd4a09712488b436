"""Values on a regular grid in long form (i, j, v): smoothing, reading between points, levels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F




def smooth(grid: DataFrame, shape: tuple[int, int], sigma: float) -> DataFrame:
    """Gaussian smoothing cut off at four sigma, edges reflected; points that are missing count as 0. One pass an axis."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / sum(raw)).alias("w")) for d, w in zip(range(-radius, radius + 1), raw)])
    out = grid
    for axis, n in zip("ij", shape):
        other = "j" if axis == "i" else "i"
        # each point stands at its own place and at its mirror images, and goes from each to what the kernel reaches
        images = F.transform(F.sequence(F.lit(-math.ceil(radius / n)), F.lit(math.ceil(radius / n))), lambda m: F.when(m % 2 == 0, F.col(axis) + m * n).otherwise(m * n + (n - 1) - F.col(axis)))
        spread = out.select(other, "v", F.explode(images).alias("_at")).select(other, "v", "_at", F.explode(kernel).alias("k"))
        to = F.col("_at") - F.col("k.d")
        out = spread.withColumn(axis, to).where((to >= 0) & (to < n)).groupBy("i", "j").agg(F.sum(F.col("v") * F.col("k.w")).alias("v"))
    return out


def bilinear(points: DataFrame, grid: DataFrame, origin: tuple[float, float], step: tuple[float, float], shape: tuple[int, int]) -> DataFrame:
    """points (id, x, y) with v read between the four grid points around each; 0 outside the grid."""
    at = [(F.col(c) - o) / s for c, o, s in zip("xy", origin, step)]
    inside = (at[0] >= 0) & (at[0] <= shape[0] - 1) & (at[1] >= 0) & (at[1] <= shape[1] - 1)
    low = [F.least(F.floor(a), F.lit(n - 2)).cast("long") for a, n in zip(at, shape)]
    part = [a - b for a, b in zip(at, low)]
    corner = lambda di, dj: F.struct((low[0] + di).alias("i"), (low[1] + dj).alias("j"), ((part[0] if di else 1 - part[0]) * (part[1] if dj else 1 - part[1])).alias("w"))
    corners = points.where(inside).select("id", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select("id", "c.*")
    read = corners.join(grid.select("i", "j", "v"), ["i", "j"]).groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return points.join(read, "id", "left").na.fill(0.0, ["v"])


def contour_levels(values: DataFrame, value: str, mode: str, n: int) -> DataFrame:
    """(level, v): n levels from the least to the largest value, evenly spaced in value, its root or its logarithm."""
    forward, back = {"linear": (lambda c: c, lambda c: c), "sqrt": (F.sqrt, lambda c: c * c), "log": (F.log10, lambda c: F.pow(F.lit(10.0), c))}[mode]
    v = F.col(value).cast("double")
    ends = values.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.min(F.when(v > 0, v)).alias("positive"))
    low = {"linear": F.col("lo"), "sqrt": F.greatest("lo", F.lit(0.0)), "log": F.greatest("positive", F.col("hi") * 1e-6)}[mode]
    lo, hi = forward(low), forward(F.col("hi"))
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("level"), lo.alias("a"), hi.alias("b")).select("level", back(F.col("a") + (F.col("b") - F.col("a")) * F.col("level") / (n - 1)).alias("v"))
