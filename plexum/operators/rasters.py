"""Raster kernels over pixels in long form (tile, z, y, x, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def max_projection(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The largest value over what keys leave out."""
    return pixels.groupBy(*keys).agg(F.max(value).alias(value))


def downsample(pixels: DataFrame, keys: list[str], factor: int, value: str = "value") -> DataFrame:
    """Mean of blocks of factor x factor pixels."""
    blocks = [F.floor(F.col(a) / factor).cast("long").alias(a) for a in ("y", "x")]
    return pixels.groupBy(*keys, *blocks).agg(F.avg(value).alias(value))


def spillover(a: Column, b: Column, share: float) -> Column:
    """a less a share of b, nothing below 0."""
    return F.greatest(a - b * share, F.lit(0.0))


def bleed_through(blank: Column, slope: float, intercept: float) -> Column:
    return F.greatest(blank * slope + intercept, F.lit(0.0))


def quantise(value: Column, low: float, scale: float, top: int = 65_535) -> Column:
    """A value as an unsigned number of 16 bits, clipped."""
    return F.greatest(F.lit(0), F.least(F.lit(top), F.round((value - low) * scale))).cast("int")


def label_at(points: DataFrame, labels: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    """points with the label of the pixel that they are in; 0 outside all labels."""
    pixel = labels.select(F.col("y").alias("_y"), F.col("x").alias("_x"), "label")
    on = (F.floor(F.col(y)).cast("long") == F.col("_y")) & (F.floor(F.col(x)).cast("long") == F.col("_x"))
    return points.join(pixel, on, "left").drop("_y", "_x").withColumn("label", F.coalesce("label", F.lit(0)))


def split_offset(split: Column, x: Column, y: Column, size: int = 1988, cut: int = 1024) -> tuple[Column, Column]:
    """The origin of quarter 0 to 3 (left or right, then top or bottom) of a tile whose quarters of side cut overlap."""
    move = size - cut
    return x + F.when(split.isin(1, 3), move).otherwise(0), y + F.when(split.isin(2, 3), move).otherwise(0)


def region_properties(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Area, centroid and bounding box of labels; label 0 is ground."""
    box = [f(a).alias(f"{a}_{n}") for a in ("y", "x") for n, f in (("min", F.min), ("max", F.max))]
    return pixels.where("label <> 0").groupBy(*keys, "label").agg(F.count("*").alias("area"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"), *box)


def merge_boxes(boxes: DataFrame, key: str) -> DataFrame:
    """The box around all boxes (y0, x0, y1, x1) of a key."""
    return boxes.groupBy(key).agg(*[f(c).alias(c) for c, f in (("y0", F.min), ("x0", F.min), ("y1", F.max), ("x1", F.max))])


def _reach(pixels: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Each set pixel at every place that a square of a radius reaches."""
    step = F.sequence(F.lit(-radius), F.lit(radius))
    by = pixels.select(*keys, F.explode(F.transform(step, lambda d: F.col("y") + d)).alias("y"), "x")
    return by.select(*keys, "y", F.explode(F.transform(step, lambda d: F.col("x") + d)).alias("x"))


def dilate(pixels: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Set pixels (keys..., y, x), no pixel twice, and all within a square of a radius of one."""
    return _reach(pixels, keys, radius).distinct()


def erode(pixels: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Set pixels whose whole square of a radius is set."""
    return _reach(pixels, keys, radius).groupBy(*keys, "y", "x").agg(F.count("*").alias("_n")).where(F.col("_n") == (2 * radius + 1) ** 2).drop("_n")


def opening(pixels: DataFrame, keys: list[str], radius: int) -> DataFrame:
    return dilate(erode(pixels, keys, radius), keys, radius)


def closing(pixels: DataFrame, keys: list[str], radius: int) -> DataFrame:
    return erode(dilate(pixels, keys, radius), keys, radius)


def affine(y: Column, x: Column, matrix: tuple[tuple[float, float], tuple[float, float]], shift: tuple[float, float]) -> tuple[Column, Column]:
    """Points moved by a matrix and a shift, both in (y, x)."""
    return tuple(y * matrix[i][0] + x * matrix[i][1] + shift[i] for i in (0, 1))


def fit_affine(pairs: DataFrame) -> tuple[tuple[tuple[float, float], tuple[float, float]], tuple[float, float]]:
    """Least squares over pairs (y, x, ty, tx): the matrix and shift that take (y, x) to (ty, tx). Sums come from one pass."""
    import numpy as np

    names = ["y", "x", "one", "ty", "tx"]
    sums = pairs.withColumn("one", F.lit(1.0)).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names[:3] for b in names]).first()
    left = np.array([[sums[f"{a}_{b}"] for b in names[:3]] for a in names[:3]], float)
    right = np.array([[sums[f"{a}_{b}"] for b in names[3:]] for a in names[:3]], float)
    fit = np.linalg.solve(left, right)
    return tuple(tuple(float(v) for v in fit[:2, i]) for i in (0, 1)), tuple(float(v) for v in fit[2])


def subtile_percentiles(pixels: DataFrame, keys: list[str], size: int, shares: list[float]) -> DataFrame:
    """(keys, row, col, q): percentiles of value in blocks of size x size pixels."""
    block = [F.floor(F.col(a) / size).cast("long").alias(n) for a, n in (("y", "row"), ("x", "col"))]
    return pixels.groupBy(*keys, *block).agg(F.percentile("value", F.array(*[F.lit(s) for s in shares])).alias("q"))


def covered(points: DataFrame, tiles: DataFrame, width: float, height: float) -> DataFrame:
    """Points (x, y) in any tile (x0, y0) of one size, upper sides out. An equi-join on tile-sized cells."""
    cell = lambda v, s: F.floor(v / s).cast("long")
    reach = lambda c, s: F.explode(F.sequence(cell(F.col(c), s), cell(F.col(c) + s, s)))
    spread = tiles.select("x0", "y0").distinct().withColumn("_i", reach("x0", width)).withColumn("_j", reach("y0", height)).alias("t")
    p = points.withColumns({"_ci": cell(F.col("x"), width), "_cj": cell(F.col("y"), height)})
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + width) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + height)
    return p.join(spread, (F.col("_ci") == F.col("_i")) & (F.col("_cj") == F.col("_j")) & inside, "left_semi").select(points.columns)


def rescale(value: Column, low: Column, scale: Column) -> Column:
    """Value less a channel's minimum, over its scale, nothing below 0."""
    return F.greatest((value - low) / scale, F.lit(0.0))


def quiet(vector: Column, norm: float) -> Column:
    """A vector, all zeros where its norm is below a level."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(length < norm, F.transform(vector, lambda v: F.lit(0.0))).otherwise(vector)
