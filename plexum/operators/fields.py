"""Illumination fields: thin-plate surfaces through points of a model, gains from their range, and corrected pixels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexum.operators.spatial import kept


def _plates(own: np.ndarray, values: np.ndarray, at: np.ndarray, neighbours: int, smoothing: float) -> np.ndarray:
    """Thin-plate surfaces of the columns of values, with a plane, each place from its nearest points."""
    k = len(own) if neighbours <= 0 else min(neighbours, len(own))
    kernel = lambda d2: np.where(d2 > 0, 0.5 * d2 * np.log(np.where(d2 > 0, d2, 1.0)), 0.0)
    out = np.empty((len(at), values.shape[1]))
    for lo in range(0, len(at), 256):
        q = at[lo : lo + 256]
        d2 = ((q[:, None] - own[None]) ** 2).sum(-1)
        near = np.argsort(d2, axis=1, kind="stable")[:, :k]
        p = own[near]
        system = np.zeros((len(q), k + 3, k + 3))
        system[:, :k, :k] = kernel(((p[:, :, None] - p[:, None]) ** 2).sum(-1)) + smoothing * np.eye(k)
        system[:, :k, k], system[:, :k, k + 1 :] = 1.0, p
        system[:, k:, :k] = system[:, :k, k:].transpose(0, 2, 1)
        known = np.concatenate([values[near], np.zeros((len(q), 3, values.shape[1]))], axis=1)
        weights = np.linalg.solve(system, known)
        rows = np.concatenate([kernel(np.take_along_axis(d2, near, 1)), np.ones((len(q), 1)), q], axis=1)
        out[lo : lo + 256] = (rows[:, None] @ weights)[:, 0]
    return out


def evaluate(spark: SparkSession, points: np.ndarray, low: np.ndarray, high: np.ndarray, box: tuple[float, float, float, float], step: float = 192.0, neighbours: int = 64, smoothing: float = 1.0) -> DataFrame:
    """(x, y, low, high) over a grid from (x0, y0) to (x1, y1), both ends included, with steps of at most `step`; high lies at
    least 0.001 over low. The points are a model's and go to every task with the code; places are spread over tasks."""
    x0, y0, x1, y1 = box
    nx, ny = (max(2, math.ceil((b - a) / step) + 1) for a, b in ((x0, x1), (y0, y1)))
    mean, deviation = points.mean(0), points.std(0)
    deviation = np.where(deviation > 0, deviation, 1.0)
    own, values = (points - mean) / deviation, np.stack([low, high], 1).astype(float)

    def run(frames):
        for pdf in frames:
            i = pdf["id"].to_numpy()
            at = np.stack([x0 + (x1 - x0) * (i % nx) / (nx - 1), y0 + (y1 - y0) * (i // nx) / (ny - 1)], 1)
            z = _plates(own, values, (at - mean) / deviation, neighbours, smoothing)
            yield pd.DataFrame({"x": at[:, 0], "y": at[:, 1], "low": z[:, 0], "high": np.maximum(z[:, 1], z[:, 0] + 1e-3)})

    return spark.range(nx * ny).mapInPandas(run, "x double, y double, low double, high double")


def range_gain(field: DataFrame, typical: float, least: float = 1 / 3, most: float = 3.0) -> DataFrame:
    """field (x, y, low, high) with gain: one over its range as a share of a typical one, scaled to a mean of 1; both the share
    and the gain are held between the bounds. A typical range that is not positive counts as 1."""
    held = lambda c: F.least(F.greatest(c, F.lit(least)), F.lit(most))
    top = F.greatest("high", F.col("low") + 1e-3)
    share = (top - F.col("low")) / (typical if math.isfinite(typical) and typical > 0 else 1.0)
    inverse = field.withColumn("_i", 1 / held(share))
    mean = inverse.agg(F.avg("_i").alias("_m"))
    return inverse.join(F.broadcast(mean)).withColumn("gain", held(F.col("_i") / F.col("_m"))).drop("_i", "_m")  # one row of means


def correct(pixels: DataFrame, field: DataFrame, value: str = "value") -> DataFrame:
    """pixels (x, y, value, ...) less the low field, not below 0, times the gain; pixels outside the field are left out."""
    by = field.select("x", "y", "low", "gain")
    out = F.greatest(F.col(value) - F.col("low"), F.lit(0.0)) * F.col("gain")
    return pixels.join(by, ["x", "y"]).withColumn(value, out).select(pixels.columns)


def flat_field(pixels: DataFrame, field: DataFrame, value: str = "value") -> DataFrame:
    """pixels (x, y, value, ...) less the field's dark image, over its flat one (x, y, flat, dark); null where that is 0."""
    out = (F.col(value) - F.col("dark")) / F.nullif(F.col("flat"), F.lit(0.0))
    return pixels.join(field.select("x", "y", "flat", "dark"), ["x", "y"]).withColumn(value, out).select(pixels.columns)


def _smooth(field: np.ndarray, order: int) -> np.ndarray:
    """The part of a square field that cosines of at most `order` half waves in all make up."""
    n = len(field)
    k = np.arange(n)
    waves = np.cos(np.pi * (k[None] + 0.5) * k[:, None] / n) * np.sqrt(np.where(k == 0, 1, 2) / n)[:, None]
    spectrum = waves @ field @ waves.T
    return waves.T @ np.where(k[:, None] + k[None] <= order, spectrum, 0) @ waves


def fit_field(pixels: DataFrame, image: str, height: int, width: int, size: int = 32, order: int = 6, rounds: int = 12, settled: float = 1e-4, value: str = "value") -> DataFrame:
    """(y, x, flat) on a grid of size x size places: the field that all images of one shape share, of mean 1 and of cosines of at most
    `order` half waves. An image is its brightness times the field, and besides what few places add, cells and spots.

    Images are averaged down to the grid. In each round every image's brightness is fitted to the field and every place of the
    field to the images, by sums in which a place counts less the further off it was (weights of least absolute deviations); the
    driver holds the field alone. Rounds end once the field changes by less than `settled`. Null places and values are left out;
    images that are nowhere over 0 say nothing; without others the field is 1."""
    at = lambda c, n: F.floor(F.col(c) * size / n).cast("int").alias(c)
    own = pixels.where(F.col(image).isNotNull() & F.col(value).isNotNull() & F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    small = kept(own.groupBy(F.col(image).alias("i"), at("y", height), at("x", width)).agg(F.avg(F.col(value).cast("double")).alias("v")))
    spark = pixels.sparkSession
    rows = lambda field: spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(field)], "y int, x int, flat double")
    field = np.ones((size, size))
    bright = kept(small.groupBy("i").agg(F.percentile_approx("v", 0.5).alias("b")).where("b > 0"))
    for _ in range(rounds):
        seen = small.join(F.broadcast(rows(field)), ["y", "x"]).join(bright, "i")  # size * size rows are sent
        off = F.abs(F.col("v") - F.col("b") * F.col("flat"))
        weight = 1 / (off + 1e-3 * F.col("b"))
        fitted = seen.groupBy("i").agg((F.sum(weight * F.col("v") * F.col("flat")) / F.sum(weight * F.col("flat") * F.col("flat"))).alias("b")).where("b > 0")
        bright = kept(fitted)
        again = small.join(F.broadcast(rows(field)), ["y", "x"]).join(bright, "i")
        places = again.groupBy("y", "x").agg((F.sum(weight * F.col("v") * F.col("b")) / F.sum(weight * F.col("b") * F.col("b"))).alias("f")).collect()  # size * size rows at most
        new = field.copy()
        for r in places:
            new[r["y"], r["x"]] = r["f"]
        new = np.maximum(_smooth(new, order), 1e-3)
        new /= new.mean()
        change = float(np.abs(new - field).mean())
        field = new
        if change < settled:
            break
    return rows(field)
