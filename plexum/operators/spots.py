"""Spots of images that are cut into blocks, and shifts between pairs of images.

Pixels (keys, y, x, value) are gathered into square blocks. A pixel near an edge is dealt to the blocks on the other side too,
so each block has the halo that a filter needs and no image stands in one task. A block owns the pixels of its core, and tells
the spots whose peak is one of these; so a spot on an edge is told once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a block, in pixels.
SIDE = 256


@dataclass(frozen=True)
class Kernel:
    """A Gaussian less its mean, over the places it is taken at; relative_error scales a threshold of pixels to one of sums."""

    weights: np.ndarray
    mask: np.ndarray
    relative_error: float

    @property
    def radius(self) -> int:
        return len(self.weights) // 2


#: Standard deviations of the Gaussian that a kernel reaches, the least radius, and the full width at half the
#: maximum of a Gaussian of deviation 1.
REACH, LEAST_RADIUS, FULL_WIDTH = 1.5, 2.0, 2.3548200450309493


def kernel(fwhm: float) -> Kernel:
    sigma = fwhm / FULL_WIDTH
    radius = max(int(LEAST_RADIUS), int(REACH * np.sqrt(2) * sigma))
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    far = y * y + x * x
    mask = (far <= (REACH * sigma) ** 2) | (far <= LEAST_RADIUS**2)
    g = np.exp(-far / (2 * sigma * sigma)) * mask
    spread = (g * g).sum() - g.sum() ** 2 / mask.sum()
    return Kernel((g - g.sum() / mask.sum()) / spread * mask, mask, float(1 / np.sqrt(spread)))


def blocks(pixels: DataFrame, keys: list[str], halo: int, value: str = "value", side: int | None = None) -> DataFrame:
    """keys, by, bx, y, x, v: the pixels of each block with its halo, as arrays. Null places are left out, null values are 0."""
    side = side or SIDE
    if halo > side:
        raise ValueError(f"a halo of {halo} is wider than a block")
    reach = lambda a: F.sequence(F.floor((F.col(a) - halo) / side), F.floor((F.col(a) + halo) / side))
    rows = pixels.where("y is not null and x is not null").select(*keys, "y", "x", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    dealt = rows.withColumn("by", F.explode(reach("y"))).withColumn("bx", F.explode(reach("x")))
    return dealt.groupBy(*keys, "by", "bx").agg(F.collect_list(F.col("y").cast("int")).alias("y"), F.collect_list(F.col("x").cast("int")).alias("x"), F.collect_list("v").alias("v"))


def clipped_statistics(pixels: DataFrame, keys: list[str], value: str = "value", sigma: float = 3.0, rounds: int = 5) -> DataFrame:
    """keys, median, std: of each image's values, after values over sigma deviations from the median were left out, again and
    again until none is or rounds are over. Values are counted first: an image of 16 bits has at most 65 536 of them."""
    counts = pixels.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    lists = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("h"))

    def clip(v: np.ndarray, n: np.ndarray) -> tuple[float, float]:
        for _ in range(rounds + 1):
            before = np.cumsum(n)
            total = before[-1]
            median = (v[np.searchsorted(before, (total - 1) // 2, "right")] + v[np.searchsorted(before, total // 2, "right")]) / 2
            mean = (v * n).sum() / total
            std = float(np.sqrt(((v - mean) ** 2 * n).sum() / total))
            ok = (v >= median - sigma * std) & (v <= median + sigma * std)
            if _ == rounds or ok.all():
                break
            v, n = v[ok], n[ok]
        return float(median), std

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [clip(*(np.array(h.values.field(f)) for f in ("v", "n"))) for h in batch.column("h")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array([m for m, _ in got], pa.float64()), pa.array([s for _, s in got], pa.float64())], names=[*keys, "median", "std"])

    kinds = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys)
    return lists.mapInArrow(run, f"{kinds}, median double, std double")


def _filtered(image: np.ndarray, k: Kernel) -> np.ndarray:
    """Sums under the kernel; of the outermost pixels, as many as its radius, none are told."""
    r = k.radius
    out = np.zeros(tuple(s - 2 * r for s in image.shape))
    for dy, dx in zip(*np.nonzero(k.mask)):
        out += k.weights[dy, dx] * image[dy : dy + out.shape[0], dx : dx + out.shape[1]]
    return out


def _vertex(a: float, b: float, c: float) -> float:
    """Where a parabola through three neighbouring values, the middle one the largest, is highest."""
    bend = a - 2 * b + c
    return 0.5 * (a - c) / bend if bend < 0 else 0.0


def find_in_block(image: np.ndarray, k: Kernel, threshold: float, core: tuple[slice, slice], sharp: tuple[float, float], round_: tuple[float, float]) -> list[tuple]:
    """Spots whose peak lies in core: y, x (of image), peak, flux (of the filtered peak over the threshold), sharpness, roundness.

    A peak is no less than any other filtered value under the kernel's mask; of equal ones the first in reading order counts."""
    r = k.radius
    limit = threshold * k.relative_error
    wide = np.pad(_filtered(image, k), r, constant_values=-np.inf)
    out = []
    ys, xs = np.nonzero(wide[core] > limit)
    for y, x in zip(ys + core[0].start, xs + core[1].start):
        box = (slice(y - r, y + r + 1), slice(x - r, x + r + 1))
        near, own = wide[box], wide[y, x]
        if near.shape != k.mask.shape:
            continue
        if (near[k.mask] > own).any() or (near[k.mask] == own)[: k.mask[:r].sum() + k.mask[r, :r].sum()].any():
            continue
        raw = image[box]
        around = (raw[k.mask].sum() - raw[r, r]) / (k.mask.sum() - 1)
        sharpness = (raw[r, r] - around) / own
        # of the filtered values around the peak: those of two opposite quarters less those of the others, of all
        f = np.where(np.isfinite(near), near, 0.0)
        quarters = f[: r + 1, r + 1 :].sum() + f[r:, :r].sum() - f[:r, : r + 1].sum() - f[r + 1 :, r:].sum() + 0.0
        whole = np.abs(f).sum() - abs(own)
        roundness = 2 * -quarters / whole if whole else 0.0
        if sharp[0] <= sharpness <= sharp[1] and round_[0] <= roundness <= round_[1]:
            out.append((y + _vertex(wide[y - 1, x], own, wide[y + 1, x]), x + _vertex(wide[y, x - 1], own, wide[y, x + 1]), float(raw[r, r]), float(own / limit), float(sharpness), float(roundness)))
    return out


def find_spots(pixels: DataFrame, keys: list[str], fwhm: float, sigmas: float, value: str = "value", sharp: tuple[float, float] = (0.2, 1.0), round_: tuple[float, float] = (-0.5, 0.5), least: int = 0, side: int | None = None) -> DataFrame:
    """keys, y, x, peak, flux, mag, sharpness, roundness and idx (0: the brightest of its image) of spots of about fwhm pixels.

    A spot's sum under a Gaussian less its mean is largest among its neighbours and over what `sigmas` deviations of the image's
    clipped pixels would give. Spots nearer to the edge of an image than the kernel's radius are not told. Pixels that are not
    given are the image's median. Images of fewer than `least` spots are left out; images without pixels have none."""
    from pyspark.sql import Window

    side = side or SIDE
    k = kernel(fwhm)
    halo = 2 * k.radius
    stats = clipped_statistics(pixels, keys, value, sigmas + 5)
    edges = pixels.groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    known = stats.join(edges, keys)
    given = blocks(pixels, keys, halo, value, side).join(known, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i] for c in batch.schema.names}
                ys, xs, v = (np.array(one[c].values) for c in ("y", "x", "v"))
                top, left = (one[c].as_py() * side - halo for c in ("by", "bx"))
                median, std = one["median"].as_py(), one["std"].as_py()
                image = np.zeros((side + 2 * halo, side + 2 * halo))
                image[ys - top, xs - left] = v - median
                low_y, low_x = max(halo, one["y0"].as_py() + k.radius - top), max(halo, one["x0"].as_py() + k.radius - left)
                high_y, high_x = min(halo + side, one["y1"].as_py() - k.radius + 1 - top), min(halo + side, one["x1"].as_py() - k.radius + 1 - left)
                if std <= 0 or low_y >= high_y or low_x >= high_x:
                    continue
                found = find_in_block(image, k, sigmas * std, (slice(low_y, high_y), slice(low_x, high_x)), sharp, round_)
                if found:
                    rows = pa.array(np.full(len(found), i))
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in keys], pa.array([a + top for a in cols[0]]), pa.array([a + left for a in cols[1]]), *[pa.array(c) for c in cols[2:]]], names=[*keys, "y", "x", "peak", "flux", "sharpness", "roundness"])

    kinds = ", ".join(f"`{c}` {pixels.schema[c].dataType.simpleString()}" for c in keys)
    found = given.mapInArrow(run, f"{kinds}, y double, x double, peak double, flux double, sharpness double, roundness double")
    by = Window.partitionBy(*keys)
    ranked = found.withColumn("mag", -2.5 * F.log10("flux")).withColumn("idx", F.row_number().over(by.orderBy(F.col("flux").desc(), "y", "x")) - 1)
    return ranked.withColumn("_n", F.count("*").over(by)).where(F.col("_n") >= least).drop("_n") if least else ranked


def shift_of(a: np.ndarray, b: np.ndarray, fine: int = 100) -> tuple[float, float]:
    """(dy, dx) by which b, moved round, matches a best: the peak of the cross correlation of phases, then of its values on a grid of
    1 / fine pixels around it, by a product of matrices."""
    fa, fb = np.fft.fft2(a), np.fft.fft2(b)
    cross = fa * np.conj(fb)
    cross /= np.maximum(np.abs(cross), 100 * np.finfo(float).eps)
    at = np.unravel_index(np.argmax(np.abs(np.fft.ifft2(cross))), a.shape)
    shift = np.array([p - n if p > n // 2 else p for p, n in zip(at, a.shape)], float)
    if fine > 1:
        reach = np.ceil(fine * 1.5)
        grid = (np.arange(reach) - reach // 2) / fine
        waves = [np.exp(2j * np.pi * np.outer(s + grid, np.fft.fftfreq(n))) for s, n in zip(shift, a.shape)]
        peak = np.unravel_index(np.argmax(np.abs(waves[0] @ cross @ waves[1].T)), (len(grid), len(grid)))
        shift = np.round((shift + grid[list(peak)]) * fine) / fine
    return float(shift[0]), float(shift[1])


def phase_shifts(reference: DataFrame, moved: DataFrame, keys: list[str], value: str = "value", fine: int = 100) -> DataFrame:
    """keys, dy, dx: for each key with pixels in both tables the shift that moves `moved` onto `reference`. A task holds one pair
    of images, a camera's frames; pixels not given are 0, and both are as large as the larger."""
    kinds = ", ".join(f"`{c}` {reference.schema[c].dataType.simpleString()}" for c in keys)
    own = [df.where("y is not null and x is not null").select(*keys, F.col("y").cast("int"), F.col("x").cast("int"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")) for df in (reference, moved)]

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        names = [*keys, "dy", "dx"]
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, [*(a.schema.field(c).type for c in keys), pa.float64(), pa.float64()])})
        places = [tuple(t.column(c).to_numpy() for c in ("y", "x")) for t in (a, b)]
        low = [min(p[i].min() for p in places) for i in (0, 1)]
        size = [max(p[i].max() for p in places) - low[i] + 1 for i in (0, 1)]
        images = []
        for t, (y, x) in zip((a, b), places):
            images.append(np.zeros(size))
            images[-1][y - low[0], x - low[1]] = t.column("v").to_numpy()
        return pa.table([*[pa.array([k.as_py()], a.schema.field(c).type) for k, c in zip(key, keys)], *[pa.array([s]) for s in shift_of(*images, fine)]], names=names)

    return own[0].groupBy(*keys).cogroup(own[1].groupBy(*keys)).applyInArrow(run, f"{kinds}, dy double, dx double")
