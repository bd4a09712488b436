"""Spots of planted images, also on edges of blocks, and shifts of rolled images."""

import numpy as np
import pytest

from plexum.operators import spots


def pixels_of(spark, images):
    rows = [(k, y, x, int(v)) for k, image in images.items() for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "tile string, y int, x int, value int")


def planted(rng, shape, places, fwhm=3.0, tall=3000):
    y, x = np.mgrid[: shape[0], : shape[1]]
    image = rng.normal(500, 12, shape)
    for a, b in places:
        image += tall * np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * (fwhm / 2.3548) ** 2))
    return np.round(image)


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(4)
    places = {"a": [(20.0, 32.0), (31.6, 31.4), (32.0, 70.25), (64.5, 63.5), (50.0, 12.0), (12.3, 88.8)], "b": [(40.2, 40.7)], "none": []}
    return places, {k: planted(rng, (96, 104), p) for k, p in places.items()}


@pytest.mark.parametrize("side", [32, 256])
def test_spots_are_found_once(spark, images, side):
    places, pictures = images
    got = spots.find_spots(pixels_of(spark, pictures), ["tile"], 3.0, 8.0, side=side).collect()
    for tile, want in places.items():
        own = [(r.y, r.x) for r in got if r.tile == tile]
        assert len(own) == len(want), tile
        for place in want:
            assert min(np.hypot(a - place[0], b - place[1]) for a, b in own) < 0.15
    assert sorted(r.idx for r in got if r.tile == "a") == list(range(6))
    assert all(r.mag < 0 and 0.2 <= r.sharpness <= 1 and abs(r.roundness) <= 0.5 for r in got)


def test_blocks_do_not_change_spots(spark, images):
    _, pictures = images
    df = pixels_of(spark, pictures)
    rows = [sorted((r.tile, round(r.y, 9), round(r.x, 9), round(r.flux, 6)) for r in spots.find_spots(df, ["tile"], 3.0, 4.0, side=s).collect()) for s in (16, 40, 256)]
    assert rows[0] == rows[1] == rows[2]


def test_odd_images(spark):
    flat = spark.createDataFrame([("f", y, x, 7) for y in range(30) for x in range(30)] + [("one", 3, 3, 9), ("null", None, 1, 5), ("null", 1, 1, None)], "tile string, y int, x int, value int")
    assert spots.find_spots(flat, ["tile"], 3.0, 5.0).count() == 0 and spots.find_spots(flat.limit(0), ["tile"], 3.0, 5.0).count() == 0
    # two equal peaks that touch count once
    image = np.random.default_rng(1).integers(0, 3, (40, 40))
    image[20, 20] = image[20, 21] = 500
    got = spots.find_spots(pixels_of(spark, {"t": image}), ["tile"], 3.0, 5.0, sharp=(0.0, 2.0), round_=(-2, 2))
    assert got.count() == 1
    assert spots.find_spots(pixels_of(spark, {"t": image}), ["tile"], 3.0, 5.0, sharp=(0.0, 2.0), round_=(-2, 2), least=2).count() == 0
    long = spots.find_spots(pixels_of(spark, {"t": np.where(np.abs(np.subtract.outer(range(40), range(40))) < 1, 900, image)}), ["tile"], 3.0, 5.0)
    assert long.count() == 0  # a line is not round


def test_clipped_statistics(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(90, 111, 999).tolist() + [10_000] * 20 + [0] * 3
    df = spark.createDataFrame([("t", x) for x in v] + [("u", 5), ("t", None)], "tile string, value int")
    x = np.array(v, float)
    for _ in range(5):
        ok = abs(x - np.median(x)) <= 3 * x.std()
        if ok.all():
            break
        x = x[ok]
    got = {r.tile: (r.median, r.std) for r in spots.clipped_statistics(df, ["tile"]).collect()}
    assert got["t"] == pytest.approx((np.median(x), x.std())) and got["u"] == (5, 0)


def test_shift_of_rolled_images(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1000, (48, 40))
    moves = {"p": (5, -7), "q": (0, 0), "r": (-11, 19)}
    a, b = pixels_of(spark, {k: base for k in moves} | {"alone": base[:4]}), pixels_of(spark, {k: np.roll(base, (-dy, -dx), (0, 1)) for k, (dy, dx) in moves.items()})
    assert {r.tile: (r.dy, r.dx) for r in spots.phase_shifts(a, b, ["tile"]).collect()} == moves
    y, x = np.fft.fftfreq(48)[:, None], np.fft.fftfreq(40)[None]
    smooth = np.fft.ifft2(np.fft.fft2(base) * np.exp(-200 * (x * x + y * y))).real
    moved = np.fft.ifft2(np.fft.fft2(smooth) * np.exp(2j * np.pi * (y * 2.37 - x * 1.42))).real
    assert spots.shift_of(smooth, moved) == pytest.approx((2.37, -1.42), abs=0.011)
