"""A planted mosaic is put together again."""

import numpy as np
import pytest

from plexum.operators import mosaic

TRUE = {"t0": (0, 0), "t1": (2, 24), "t2": (-1, 49), "t3": (23, 1), "t4": (26, 25), "t5": (24, 50)}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(8)
    scene = rng.integers(0, 1000, (80, 110))
    cut = {t: scene[y + 5 : y + 45, x + 5 : x + 45] for t, (y, x) in TRUE.items()}
    rows = [(t, y, x, int(v)) for t, image in cut.items() for (y, x), v in np.ndenumerate(image)]
    nominal = {t: (y + int(dy), x + int(dx)) for (t, (y, x)), (dy, dx) in zip(TRUE.items(), rng.integers(-2, 3, (6, 2)))}
    pixels = spark.createDataFrame(rows, "tile string, y int, x int, value int")
    tiles = spark.createDataFrame([(t, float(y), float(x), 40, 40) for t, (y, x) in nominal.items()], "tile string, y double, x double, h int, w int")
    return scene, pixels, tiles


def relative(rows):
    return {t: (y - rows["t0"][0], x - rows["t0"][1]) for t, (y, x) in rows.items()}


def test_places_and_fusing(spark, planted):
    scene, pixels, tiles = planted
    links = mosaic.pair_shifts(pixels, tiles, least=8, fine=1)
    got = {(r.a, r.b): (r.dy, r.dx) for r in links.collect()}
    assert len(got) >= 7 and all(d == tuple(np.subtract(TRUE[b], TRUE[a])) for (a, b), d in got.items())
    # a link that is wrong is found out by the others
    wrong = links.unionByName(spark.createDataFrame([("t0", "t5", 50.0, 90.0, 0.2)], "a string, b string, dy double, dx double, r double"))
    found = mosaic.places(tiles, wrong)
    own = {r.tile: (r.y, r.x) for r in found.collect()}
    for t, place in relative(own).items():
        assert place == pytest.approx(TRUE[t], abs=1e-6)
    at = own["t0"]
    shifted = spark.createDataFrame([(t, y - at[0], x - at[1], 40, 40) for t, (y, x) in own.items()], "tile string, y double, x double, h int, w int")
    for way in (True, False):
        image = {(r.y, r.x): r["value"] for r in mosaic.fuse(pixels, shifted, way).collect()}
        assert all(v == pytest.approx(scene[y + 5, x + 5], abs=1e-3) for (y, x), v in image.items() if not way or (y, x) in image) and len(image) >= 4500


def test_weights_sum_to_one(spark):
    """Between tiles of constant value the image runs from one to the other, and never beyond."""
    rows = [(t, y, x, v) for t, v in (("a", 10), ("b", 20)) for y in range(8) for x in range(8)]
    pixels = spark.createDataFrame(rows, "tile string, y int, x int, value int")
    tiles = spark.createDataFrame([("a", 0.0, 0.0, 8, 8), ("b", 0.0, 4.5, 8, 8), ("c", 0.0, 0.0, 8, 8)], "tile string, y double, x double, h int, w int")
    image = {(r.y, r.x): r["value"] for r in mosaic.fuse(pixels, tiles).collect()}
    row = [image[4, x] for x in range(12)]
    assert row[:4] == pytest.approx([10] * 4) and row[9:] == pytest.approx([20] * 3) and row == sorted(row)
    assert mosaic.fuse(pixels.limit(0), tiles).count() == 0 and mosaic.overlaps(tiles.limit(0)).count() == 0
    assert {(r.a, r.b) for r in mosaic.overlaps(tiles).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    still = {r.tile: (r.y, r.x) for r in mosaic.places(tiles, spark.createDataFrame([], "a string, b string, dy double, dx double, r double")).collect()}
    assert still == {"a": (0, 0), "b": (0, 4.5), "c": (0, 0)}
