"""A planted field comes out of images with cells and spots in them."""

import numpy as np
from plexum.operators import fields


def test_planted_field(spark):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:48, :64]
    planted = 1.2 - 0.5 * ((y - 20) / 48) ** 2 - 0.6 * ((x - 36) / 64) ** 2
    rows = []
    for i in range(14):
        image = planted * rng.uniform(80, 300) * (1 + rng.normal(0, 0.02, planted.shape))
        for _ in range(3):  # a cell, much brighter than the ground
            a, b = rng.integers(0, 40), rng.integers(0, 52)
            image[a : a + 8, b : b + 12] *= rng.uniform(1.5, 4)
        rows += [(i, int(p), int(q), float(v)) for (p, q), v in np.ndenumerate(image)]
    df = spark.createDataFrame([*rows, (None, 1, 1, 9.0), (3, None, 1, 9.0), (3, 1, 1, None)], "image int, y int, x int, value double")
    got = np.ones((16, 16))
    for r in fields.fit_field(df, "image", 48, 64, size=16, order=4).collect():
        got[r.y, r.x] = r.flat
    want = planted.reshape(16, 3, 16, 4).mean(axis=(1, 3))
    want /= want.mean()
    assert np.abs(got / want - 1).max() < 0.06 and np.abs(got / want - 1).mean() < 0.015 and abs(got.mean() - 1) < 1e-9
    plain = df.groupBy("y", "x").avg("value").toPandas()
    mean = np.ones((48, 64))
    ok = plain.dropna().astype(int)
    mean[ok["y"], ok["x"]] = plain.dropna()["avg(value)"]
    naive = mean.reshape(16, 3, 16, 4).mean(axis=(1, 3))
    assert np.abs(got / want - 1).mean() < 0.5 * np.abs(naive / naive.mean() / want - 1).mean()  # cells would have shown in a mean
    assert all(abs(r.flat - 1) < 1e-9 for r in fields.fit_field(df.limit(0), "image", 48, 64, size=4).collect())
    dark = fields.fit_field(df.selectExpr("image", "y", "x", "0D as value"), "image", 48, 64, size=4).collect()
    assert len(dark) == 16 and all(abs(r.flat - 1) < 1e-9 for r in dark)
