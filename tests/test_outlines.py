"""Rings rebuild the pixels they were drawn around."""

import numpy as np
from plexum.operators import outlines


def inside(rings, shape):
    """Pixels whose centre an odd number of edges lies left of."""
    out = np.zeros(shape, int)
    for ring in rings:
        for (y, x), (b, _) in zip(ring, ring[1:] + ring[:1]):
            for row in range(min(y, b), max(y, b)):
                out[row, x:] += 1
    return out % 2 == 1


def parts_of(mask):
    """Parts of a mask that share sides, and holes: parts of the ground that do not reach the edge, corners counting there."""
    def count(m, near, border):
        seen, n = np.zeros(m.shape, bool), 0
        for start in zip(*np.nonzero(m)):
            if seen[start]:
                continue
            stack, edge = [start], False
            seen[start] = True
            while stack:
                y, x = stack.pop()
                edge |= y in (0, m.shape[0] - 1) or x in (0, m.shape[1] - 1)
                for dy, dx in near:
                    at = (y + dy, x + dx)
                    if 0 <= at[0] < m.shape[0] and 0 <= at[1] < m.shape[1] and m[at] and not seen[at]:
                        seen[at] = True
                        stack.append(at)
            n += not (border and edge)
        return n

    sides = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    return count(mask, sides, False), count(~np.pad(mask, 1), [*sides, (1, 1), (1, -1), (-1, 1), (-1, -1)], True)


def test_rings_rebuild_pixels(spark):
    rng = np.random.default_rng(7)
    masks = {("r", 1): rng.random((14, 17)) < 0.6, ("r", 2): None, ("s", 1): rng.random((12, 12)) < 0.4}
    masks["r", 2] = ~masks["r", 1] & (rng.random((14, 17)) < 0.7)
    spiral = np.zeros((33, 33), bool)
    y = x = 0
    for k, n in enumerate(range(32, 1, -2)):  # one long ring
        for dy, dx in ((0, 1), (1, 0)) if k % 2 == 0 else ((0, -1), (-1, 0)):
            for _ in range(n):
                spiral[y, x] = True
                y, x = y + dy, x + dx
    masks["t", 5] = spiral
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    masks["u", 9] = ring
    rows = [(k, label, int(y), int(x)) for (k, label), m in masks.items() for y, x in zip(*np.nonzero(m))]
    df = spark.createDataFrame([*rows, rows[0], ("r", 0, 3, 3), ("r", 1, None, 3)], "tile string, label int, y int, x int")
    got = {}
    for r in sorted(outlines.outlines(df, ["tile"]).collect(), key=lambda r: (r.ring, r.position)):
        got.setdefault((r.tile, r.label), {}).setdefault((r.ring, r.hole), []).append((r.position, r.y, r.x))
    assert got.keys() == masks.keys()
    for key, mask in masks.items():
        rings = got[key]
        assert all([p for p, _, _ in v] == list(range(len(v))) for v in rings.values())
        corners = {k: [(y, x) for _, y, x in v] for k, v in rings.items()}
        assert (inside(list(corners.values()), mask.shape) == mask).all()
        assert parts_of(mask) == (sum(not h for _, h in corners), sum(h for _, h in corners))
        for v in corners.values():  # every corner turns, and edges run along lines
            for a, b, c in zip(v, v[1:] + v[:1], v[2:] + v[:2]):
                assert (a[0] == b[0]) != (a[1] == b[1]) and (a[0] == b[0]) == (b[1] == c[1])
    square = got["u", 9]
    assert square["0,0,0", False] == [(0, 0, 0), (1, 0, 5), (2, 5, 5), (3, 5, 0)] and len(next(v for (_, h), v in square.items() if h)) == 4
    assert outlines.outlines(df.limit(0), ["tile"]).count() == 0
