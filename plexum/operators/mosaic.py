"""Mosaics: which tiles overlap, how far pairs of them are off, the places that fit all pairs best, and one image of all tiles.

Tiles are rows (tile, y, x, h, w), their place and size; pixels are rows (tile, y, x, value), counted from their tile's corner."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.operators.spatial import kept
from plexum.operators.spots import shift_of


def overlaps(tiles: DataFrame, least: int = 1) -> DataFrame:
    """a, b (a < b) and the window that both cover, y0, x0, y1, x1 (ends excluded), at least `least` wide and high. Tiles meet by
    cells as large as the largest of them, so each is compared with those around it alone."""
    size = tiles.agg(F.max("h"), F.max("w")).first()
    if size[0] is None:
        size = (1, 1)
    cell = lambda a, n: F.sequence(F.floor(F.col(a) / n), F.floor((F.col(a) + F.col("h" if a == "y" else "w") - 1) / n))
    dealt = tiles.where("tile is not null and y is not null and x is not null").withColumn("cy", F.explode(cell("y", size[0]))).withColumn("cx", F.explode(cell("x", size[1])))
    side = lambda n: dealt.select("cy", "cx", F.col("tile").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("y", "x", "h", "w")])
    met = side("a").join(side("b"), ["cy", "cx"]).where("a < b")
    window = {"y0": F.greatest("a_y", "b_y"), "x0": F.greatest("a_x", "b_x"), "y1": F.least(F.col("a_y") + F.col("a_h"), F.col("b_y") + F.col("b_h")), "x1": F.least(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w"))}
    found = met.select("a", "b", *[v.alias(k) for k, v in window.items()])
    return found.where((F.col("y1") - F.col("y0") >= least) & (F.col("x1") - F.col("x0") >= least)).distinct()


def pair_shifts(pixels: DataFrame, tiles: DataFrame, least: int = 4, fine: int = 100, correlation: float = 0.5) -> DataFrame:
    """a, b, dy, dx, r: how far b lies from a, by its place and by what both show where they overlap; r is the correlation there
    once b is moved, and pairs below `correlation` are left out. A task holds the overlap of one pair."""
    at = tiles.select("tile", F.floor("y").cast("long").alias("ty"), F.floor("x").cast("long").alias("tx"), "h", "w")
    pairs = overlaps(at.select("tile", F.col("ty").alias("y"), F.col("tx").alias("x"), "h", "w"), least)
    own = pixels.where("y is not null and x is not null").select("tile", F.col("y").cast("long").alias("py"), F.col("x").cast("long").alias("px"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v"))

    def cut(side: str) -> DataFrame:
        seen = own.join(at, "tile").select(F.col("tile").alias(side), (F.col("ty") + F.col("py")).alias("y"), (F.col("tx") + F.col("px")).alias("x"), "v")
        return pairs.join(seen, side).where("y >= y0 and y < y1 and x >= x0 and x < x1").select(F.col("a").alias("a"), F.col("b").alias("b"), (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), (F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w"), F.col("v").alias("v"))

    kind = tiles.schema["tile"].dataType.simpleString()

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        names, rows = ["a", "b", "dy", "dx", "r"], []
        kinds = [(a if a.num_rows else b).schema.field("a").type] * 2 + [pa.float64()] * 3
        if a.num_rows and b.num_rows:
            images = []
            for t in (a, b):
                images.append(np.zeros((t.column("h")[0].as_py(), t.column("w")[0].as_py())))
                images[-1][t.column("y").to_numpy(), t.column("x").to_numpy()] = t.column("v").to_numpy()
            dy, dx = shift_of(*images, fine)
            iy, ix = round(dy), round(dx)
            h, w = images[0].shape
            one = images[0][max(iy, 0) : h + min(iy, 0), max(ix, 0) : w + min(ix, 0)].ravel()
            two = images[1][max(-iy, 0) : h + min(-iy, 0), max(-ix, 0) : w + min(-ix, 0)].ravel()
            r = float(np.corrcoef(one, two)[0, 1]) if len(one) > 1 and one.std() and two.std() else 0.0
            rows = [(*[k.as_py() for k in key], dy, dx, r)]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], names=names)

    found = cut("a").groupBy("a", "b").cogroup(cut("b").groupBy("a", "b")).applyInArrow(run, f"a {kind}, b {kind}, dy double, dx double, r double").where(F.col("r") >= correlation)
    nominal = lambda side: tiles.select(F.col("tile").alias(side), F.floor("y").alias(f"y_{side}"), F.floor("x").alias(f"x_{side}"))
    return found.join(nominal("a"), "a").join(nominal("b"), "b").select("a", "b", (F.col("y_b") - F.col("y_a") + F.col("dy")).alias("dy"), (F.col("x_b") - F.col("x_a") + F.col("dx")).alias("dx"), "r")


def _solved(tiles: DataFrame, links: DataFrame, most: int, settled: float) -> DataFrame:
    """tile, y, x of least squares, by conjugate gradients: a round is a join of links with places and sums by tile and over all."""
    ways = kept(links.select(F.col("a").alias("i"), F.col("b").alias("j"), (-F.col("dy")).alias("y"), (-F.col("dx")).alias("x"), "r").unionByName(links.select(F.col("b").alias("i"), F.col("a").alias("j"), F.col("dy").alias("y"), F.col("dx").alias("x"), "r")))

    def applied(of: DataFrame, y: str, x: str) -> DataFrame:
        here, there = of.select(F.col("tile").alias("i"), F.col(y).alias("yi"), F.col(x).alias("xi")), of.select(F.col("tile").alias("j"), F.col(y).alias("yj"), F.col(x).alias("xj"))
        return ways.join(here, "i").join(there, "j").groupBy(F.col("i").alias("tile")).agg(F.sum(F.col("r") * (F.col("yi") - F.col("yj"))).alias("ay"), F.sum(F.col("r") * (F.col("xi") - F.col("xj"))).alias("ax"))

    wanted = ways.groupBy(F.col("i").alias("tile")).agg(F.sum(F.col("r") * F.col("y")).alias("by"), F.sum(F.col("r") * F.col("x")).alias("bx"))
    start = tiles.select("tile", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    first = start.join(applied(start, "y", "x"), "tile", "left").join(wanted, "tile", "left").na.fill(0.0)
    state = kept(first.select("tile", "y", "x", (F.col("by") - F.col("ay")).alias("ry"), (F.col("bx") - F.col("ax")).alias("rx")).withColumns({"py": F.col("ry"), "px": F.col("rx")}))
    power = lambda df: [s or 0.0 for s in df.agg(F.sum(F.col("ry") * F.col("ry")), F.sum(F.col("rx") * F.col("rx"))).first()]
    rr = power(state)
    for _ in range(most):
        if max(rr) <= settled**2:
            break
        with_a = kept(state.join(applied(state, "py", "px"), "tile", "left").na.fill(0.0))
        pap = [s or 0.0 for s in with_a.agg(F.sum(F.col("py") * F.col("ay")), F.sum(F.col("px") * F.col("ax"))).first()]
        step = [a / b if b > 0 else 0.0 for a, b in zip(rr, pap)]
        moved = with_a.select("tile", *[(F.col(c) + step[k] * F.col(f"p{c}")).alias(c) for k, c in enumerate("yx")], *[(F.col(f"r{c}") - step[k] * F.col(f"a{c}")).alias(f"r{c}") for k, c in enumerate("yx")], "py", "px")
        moved = kept(moved)
        after = power(moved)
        back = [a / b if b > 0 else 0.0 for a, b in zip(after, rr)]
        state, rr = moved.withColumns({f"p{c}": F.col(f"r{c}") + back[k] * F.col(f"p{c}") for k, c in enumerate("yx")}), after
    return kept(state.select("tile", "y", "x"))


def places(tiles: DataFrame, links: DataFrame, farthest: float = 1.5, rounds: int = 10, most: int = 500, settled: float = 1e-9) -> DataFrame:
    """tile, y, x: the places that fit all links (a, b, dy, dx, r) best, each weighed by r. Links that are further off than `farthest`
    afterwards, and half as far as the worst, go, and places are sought anew, `rounds` times at most. The mean place of tiles that links join stays what it was;
    tiles without links stay where they were."""
    own = kept(links.where("a <> b and r > 0").select("a", "b", "dy", "dx", "r"))
    for k in range(rounds):
        found = _solved(tiles, own, most, settled)
        if k == rounds - 1:
            break
        end = lambda n: found.select(F.col("tile").alias(n), F.col("y").alias(f"{n}_y"), F.col("x").alias(f"{n}_x"))
        off = F.hypot(F.col("b_y") - F.col("a_y") - F.col("dy"), F.col("b_x") - F.col("a_x") - F.col("dx"))
        judged = kept(own.join(end("a"), "a").join(end("b"), "b").select("a", "b", "dy", "dx", "r", off.alias("off")))
        worst = judged.agg(F.max("off")).first()[0] or 0.0
        if worst <= farthest:
            break
        own = kept(judged.where(F.col("off") <= max(farthest, worst / 2)).drop("off"))
    return found


def fuse(pixels: DataFrame, tiles: DataFrame, subpixel: bool = True) -> DataFrame:
    """y, x, value: pixels of all tiles (tile, y, x, h, w) on one grid. Where tiles overlap each counts by how far its pixel lies
    from the tile's nearest edge; off the grid a pixel is shared among the four around it. Sums are made before they are
    shuffled, and a place takes as many values as tiles cover it."""
    at = tiles.select("tile", F.col("y").cast("double").alias("ty"), F.col("x").cast("double").alias("tx"), "h", "w")
    own = pixels.where("y is not null and x is not null and value is not null").select("tile", F.col("y").alias("py"), F.col("x").alias("px"), F.col("value").cast("double").alias("v")).join(at, "tile")
    edge = F.least(F.col("py") + 1, F.col("px") + 1, F.col("h") - F.col("py"), F.col("w") - F.col("px")).cast("double")
    gy, gx = F.col("ty") + F.col("py"), F.col("tx") + F.col("px")
    if not subpixel:
        return _blended(own.select(F.round(gy).cast("long").alias("y"), F.round(gx).cast("long").alias("x"), "v", edge.alias("w")))
    low_y, low_x = F.floor(gy), F.floor(gx)
    fy, fx = gy - low_y, gx - low_x
    four = F.explode(F.array(*[F.struct((low_y + i).alias("y"), (low_x + j).alias("x"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("part")) for i in (0, 1) for j in (0, 1)]))
    return _blended(own.select("v", edge.alias("edge"), four.alias("s")).where("s.part > 1e-9").select("s.y", "s.x", "v", (F.col("edge") * F.col("s.part")).alias("w")))


def _blended(rows: DataFrame) -> DataFrame:
    return rows.groupBy("y", "x").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("value"))
