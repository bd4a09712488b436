"""Spatial joins as equi-joins on grid cells, and interval operators.

A shape is entered in every cell that it overlaps, so that an equi-join on the cell finds all pairs; a pair that meets in
several cells counts only in the one that holds its lower corner, so that no distinct is needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexum.operators.ordering import row_index


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def _cells(df: DataFrame, size: float) -> DataFrame:
    span = lambda a, b: F.explode(F.sequence(_cell(F.col(a), size), _cell(F.col(b), size)))
    return df.withColumn("_cx", span("x0", "x1")).withColumn("_cy", span("y0", "y1"))


def box_overlaps(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Boxes (id, x0, y0, x1, y1) that touch or overlap: left_id, right_id."""
    a, b = _cells(left, size).alias("a"), _cells(right, size).alias("b")
    meet = (F.col("a.x0") <= F.col("b.x1")) & (F.col("a.x1") >= F.col("b.x0")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("a.y1") >= F.col("b.y0"))
    home = (F.col("a._cx") == _cell(F.greatest("a.x0", "b.x0"), size)) & (F.col("a._cy") == _cell(F.greatest("a.y0", "b.y0"), size))
    on = (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
    return a.join(b, on & meet & home).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))


def exclusive(points: DataFrame, boxes: DataFrame, size: float, later_wins: bool = False) -> DataFrame:
    """Points (tile, x, y, ...) strictly inside the area that is their tile's own: its box less all boxes of lower id, or of
    higher id if the later tile wins."""
    cells = _cells(boxes, size).alias("b")
    p = points.withColumns({"_pid": F.struct(*[F.col(c) for c in points.columns]), "_cx": _cell(F.col("x"), size), "_cy": _cell(F.col("y"), size)}).alias("p")
    mine = p.join(boxes.select(F.col("id").alias("tile"), "x0", "y0", "x1", "y1").alias("m"), "tile").where("x > x0 and x < x1 and y > y0 and y < y1").select("p.*").alias("p")
    taken = (F.col("p._cx") == F.col("b._cx")) & (F.col("p._cy") == F.col("b._cy")) & (F.col("b.id") > F.col("p.tile") if later_wins else F.col("b.id") < F.col("p.tile")) & F.expr("p.x >= b.x0 and p.x <= b.x1 and p.y >= b.y0 and p.y <= b.y1")
    return mine.join(cells, taken, "left_anti").select(points.columns)


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of x, y) or on its edge: crossings of a ray, and a test of each edge."""
    n = F.size(ring)
    ends = F.transform(ring, lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.get(ring, F.pmod(i + 1, n))["x"].alias("x1"), F.get(ring, F.pmod(i + 1, n))["y"].alias("y1")))
    side = lambda e: (e["x1"] - e["x0"]) * (y - e["y0"]) - (x - e["x0"]) * (e["y1"] - e["y0"])
    on_edge = F.exists(ends, lambda e: (side(e) == 0) & x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"])))
    crossed = F.filter(ends, lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (F.when(e["y1"] > e["y0"], side(e)).otherwise(-side(e)) > 0))
    return on_edge | (F.size(crossed) % 2 == 1)


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """points (x, y, ...) and polygons (label, ring): a row for each point and each polygon it is in or on."""
    boxes = polygons.withColumns({f"{a}{k}": f(F.col(f"ring.{a}")) for a in "xy" for k, f in (("0", F.array_min), ("1", F.array_max))})
    p = points.withColumns({"_cx": _cell(F.col("x"), size), "_cy": _cell(F.col("y"), size)})
    return p.join(_cells(boxes, size), ["_cx", "_cy"]).where(inside(F.col("x"), F.col("y"), F.col("ring"))).select(*points.columns, "label")


def nearest(points: DataFrame, targets: DataFrame, group: str, ties: Sequence[str]) -> DataFrame:
    """For points (id, group, v) the target (target_id, group, v) of the same group with the nearest v, ties by column order.

    One sorted pass over the union: the last target before and the first after each point, by window; no pair is made."""
    both = points.select("id", group, "v", F.lit(None).cast(targets.schema["target_id"].dataType).alias("target_id")).unionByName(targets.groupBy(group, "v").agg(F.min("target_id").alias("target_id")).select(F.lit(None).cast(points.schema["id"].dataType).alias("id"), group, "v", "target_id"))
    held = F.when(F.col("target_id").isNotNull(), F.struct("v", "target_id"))
    w = Window.partitionBy(group).orderBy("v")
    back = Window.partitionBy(group).orderBy(F.col("v").desc())  # what lies ahead is what was passed from the other end
    near = both.withColumns({"_b": F.last(held, True).over(w), "_a": F.last(held, True).over(back)}).where("id is not null")
    d = lambda s: F.abs(F.col("v") - F.col(f"{s}.v"))
    best = F.least(F.when(F.col("_b").isNotNull(), F.struct(d("_b").alias("d"), F.col("_b.target_id").alias("t"))), F.when(F.col("_a").isNotNull(), F.struct(d("_a").alias("d"), F.col("_a.target_id").alias("t"))))
    return near.withColumn("_n", best).select("id", group, F.col("_n.t").alias("target_id"), F.col("_n.d").alias("distance"))


def _finer(targets: DataFrame, group: str, size: float) -> int:
    """Levels below `size`, each a quarter as wide as the one before, until cells are half as wide as targets of the densest group are apart."""
    ends = targets.groupBy(group).agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(f"_{c}") for c in "xy"])
    apart = F.greatest(F.sqrt(F.col("_x") * F.col("_y") / F.col("n")), F.greatest("_x", "_y") / F.col("n"))
    least = ends.agg(F.min(F.when(apart > 0, apart))).first()[0]
    return min(max(math.ceil(math.log(2 * size / least, 4)), 0), 16) if least else 0


def nearest_in_plane(points: DataFrame, targets: DataFrame, group: str, size: float, levels: int = 6) -> DataFrame:
    """(group, id, target_id, distance, dx, dy): for points (group, id, x, y) the nearest target of the same group, ties by id; dx and
    dy lead to the target. Ids are unique in a group; points of groups without targets, and what has no place, are left out.

    Cells are laid out at several levels, each four times as wide as the one before, from `size` on, or from less where targets are
    denser; the last has one cell. A point's level is the first at which its cell or one next to it holds a target. One target
    of each of these cells bounds the distance, and only cells that this bound reaches are joined, at the first level whose cells
    are half as wide as it or more: pairs stay few however dense the targets are."""
    real = lambda df: df.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')" for c in "xy"))
    points = real(points.select(group, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    targets = real(targets.select(group, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    targets = kept(targets.groupBy(group, "x", "y").agg(F.min("id").alias("target_id")))  # of one place the least id alone can be nearest
    first = -_finer(targets, group, size)

    def at(x: Column, level: Column) -> Column:
        return F.when(level < levels, F.floor(x / (F.lit(float(size)) * F.pow(F.lit(4.0), level)))).otherwise(0).cast("long")

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("_l", F.explode(F.sequence(F.lit(first), F.lit(levels))))
        return df.withColumns({"_cx": at(F.col("x"), F.col("_l")), "_cy": at(F.col("y"), F.col("_l"))})

    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    step = F.explode(F.when(F.col("_l") < levels, around).otherwise(F.slice(around, 5, 1))).alias("_s")
    key = [group, "_l", "_cx", "_cy"]
    held = placed(targets).groupBy(*key).agg(F.first("x").alias("_hx"), F.first("y").alias("_hy"))  # any one target of the cell
    near = held.select(group, "_l", "_hx", "_hy", "_cx", "_cy", step).select(group, "_l", (F.col("_cx") + F.col("_s.i")).alias("_cx"), (F.col("_cy") + F.col("_s.j")).alias("_cy"), "_hx", "_hy")
    near = near.groupBy(*key).agg(F.collect_list(F.struct("_hx", "_hy")).alias("_of"))  # nine at most
    bound = F.array_min(F.transform("_of", lambda t: F.hypot(t["_hx"] - F.col("x"), t["_hy"] - F.col("y"))))
    # no less than the distance as it is computed, whichever way its parts are rounded
    reach = (F.min("_d") * (1 + 1e-9) + (F.abs("x") + F.abs("y")) * 1e-12).alias("_d")
    # a file's size does not tell of rows placed at every level: told by it, Spark would send them all through the driver
    asked = placed(points).hint("merge").join(near, key).withColumn("_d", bound).groupBy(group, "id", "x", "y").agg(reach)
    wide = F.greatest(F.ceil(F.log(4.0, F.greatest(F.col("_d"), F.lit(1e-300)) / (2.0 * float(size)))), F.lit(first))
    asked = asked.withColumn("_l", F.least(wide, F.lit(levels)).cast("int"))
    for c in "xy":
        asked = asked.withColumn(f"_c{c}", F.explode(F.sequence(at(F.col(c) - F.col("_d"), F.col("_l")), at(F.col(c) + F.col("_d"), F.col("_l")))))
    there = placed(targets).select(*key, "target_id", F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    pairs = asked.join(there, key).withColumns({"dx": F.col("_tx") - F.col("x"), "dy": F.col("_ty") - F.col("y")})
    pairs = pairs.withColumn("distance", F.hypot("dx", "dy")).where(F.col("distance") <= F.col("_d"))
    best = F.min(F.struct("distance", "target_id", "dx", "dy")).alias("_b")
    return pairs.groupBy(group, "id").agg(best).select(group, "id", "_b.target_id", "_b.distance", "_b.dx", "_b.dy")


def coverage(intervals: DataFrame, group: str) -> DataFrame:
    """Depth of closed integer intervals (group, start, stop) as runs: group, since, until (inclusive), depth."""
    steps = intervals.select(group, F.explode(F.array(F.struct(F.col("start").alias("at_"), F.lit(1).alias("d")), F.struct((F.col("stop") + 1).alias("at_"), F.lit(-1).alias("d")))).alias("s")).groupBy(group, F.col("s.at_").alias("since")).agg(F.sum("s.d").alias("d"))
    w = Window.partitionBy(group).orderBy("since")
    return steps.withColumns({"depth": F.sum("d").over(w), "until": F.lead("since").over(w) - 1}).where("until is not null and depth > 0").select(group, "since", "until", "depth")


def greedy_intervals(intervals: DataFrame, group: str, overlap: int = 0) -> DataFrame:
    """Of intervals (group, id, start, stop) by stop, start and id: take the first, then each that begins more than
    `overlap` past the end of the last one taken. A positive overlap widens the gap, a negative one lets neighbours share."""
    sorted_ = F.array_sort(F.collect_list(F.struct("stop", "start", "id")))
    empty = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<{intervals.schema['id'].dataType.simpleString()}>").alias("ids"))

    def step(acc, x):
        ok = acc["last"].isNull() | (x["start"] - F.lit(overlap) > acc["last"])
        return F.struct(F.when(ok, x["stop"].cast("long")).otherwise(acc["last"]).alias("last"), F.when(ok, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"))

    return intervals.groupBy(group).agg(F.aggregate(sorted_, empty, step, lambda a: a["ids"]).alias("ids")).select(group, F.explode("ids").alias("id"))


def best_intervals(intervals: DataFrame, group: str, overlap: int = 0) -> DataFrame:
    """The heaviest set of intervals (group, id, start, stop, weight) in which each ends before the next one's start plus
    overlap; a positive overlap lets neighbours share. Ties prefer not to take."""
    kinds = {f.name: f.dataType.simpleString() for f in intervals.schema}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["stop", "start", "id"], kind="stable").reset_index(drop=True)
        stop, w = pdf["stop"].to_numpy(), pdf["weight"].to_numpy(float)
        before = np.minimum(np.searchsorted(stop, pdf["start"].to_numpy() + overlap, side="left"), np.arange(len(pdf)))
        best = np.zeros(len(pdf) + 1)
        for j in range(len(pdf)):
            best[j + 1] = max(best[j], w[j] + best[before[j]])
        picked, j = [], len(pdf)
        while j > 0:
            if w[j - 1] + best[before[j - 1]] > best[j - 1]:
                picked.append(j - 1)
                j = before[j - 1]
            else:
                j -= 1
        return pdf.loc[sorted(picked), [group, "id"]]

    return intervals.groupBy(group).applyInPandas(solve, f"{group} {kinds[group]}, id {kinds['id']}")


def grid_components(tiles: DataFrame) -> DataFrame:
    """tiles (id, col, row): the least id that steps to the four neighbours, or a shared place, lead to. Places are joined, each
    by its least id, so a place that many tiles share costs as one. By least labels and pointer jumps; lineage is cut in the
    shared folder every round. Tiles without a place are left out."""
    places = kept(tiles.where("col is not null and row is not null").groupBy("col", "row").agg(F.min("id").alias("id")))
    near = F.explode(F.array(*[F.struct((F.col("col") + dx).alias("col"), (F.col("row") + dy).alias("row")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    edges = places.select(F.col("id").alias("a"), near.alias("n")).join(places.select(F.col("id").alias("b"), "col", "row"), (F.col("n.col") == F.col("col")) & (F.col("n.row") == F.col("row"))).select("a", "b")
    edges = kept(edges)
    label = kept(places.select("id", F.col("id").alias("label")))
    while True:
        least = edges.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("m")).select(F.col("a").alias("id"), "m")
        jump = label.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
        new = kept(least.join(jump, F.col("m") == F.col("_i")).select("id", F.least("m", "_l").alias("label")))
        if new.join(label.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty():
            break
        label = new
    of = places.join(new, "id").select("col", "row", "label")
    return tiles.join(of, ["col", "row"]).select("id", "label")


def need_folder(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="plexum-")
    context.setCheckpointDir(folder)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder. Its lineage ends there, and so do estimates of its size: a checkpoint
    alone keeps these, joins multiply them, and within a dozen rounds of joins their digits fill the driver."""
    need_folder(df)
    done, spark = df.checkpoint(), df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)


def interior(tiles: DataFrame, steps: int) -> DataFrame:
    """Tiles (id, x, y) at least `steps` ranks from every edge of the grid of distinct coordinates."""
    def ranks(axis: str) -> DataFrame:
        values = tiles.select(axis).distinct()
        n = values.agg(F.count("*").alias(f"_n{axis}"))
        return row_index(values, axis, name=f"_r{axis}").join(F.broadcast(n))

    both = tiles.join(ranks("x"), "x").join(ranks("y"), "y")
    ok = lambda a: (F.col(f"_r{a}") >= steps) & (F.col(f"_r{a}") < F.col(f"_n{a}") - steps)
    return both.where(ok("x") & ok("y")).select(tiles.columns)
