"""Outlines of labelled regions: rings of corners, in order, around every part of a label and around its holes.

Each pixel has four directed sides with the region on their right; sides of two pixels of one label cancel. What is left runs along
lines, and a run of sides becomes one edge from corner to corner. Edges follow each other as a ring; where two parts of a label
touch at a corner an edge turns right, so parts that share no side have rings of their own. A ring's edges are put in order by
pointer doubling: in each round an edge learns what lies twice as far ahead. So no ring, however long, stands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexum.operators.spatial import kept

#: The four directions in clockwise order, as steps of y and x.
STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))


def edges(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, d (direction), y, x, y1, x1: straight edges around pixels (keys, label, y, x), label 0 left out."""
    own = pixels.where("label <> 0 and y is not null and x is not null").select(*keys, "label", F.col("y").cast("long"), F.col("x").cast("long")).distinct()
    # a pixel's sides: along its top to the right, down its right, along its bottom to the left, up its left
    corner = ((0, 0), (0, 1), (1, 1), (1, 0))
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for d, (dy, dx) in enumerate(corner)]))
    side = own.select(*keys, "label", sides.alias("s")).select(*keys, "label", "s.d", "s.y", "s.x")
    # the two ends without their order: the same for two pixels that share a side
    upright = F.col("d") % 2
    low_y = F.when(F.col("d") == 3, F.col("y") - 1).otherwise(F.col("y"))
    low_x = F.when(F.col("d") == 2, F.col("x") - 1).otherwise(F.col("x"))
    free = side.groupBy(*keys, "label", upright.alias("_u"), low_y.alias("_y"), low_x.alias("_x")).agg(F.count("*").alias("_n"), F.first("d").alias("d"), F.first("y").alias("y"), F.first("x").alias("x")).where("_n = 1")
    along, line = F.when(F.col("_u") == 0, F.col("_x")).otherwise(F.col("_y")), F.when(F.col("_u") == 0, F.col("_y")).otherwise(F.col("_x"))
    placed = free.withColumns({"_a": along, "_l": line})
    run = F.col("_a") - F.row_number().over(Window.partitionBy(*keys, "label", "d", "_l").orderBy("_a"))
    runs = placed.withColumn("_r", run).groupBy(*keys, "label", "d", "_l", "_r").agg(F.min("_a").alias("low"), (F.max("_a") + 1).alias("high"))
    first, last = F.when(F.col("d") < 2, F.col("low")).otherwise(F.col("high")), F.when(F.col("d") < 2, F.col("high")).otherwise(F.col("low"))
    flat = F.col("d") % 2 == 0
    at = {"y": F.when(flat, F.col("_l")).otherwise(first), "x": F.when(flat, first).otherwise(F.col("_l")), "y1": F.when(flat, F.col("_l")).otherwise(last), "x1": F.when(flat, last).otherwise(F.col("_l"))}
    return runs.select(*keys, "label", "d", *[v.alias(k) for k, v in at.items()])


def outlines(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, ring, position, y, x, hole: the corners of each ring, from its first corner in reading order on, clockwise
    around a part and the other way around a hole. A ring is named by its first corner, as text: y,x,direction.

    Repeated pixels count once, label 0 and null places are left out; an empty table gives no rows."""
    found = edges(pixels, keys)
    place = lambda y, x: F.struct(*keys, "label", F.col(y).alias("y"), F.col(x).alias("x"))
    own = kept(found.withColumns({"id": F.struct(*keys, "label", "y", "x", "d"), "end": place("y1", "x1")}))
    starts = own.select(place("y", "x").alias("end"), F.col("id").alias("to"), F.col("d").alias("to_d"))
    right = F.when(F.col("to_d") == (F.col("d") + 1) % 4, 0).otherwise(1)
    after = own.join(starts, "end").groupBy("id").agg(F.min_by("to", right).alias("next"))
    first = kept(after.withColumn("least", F.least("id", "next")))
    step = first
    while True:  # the least edge of each ring
        ahead = step.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("least").alias("far"))
        new = kept(step.join(ahead, "next").select("id", F.col("then").alias("next"), F.least("least", "far").alias("least"), (F.col("far") < F.col("least")).alias("moved")))
        step = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    ring = step.select("id", F.col("least").alias("ring"))
    # how many edges lie between an edge and the end of its ring, which is where the least one comes next
    told = kept(first.select("id", "next").join(ring, "id").withColumns({"next": F.when(F.col("next") != F.col("ring"), F.col("next")), "left": F.lit(1).cast("long")}))
    while not told.where("next is not null").isEmpty():
        ahead = told.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
        told = kept(told.join(ahead, "next", "left").select("id", "ring", F.col("then").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    of = told.groupBy("ring").agg(F.count("*").alias("n"))
    rows = own.select("id", "d", "y", "x", "y1", "x1").join(told.select("id", "ring", "left"), "id")
    # twice the area that a ring turns around, negative for holes
    turn = rows.groupBy("ring").agg(F.sum(F.col("x") * F.col("y1") - F.col("x1") * F.col("y")).alias("area"))
    name = F.concat_ws(",", "ring.y", "ring.x", "ring.d")
    return rows.join(of, "ring").join(turn, "ring").select(*[F.col(f"ring.{k}").alias(k) for k in keys], F.col("ring.label").alias("label"), name.alias("ring"), (F.col("n") - F.col("left")).alias("position"), "y", "x", (F.col("area") < 0).alias("hole"))
