"""Connected components of any graph, by least labels and pointer jumps; lineage is cut in the shared folder every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.operators.ordering import row_index
from plexum.operators.spatial import kept


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id) and edges (a, b), in any direction: (id, label), label being the least id that edges lead to."""
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = kept(nodes.select("id").distinct().withColumn("label", F.col("id")))
    while True:
        seen = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("m"))
        least = label.join(seen, F.col("id") == F.col("a"), "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("m"))
        jump = label.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
        new = kept(least.join(jump, F.col("m") == F.col("_i"), "left").select("id", "old", F.least("m", F.coalesce("_l", "m")).alias("label")))
        label = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            return label


def merge_labels(used: DataFrame, faces: DataFrame) -> DataFrame:
    """used (id) labels and faces (a, b), pairs that touch across blocks: (id, merged), merged numbered from 1 by least label."""
    known = faces.join(used.select(F.col("id").alias("a")).distinct(), "a", "left_semi").join(used.select(F.col("id").alias("b")).distinct(), "b", "left_semi")
    found = components(used, known)
    numbers = row_index(found.select("label").distinct(), "label", name="merged").withColumn("merged", F.col("merged") + 1)
    return found.join(numbers, "label").select("id", "merged")


def pixel_components(pixels: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """Pixels (keys..., y, x) of like keys that touch at a side, as spots: keys, label, area, y, x; areas out of bounds go."""
    place = F.struct(*keys, "y", "x")
    at = pixels.select(*keys, "y", "x").distinct().withColumn("id", place)
    near = F.explode(F.array(F.struct((F.col("y") + 1).alias("y"), F.col("x").alias("x")), F.struct(F.col("y").alias("y"), (F.col("x") + 1).alias("x"))))
    steps = at.select("id", *keys, near.alias("n")).select(F.col("id").alias("a"), F.struct(*keys, "n.y", "n.x").alias("b"))
    edges = steps.join(at.select(F.col("id").alias("b")), "b", "left_semi")
    spots = at.join(components(at, edges), "id").groupBy("label").agg(F.count("*").alias("area"), F.avg("y").alias("y"), F.avg("x").alias("x"))
    return spots.where(F.col("area").between(least, most)).select(*[F.col(f"label.{k}").alias(k) for k in keys], "area", "y", "x")
