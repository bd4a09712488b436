"""Connected components by alternating large and small stars, in DataFrame operations only.

Defined cases: edges may repeat, in either direction; an edge of a node with itself is no edge, and its node has no row; an
edge with a null end is left out; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import cut


def _toward(pairs: DataFrame, keep_self: bool) -> DataFrame:
    """pairs (u, v): each v joined to the least of u and all its v, as (a, b) with a > b."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    near = pairs.join(least, F.col("u") == F.col("w"))
    out = near.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if keep_self:
        out = out.unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    else:
        out = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")).first()
    return r.n, r.x, r.y


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). node and component (the least node it reaches), for every node of an edge between two nodes.

    No task gathers a node's neighbours: the least is aggregated before the shuffle, and Spark can split a skewed join."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = _state(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _toward(both, False)
        now = cut(_toward(large.select(F.col("a").alias("u"), F.col("b").alias("v")), True))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
