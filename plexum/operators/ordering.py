"""Operators on a total order of rows, without a task that holds all of them.

Rows are dealt to ranges of the first order column by fixed cuts; each range is numbered alone, and what stands before it is
added. Cuts are numbers on the driver, as many as shuffle partitions, so that every evaluation deals alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """df with _b, the range of a numeric column that each row is in; nulls come first."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = df.agg(F.percentile_approx(key, shares, F.lit(10 * parts))).first()[0] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast(f"array<{df.schema[key].dataType.simpleString()}>")
    return df.withColumn("_b", F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(edges, lambda c: c <= F.col(key)))))


def running_sum(df: DataFrame, key: str, value: Column, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """df with the sum of value over all rows up to this one, in order of key, then ties; together they tell rows apart."""
    dealt = dealt_by(df.withColumn("_v", value), key)
    totals = dealt.groupBy("_b").agg(F.sum("_v").alias("_t"))  # a row for each range
    before = totals.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy("_b").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(before), "_b").withColumn(name, F.col("_before") + inside).drop("_b", "_v", "_before")


def row_index(df: DataFrame, key: str, ties: Sequence[str] = (), name: str = "index") -> DataFrame:
    """df numbered from 0 in order of key, then ties."""
    return running_sum(df, key, F.lit(1).cast("long"), name, ties).withColumn(name, F.col(name) - 1)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to as many tasks as keep all cores busy, before work in Python: a small file of many rows is one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def every_nth(df: DataFrame, n: int, key: str, ties: Sequence[str] = ()) -> DataFrame:
    """The first row in order and every n-th after it."""
    return row_index(df, key, ties, "_i").where(F.pmod("_i", F.lit(n)) == 0).drop("_i")


def side_by_side(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of equal position beside each other; the shorter side is filled with nulls. Column names must differ."""
    return row_index(left, left_key, name="index").join(row_index(right, right_key, name="index"), "index", "full")


def natural_key(name: Column) -> list[Column]:
    """Sort keys by which names that begin with a number come first, by number, then the others by name."""
    number = F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit("")).try_cast("long")
    return [number.asc_nulls_last(), name]
