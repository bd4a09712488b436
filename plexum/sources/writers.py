"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write, or leave what is there unless overwrite is asked for."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def delimited(df: DataFrame, path: str, sep: str = ",", overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "ignore").option("header", "true").option("sep", sep).csv(path)


def fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq))).write.mode("overwrite").text(path)


def fastq(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(F.concat(F.lit("@"), F.col(name), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(seq)))).write.mode("overwrite").text(path)


def tile_list(df: DataFrame, path: str) -> None:
    """Lines of a tile list by index; it is small and goes to one file."""
    line = F.format_string("%04d.tif; ; (%s, %s)", "index", F.col("x").cast("double").cast("string"), F.col("y").cast("double").cast("string"))
    df.orderBy("index").select(line).coalesce(1).write.mode("overwrite").text(path)


def statistics(df: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    df.write.mode("overwrite").json(path)
