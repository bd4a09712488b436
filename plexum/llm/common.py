"""What several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="plexum-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there.

    Spark deletes shuffles that no plan refers to, but learns of them only when the driver's memory is collected, which may be
    long after; so it is collected here, and what earlier cuts have made useless is off the disks before more is written."""
    shared_dir(df.sparkSession)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


#: Rows that Spark hands to a Python worker at once; texts are long, and the default of 10 000 of them fills a worker.
BATCH_ROWS = 2_000


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers in batches of at most BATCH_ROWS, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory back to the system: idle workers live on beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches again, in pieces of about `limit` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(size):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n) + 64
        yield batch.slice(start)
    release()


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch with columns appended; an added name replaces the batch's own, whatever its case."""
    taken = {k.lower() for k in added}
    kept = [(f.name, c) for f, c in zip(batch.schema, batch.columns) if f.name.lower() not in taken]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(added.values()), names=[n for n, _ in kept] + list(added))


def schema_with(df: DataFrame, added: str) -> StructType:
    """df's schema with the fields of a DDL string, in the order of with_columns; what runs next gets bounded batches."""
    bound_batches(df.sparkSession)
    new = StructType.fromDDL(added).fields
    taken = {f.name.lower() for f in new}
    return StructType([f for f in df.schema if f.name.lower() not in taken] + new)


#: Bits of a sketch of keys.
SKETCH_BITS = 1 << 25


def _bits(keys: np.ndarray) -> np.ndarray:
    """Where keys stand in a sketch: a column each."""
    x = keys.astype(np.int64).view(np.uint64)
    out = []
    for seed in (1, 2, 3):
        h = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xC4CEB9FE1A85EC53)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
        out.append((h ^ (h >> np.uint64(33))) % np.uint64(SKETCH_BITS))
    return np.stack(out)


def sketch(keys: DataFrame, column: str = "key") -> np.ndarray:
    """A Bloom filter of a column of longs. Its size is fixed: with ever more keys it lets more pass, and in the end all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bits(batch.column(column).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "mask"])

    words = keys.select(column).mapInArrow(run, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(SKETCH_BITS // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def in_sketch(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bits(keys)
    return ((held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)
