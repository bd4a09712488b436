"""Outlines in ImageJ's format, alone (.roi) or many in an archive (.zip): read to rows, and rows made to its bytes.

Files come through Spark's own binary reader, so that any store it knows will do, files are dealt to tasks, and columns that are
not asked for are not kept. A file or entry that is no outline gives a row with its fault and nulls else; empty files, which
Spark passes over, give none."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: mark, places of fields in the header, kinds with points of their own, and the flag of fractions.
MARK, HEADER, HEADER2 = b"Iout", 64, 64
KINDS = {0: "polygon", 1: "rectangle", 2: "oval", 3: "line", 4: "freeline", 5: "polyline", 6: "none", 7: "freehand", 8: "traced", 9: "angle", 10: "point"}
WITH_POINTS = {0, 4, 5, 7, 8, 9, 10}
FRACTIONS = 128
VERSION = 228

SCHEMA = "path string, entry string, name string, kind string, position int, z int, top int, left int, bottom int, right int, y array<double>, x array<double>, fault string"


def parse(raw: bytes) -> dict[str, object]:
    """The fields of one outline; ValueError says what is wrong with it. Rectangles have their corners as points."""
    if len(raw) < HEADER or raw[:4] != MARK:
        raise ValueError("no outline")
    kind = raw[6]
    top, left, bottom, right, n = struct.unpack(">4hH", raw[8:18])
    options, position, second = struct.unpack(">h", raw[50:52])[0], *struct.unpack(">2i", raw[56:64])
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    y = x = np.zeros(0)
    if kind in WITH_POINTS:
        end = HEADER + 4 * n
        if len(raw) < end:
            raise ValueError(f"{n} points do not fit")
        x, y = np.frombuffer(raw, ">i2", 2 * n, HEADER).astype(float).reshape(2, n) + [[left], [top]]
        if options & FRACTIONS and len(raw) >= end + 8 * n:
            x, y = np.frombuffer(raw, ">f4", 2 * n, end).astype(float).reshape(2, n)
    elif kind == 1:
        y, x = np.array([top, top, bottom, bottom], float), np.array([left, right, right, left], float)
    name, z = "", 0
    if second and len(raw) >= second + HEADER2:
        _, z, _, at, size = struct.unpack(">5i", raw[second + 4 : second + 24])
        if at and len(raw) >= at + 2 * size:
            name = raw[at : at + 2 * size].decode("utf-16-be", "replace")
    return {"name": name, "kind": KINDS[kind], "position": position, "z": z, "top": top, "left": left, "bottom": bottom, "right": right, "y": y.tolist(), "x": x.tolist()}


def made(name: str, y: list[float], x: list[float], position: int = 0, z: int = 0) -> bytes:
    """A polygon's bytes. Whole corners are written as such; others as fractions besides."""
    ys, xs = np.asarray(y, float), np.asarray(x, float)
    if len(ys) != len(xs) or len(ys) > 65_535:
        raise ValueError(f"{len(ys)} and {len(xs)} places of corners")
    top, left, bottom, right = (int(v) for v in (np.floor(ys.min()), np.floor(xs.min()), np.ceil(ys.max()), np.ceil(xs.max()))) if len(ys) else (0, 0, 0, 0)
    whole = bool((ys == np.rint(ys)).all() and (xs == np.rint(xs)).all())
    points = (np.rint(xs) - left).astype(">i2").tobytes() + (np.rint(ys) - top).astype(">i2").tobytes()
    points += b"" if whole else xs.astype(">f4").tobytes() + ys.astype(">f4").tobytes()
    second = HEADER + len(points)
    head = bytearray(HEADER)
    head[:4] = MARK
    struct.pack_into(">hBB4hH", head, 4, VERSION, 0, 0, top, left, bottom, right, len(ys))
    struct.pack_into(">h", head, 50, 0 if whole else FRACTIONS)
    struct.pack_into(">2i", head, 56, position, second)
    more = bytearray(HEADER2)
    struct.pack_into(">5i", more, 4, 0, z, 0, second + HEADER2, len(name))
    return bytes(head) + points + bytes(more) + name.encode("utf-16-be")


def _entries(path: str, raw: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    if raw[:2] != b"PK":
        yield path.rsplit("/", 1)[-1], raw, None
        return
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for entry in z.infolist():
                if not entry.is_dir():
                    yield entry.filename, z.read(entry), None
    except (zipfile.BadZipFile, OSError) as e:
        yield path.rsplit("/", 1)[-1], None, f"no archive: {e}"


def rois(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The outlines of a file, a folder or a pattern, by SCHEMA, or of it the columns asked for."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(SCHEMA)
    wanted = columns or fields.fieldNames()
    if unknown := set(wanted) - set(fields.fieldNames()):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    kinds = {f.name: f.dataType for f in fields}
    types = {"string": pa.string(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for entry, own, fault in _entries(at, raw.as_py()):
                    row = {"path": at, "entry": entry, "fault": fault}
                    try:
                        row |= parse(own) if own is not None else {}
                    except ValueError as e:
                        row["fault"] = str(e)
                    rows.append(row)
                arrays = [pa.array([r.get(c) for r in rows], types[kinds[c].simpleString()]) for c in wanted]
                yield pa.RecordBatch.from_arrays(arrays, names=wanted)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{c} {kinds[c].simpleString()}" for c in wanted))


def roi_bytes(name: Column, y: Column, x: Column) -> Column:
    """The bytes of polygons, null where a column is."""
    @F.pandas_udf("binary")
    def run(n: pd.Series, ys: pd.Series, xs: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None or c is None else made(a, list(b), list(c)) for a, b, c in zip(n, ys, xs)])

    return run(name, y.cast("array<double>"), x.cast("array<double>"))


def of_slice(found: DataFrame, index: int) -> DataFrame:
    """Sound outlines of a slice, counted from 0, of those that name none, with three corners at least, and label: the name where it
    is a number, else the place in the file's order of entries."""
    from pyspark.sql import Window

    at = F.when(F.col("z") > 0, F.col("z")).otherwise(F.col("position"))
    kept = found.where(F.col("fault").isNull() & ((at == 0) | (at == index + 1)) & (F.size("y") >= 3))
    number = F.row_number().over(Window.partitionBy("path").orderBy("entry")) - 1
    return kept.withColumn("label", F.coalesce(F.col("name").try_cast("int"), number))
