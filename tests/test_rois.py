"""Outlines written and read back, archives, faults, and outlines of pixels as files."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from plexum.operators import outlines
from plexum.sources import rois


def test_round_trip(tmp_path, spark):
    shapes = {"7": ([1, 1, 9, 9], [2, 30, 30, 2]), "né": ([0.5, 4.25, 8.0], [1.0, 9.75, -3.0]), "": ([-5, 0, 5], [0, 7, 0])}
    (tmp_path / "one.roi").write_bytes(rois.made("7", *shapes["7"], position=2))
    with zipfile.ZipFile(tmp_path / "more.zip", "w") as z:
        z.writestr("b.roi", rois.made("né", *shapes["né"], z=3))
        z.writestr("a.roi", rois.made("", *shapes[""]))
        z.writestr("note.txt", b"no outline at all" * 9)
    (tmp_path / "cut.roi").write_bytes(rois.made("7", *shapes["7"])[:66])
    (tmp_path / "bad.zip").write_bytes(b"PK broken")
    (tmp_path / "empty.roi").write_bytes(b"")  # Spark passes over empty files
    got = {r.entry: r for r in rois.rois(spark, str(tmp_path)).collect()}
    assert {e: r.fault for e, r in got.items() if r.fault} == {"note.txt": "no outline", "cut.roi": "4 points do not fit", "bad.zip": got["bad.zip"].fault} and got["bad.zip"].fault.startswith("no archive")
    for entry, name in (("one.roi", "7"), ("b.roi", "né"), ("a.roi", "")):
        r = got[entry]
        assert (r.name, r.y, r.x, r.kind) == (name, list(map(float, shapes[name][0])), list(map(float, shapes[name][1])), "polygon")
    assert (got["one.roi"].position, got["b.roi"].z, got["one.roi"].top, got["one.roi"].right) == (2, 3, 1, 30)
    some = rois.rois(spark, str(tmp_path), ["name", "fault"])
    assert some.columns == ["name", "fault"] and some.count() == 6
    labels = lambda k: sorted((r.entry, r.label) for r in rois.of_slice(rois.rois(spark, str(tmp_path)), k).collect())
    assert labels(1) == [("a.roi", 0), ("one.roi", 7)] and labels(2) == [("a.roi", 0), ("b.roi", 1)] and labels(0) == [("a.roi", 0)]
    with pytest.raises(ValueError):
        rois.rois(spark, str(tmp_path), ["nothing"])


def test_rectangle_and_unknown_kind():
    raw = bytearray(rois.made("r", [1, 1, 5, 5], [2, 8, 8, 2]))
    raw[6] = 1
    assert rois.parse(bytes(raw))["y"] == [1, 1, 5, 5] and rois.parse(bytes(raw))["kind"] == "rectangle"
    raw[6] = 99
    with pytest.raises(ValueError, match="unknown kind"):
        rois.parse(bytes(raw))
    assert struct.unpack(">h", raw[4:6])[0] == rois.VERSION


def test_outlines_as_files(spark, tmp_path):
    df = spark.createDataFrame([("t", 3, y, x) for y in range(4) for x in range(5) if (y, x) != (0, 4)], "tile string, label int, y int, x int")
    rings = outlines.outlines(df, ["tile"]).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("position", "y", "x"))).alias("p"))
    raw = rings.select(rois.roi_bytes(F.col("label").cast("string"), F.col("p.y"), F.col("p.x")).alias("b")).first().b
    (tmp_path / "3.roi").write_bytes(raw)
    r = rois.rois(spark, str(tmp_path)).first()
    assert list(zip(r.y, r.x)) == [(0, 0), (0, 4), (1, 4), (1, 5), (4, 5), (4, 0)] and r.name == "3"
