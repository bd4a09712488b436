"""Screening, graphs, rasters and orders against plain Python."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexum.operators import graphs, grids, ordering, rasters, screening, spatial, tables
from plexum.operators.thermo import Sums, melting_temperature
from plexum.plans import registry


def test_align():
    read = "ACGTACGTAC"
    assert screening.align_read(read, "10M", "10") == (read, "|" * 10, read)
    assert screening.align_read(read, "10M", "3A6") == ("ACGAACGTAC", "|||:||||||", read)
    assert screening.align_read(read, "4M2D6M", "4^GG6") == ("ACGTGGACGTAC", "||||  ||||||", "ACGT--ACGTAC")
    assert screening.align_read(read, "2S3M1I4M", "7") == ("..GTA-GTAC", "  ||| ||||", "acGTACGTAC")
    assert screening.align_read(read, "2H10M", "10")[0] == read
    assert screening.align_read(read, "*", None) is None and screening.align_read(None, "1M", "1") is None


def test_off_target(spark):
    one = "ACGTTGCAACGTAGGCTAAC"
    hits = spark.createDataFrame(
        [("p", "good", one, "20M", "20", 20), ("p", "bad", one, "20M", "1C18", 18), ("p", "bad", one, "20M", "20", 20), ("q", "good", one, "20M", "20", 20), ("r", "bad", one, "20M", "20", 20), ("q", "bad", one, None, None, 17)],
        "name string, transcript string, seq string, cigar string, md string, match_consec int",
    )
    found = {r.name: r for r in screening.off_target(hits, spark.createDataFrame([("good",)], "transcript string")).collect()}
    want = spark.range(1).select(melting_temperature(F.lit(one), formamide=10.0)).first()[0]
    assert set(found) == {"p", "q"} and found["p"].max_tm_offtarget == pytest.approx(want) and found["p"].match_consec_all == 20
    assert found["q"].max_tm_offtarget == 0.0 and found["q"].match_consec_all == 17
    marks = spark.createDataFrame([("A" * 16 + "C" + "ACGTTGCAACGTAGG", "|" * 16 + ":" + "|" * 15)], "read string, marks string")
    got = marks.select(screening.off_target_tm(F.struct("read", "marks"))).first()[0]
    both = spark.range(1).select(melting_temperature(F.lit("A" * 16)), melting_temperature(F.lit("ACGTTGCAACGTAGG"))).first()
    assert got == pytest.approx(max(both))


def test_crawl(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(400)) + "N" + "".join(rng.choice("acgt") for _ in range(200))
    df = spark.createDataFrame([("s", seq), ("short", "ACG"), ("none", None), ("empty", "")], "name string, seq string")
    out = screening.crawl(df, length=(20, 30), gc=(0.4, 0.6), tm=(20, 30), formamide=50.0)
    rows = out.withColumn("tm", melting_temperature(F.col("seq"), formamide=50.0)).collect()
    assert len(rows) > 50 and len({r.pos_start for r in rows}) == len(rows)
    ends = [r.pos_end for r in sorted(rows, key=lambda r: r.pos_start)]
    assert ends == sorted(ends)
    for r in rows:
        assert r.seq == seq.upper()[r.pos_start : r.pos_end + 1] and 20 <= len(r.seq) <= 30 and 20 < r.tm <= 30
        assert 0.4 <= sum(c in "GC" for c in r.seq) / len(r.seq) <= 0.6 and not re.search("N|A{6}|T{6}|C{5}|G{5}", r.seq)


def test_tiers(spark):
    rng = random.Random(5)
    rows = [(g, i, s := rng.randrange(200), s + rng.randrange(5, 30), rng.randrange(1, 4)) for g in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "g string, id long, start long, stop long, priority int")
    all_tiers = {t: screening.tiered_selection(df, "g", t, 0, 10**6).where("g = 'a'").count() for t in (1, 2, 3)}
    low = min(all_tiers[1], all_tiers[2]) - 1
    found = screening.tiered_selection(df, "g", 3, 0, low).where("g = 'a'").collect()
    assert {r.tier for r in found} == {1} and len(found) == all_tiers[1]
    assert {r.tier for r in screening.tiered_selection(df, "g", 3, 0, 10**6).collect()} == {3}
    sel = lambda o: spatial.greedy_intervals(df.select("g", "id", "start", "stop"), "g", o)
    n = {o: sel(o).where("g = 'b'").count() for o in (0, -5, -10)}
    got = screening.relaxed_selection(sel, "g", [0, -5, -10], n[-5]).where("g = 'b'").select("overlap").distinct().collect()
    assert [r.overlap for r in got] == [next(o for o in (0, -5, -10) if n[o] >= n[-5])]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    nodes = spark.range(60)
    found = {r.id: r.label for r in graphs.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: root(i) for i in range(60)}
    assert graphs.components(nodes.limit(0), spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    x[:, 3] = x[:, 0] + 0.01 * x[:, 3]
    x[:, 1] *= 3
    names = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    centred, chosen = x - x.mean(0), []
    for _ in range(3):
        basis = centred[:, chosen]
        rest = centred - (basis @ np.linalg.lstsq(basis, centred, rcond=None)[0] if chosen else 0)
        chosen.append(max((i for i in range(5) if i not in chosen), key=lambda i: (rest[:, i] ** 2).sum()))
    assert screening.orthogonal_columns(df, names, [], 3) == [names[i] for i in chosen]
    assert "c3" not in screening.orthogonal_columns(df, names[1:], ["c0"], 3)
    assert screening.variance_captured(df, names, names, 2) == pytest.approx(1.0)
    assert screening.variance_captured(df, names, ["c1"], 1) > 0.9


def test_fit_affine(spark):
    matrix, shift = ((1.02, -0.01), (0.03, 0.97)), (4.0, -2.0)
    df = spark.createDataFrame([(float(y), float(x)) for y, x in itertools.product(range(5), range(7))], "y double, x double")
    y, x = rasters.affine(F.col("y"), F.col("x"), matrix, shift)
    found = rasters.fit_affine(df.withColumns({"ty": y, "tx": x}))
    assert np.allclose(found[0], matrix) and np.allclose(found[1], shift)


def test_order(spark):
    rng = random.Random(2)
    values = [(None if i % 17 == 0 else rng.randrange(30), i) for i in range(300)]
    df = spark.createDataFrame(values, "v int, id int")
    want = {i: n for n, (v, i) in enumerate(sorted(values, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert {r.id: r["index"] for r in ordering.row_index(df, "v", ["id"]).collect()} == want
    assert ordering.row_index(df.limit(0), "v").count() == 0
    assert {r.id for r in ordering.every_nth(df, 50, "v", ["id"]).collect()} == {i for i, n in want.items() if n % 50 == 0}


def test_smooth_keeps_mass(spark):
    grid = spark.createDataFrame([(0, 0, 1.0), (4, 2, 3.0)], "i long, j long, v double")
    out = grids.smooth(grid, (5, 3), 1.5)
    assert out.agg(F.sum("v")).first()[0] == pytest.approx(4.0) and out.count() == 15


def test_small_tables(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    with pytest.raises(ValueError):
        tables.require_subset(df, df.where("k = 'a'"), "k")
    assert {(r.k, r.v) for r in tables.relaxed_union([df, df.withColumn("v", F.lit("x"))]).collect()} == {("a", "1"), ("b", "2"), ("a", "x"), ("b", "x")}
    assert tables.by_patterns(df, ["k"], [], ["b"]).count() == 1 and tables.by_patterns(df, ["k"], ["a", "b"], []).count() == 2
    pixels = spark.createDataFrame([(y, x) for y in range(3) for x in range(3)], "y long, x long")
    assert [tuple(r) for r in rasters.erode(pixels, [], 1).collect()] == [(1, 1)] and rasters.opening(pixels, [], 1).count() == 9
    vectors = spark.createDataFrame([([3.0, 4.0],), ([0.1, 0.1],)], "v array<double>")
    assert [r[0] for r in vectors.select(rasters.quiet(F.col("v"), 1.0)).collect()] == [[3.0, 4.0], [0.0, 0.0]]


def test_pixel_components_of_whole_tiles(spark, tmp_path):
    rng = random.Random(11)
    crossing = [(6, y, x) for y, x in [(18, 19), (19, 19), (19, 20), (20, 20), (20, 21)]]
    pixels = crossing + [(rng.randrange(7), rng.randrange(96), rng.randrange(96)) for _ in range(2500)]
    rows = [(y + 96 * (n % 5), x + 96 * (n % 3), t + 7 * (n % 4), 29.0) for n, (t, y, x) in enumerate(pixels)] + [(1, 1, 1, 30.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    left, want = set(pixels), []
    while left:
        spot, todo = [], [left.pop()]
        while todo:
            t, y, x = todo.pop()
            spot.append((t, y, x))
            near = {(t, y + 1, x), (t, y - 1, x), (t, y, x + 1), (t, y, x - 1)} & left
            left -= near
            todo += near
        if 2 <= len(spot) <= 400:
            want.append((spot[0][0], len(spot), round(sum(p[1] for p in spot) / len(spot), 6), round(sum(p[2] for p in spot) / len(spot), 6)))
    found = registry.QUERIES["pixel_components"](spark, str(tmp_path)).collect()
    assert sorted((r.tile, r.area, r.y, r.x) for r in found) == sorted(want)
    assert {r.tile for r in found} == set(range(7)) and any(r.y > 20 and r.x > 20 for r in found)


def test_raster_queries_take_all_tiles(spark, tmp_path):
    pixels = {(t, y, x) for t in range(7) for y, x in [(10, 10), (10, 12), (95, 0)]}
    rows = [(y, x, t + 7, 29.0) for t, y, x in pixels] + [(50, 50, 3, 30.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows_of = lambda name, *c: {tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*c).collect()}
    wide = {(t, y + a, x + b) for t, y, x in pixels for a in (-1, 0, 1) for b in (-1, 0, 1)}
    assert rows_of("raster_dilate", "tile", "y", "x") == wide
    assert rows_of("raster_closing", "tile", "y", "x") == pixels | {(t, 10, 11) for t in range(7)}
    assert rows_of("region_properties", "tile", "label", "area") == {(t, n, a) for t in range(7) for n, a in [(18, 1), (19, 1), (241, 1)]}


def test_blank_classifier_keeps_spots_without_a_feature(spark):
    rows = [(i, float(i), 1.0, i < 20) for i in range(40)] + [(100, None, 1.0, True), (101, 3.0, None, False), (102, float("nan"), 1.0, True)]
    out = screening.blank_classifier(spark.createDataFrame(rows, "id int, a double, b double, blank boolean"), ["a", "b"], "blank")
    assert {r.id: r.p_blank for r in out.collect()} == {i: float(i < 20) for i in range(40)} | {100: None, 101: None, 102: None}


def test_crawl_takes_the_windows_of_a_walk_in_several_tasks(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACGTacgtNAT" if i % 3 else "ACGT") for _ in range(n)) for i, n in enumerate([50, 128, 128, 20, 21, 300, 128, 0])]
    length, gc, tm, bad = (20, 30), (0.35, 0.65), (15, 32), re.compile("N|A{6}|T{6}|C{5}|G{5}")
    want = []
    for i, seq in enumerate(s.upper() for s in seqs):
        sums, stop = Sums(seq, "hybrid", 50.0), length[0]
        for start in range(len(seq) - length[0]):
            if seq[start] == "N":
                continue
            stop = max(stop, start + length[0])
            while stop <= min(start + length[1], len(seq)):
                warm = sums.celsius(start, stop) if gc[0] <= sums.share(start, stop) <= gc[1] else -math.inf
                if warm > tm[0]:
                    if warm <= tm[1] and not bad.search(seq[start:stop]):
                        want.append((f"{i}:{start}-{stop - 1}", seq[start:stop], start, stop - 1))
                    break
                stop += 1
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(seqs)], "name string, seq string").coalesce(1)
    out = screening.crawl(df, length, gc, tm, 50.0)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and len(want) > 50
    assert out.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
