"""Histograms, fits and assembly against values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexum.operators import assembly, histograms, spatial
from plexum.sources import readers


def values(spark, xs, key="a"):
    return spark.createDataFrame([(key, float(x)) for x in xs], "k string, v double")


def test_quantiles_by_middles_of_bins(spark):
    hist = spark.createDataFrame([("a", 0.0, 1.0, b, n) for b, n in enumerate([10.0, 20.0, 30.0, 40.0])], "k string, lo double, width double, bin long, n double")
    at = lambda q: histograms.quantile(hist, ["k"], F.lit(q)).first()["quantile"]
    assert at(0.05) == 0.5 and at(0.1) == 0.5  # before the first middle: the first middle
    assert at(0.3) == pytest.approx(1.5) and at(0.45) == pytest.approx(2.0) and at(1.0) == pytest.approx(3.5)
    flat = histograms.linear(values(spark, [7, 7, 7]), ["k"], "v", 4)
    assert flat.count() == 0  # one value outside 0 to 1
    one = histograms.linear(values(spark, [0, 1, 2, 3, 4]), ["k"], "v", 4).orderBy("bin").collect()
    assert [r.n for r in one] == [1, 1, 1, 2]  # the last bin is closed
    assert histograms.linear(values(spark, [1.0]).limit(0), ["k"], "v", 4).count() == 0


def test_rebin_like_cumulated_counts(spark):
    rng = np.random.default_rng(1)
    parts = [rng.normal(0, 1, 500), rng.normal(2, 3, 300), np.array([1.0, 5.0])]
    rows = [("a", i, float(x)) for i, p in enumerate(parts) for x in p]
    own = histograms.with_end(histograms.linear(spark.createDataFrame(rows, "k string, s int, v double"), ["k", "s"], "v", 16), 16)
    got = {r.bin: r.n for r in histograms.rebin(own, ["k"], 16).collect()}
    edges = np.linspace(min(map(min, parts)), max(map(max, parts)), 17)
    want = np.zeros(16)
    for p in parts:  # counts up to an edge grow evenly inside a bin
        n, e = np.histogram(p, np.linspace(p.min(), p.max(), 17))
        want += np.diff(np.interp(edges, e, np.concatenate([[0], np.cumsum(n)])))
    assert np.allclose([got.get(i, 0.0) for i in range(16)], want)


def test_mode_is_the_middle_of_the_bin_after_the_fullest(spark):
    mode = lambda xs, w: histograms.binned_mode(values(spark, xs), "k", "v", w).first()["mode"]
    assert mode([0, 0.1, 0.2, 3, 9], 1.0) == 1.5  # bin 1 of edges from 0 on: the middle of edges 1 and 2
    assert mode([0, 8.2, 8.3, 9], 1.0) == 8.25  # the fullest bin is the last one: the median
    assert mode([5, 5, 5], 1.0) == 5


def test_drift(spark):
    rows = [("far", 50.0, 50.0)] * 9 + [("few", 1.0, 2.0)] * 3 + [("few", 2.0, 4.0)] + [("many", 0.0, 0.0)] + [("many", 3.1, -2.0)] * 6 + [("many", 9.0, 9.0)] * 2
    got = {r.k: (r.dx, r.dy) for r in histograms.drift(spark.createDataFrame(rows, "k string, dx double, dy double"), "k", "dx", "dy", 5, 40.0).collect()}
    assert got["far"] == (50.0, 50.0) and got["few"] == (1.0, 2.0) and got["many"] == (3.75, -1.25)


def test_otsu_and_robust_line(spark):
    hist = histograms.linear(values(spark, [1.0] * 50 + [1.2] * 50 + [9.0] * 30 + [9.5] * 20), ["k"], "v", 256)
    assert 1.19 < histograms.otsu(hist, ["k"]).first()["threshold"] < 1.25
    points = [("a", i, float(i), 2.0 * i + 1 + (40 if i in (3, 7) else 0)) for i in range(12)]
    line = histograms.robust_line(spark.createDataFrame(points, "k string, bin long, x double, y double"), "k").first()
    assert line.inliers == 10 and line.slope == pytest.approx(2) and line.intercept == pytest.approx(1)


def test_threshold_curve(spark):
    spots = spark.createDataFrame([(0.1, False), (0.3, True), (0.5, False), (0.9, True)], "d double, b boolean")
    levels = spark.createDataFrame([(i, i / 7) for i in range(8)], "level int, v double")
    got = {r.level: (r.spots, r.blank_share) for r in histograms.threshold_curve(spots, "d", "b", levels).collect()}
    assert got == {1: (1, 0.0), 3: (2, 0.5), 5: (3, pytest.approx(1 / 3)), 7: (4, 0.5)}


def test_heads_again(spark):
    rows = [(g, i) for g, n in (("three", 3), ("five", 5), ("seven", 7), ("eight", 8)) for i in range(n)]
    out = assembly.with_heads_again(spark.createDataFrame(rows, "g string, i int"), "g", [F.col("i")])
    got = {r.g: (r.n, r.m) for r in out.groupBy("g").agg(F.count("*").alias("n"), F.count_if("again").alias("m")).collect()}
    assert got == {"five": (10, 5), "seven": (12, 5), "eight": (8, 0)}


def test_spaced_from_the_end(spark):
    df = spark.createDataFrame([("g", p, i) for i, p in enumerate([0, 30, 60, 100, 149, 199])], "g string, at int, i int")
    assert sorted(r["at"] for r in assembly.spaced(df, "g", "at", "i").collect()) == [0, 60, 149, 199]


def test_encoding_deals_orders_in_a_cycle(spark):
    readouts = {1: "ACGTACGTAC", 2: "GATTGATTGA"}
    probes = spark.createDataFrame([("p1", "GCGCGC"), ("p2", "TTTTTTG"), ("p3", "GCATGC")], "name string, padlock string")
    out = {r.name: r for r in assembly.encode_probes(probes, readouts, [1, 2]).collect()}
    assert out["p1"].seq == "gtacgtacgtAAtcaatcaatcGCGCGC" and (out["p1"].code1, out["p1"].code2) == (1, 2)
    assert "p2" not in out  # a run of six under each separator: four turns of the cycle of two go by
    assert (out["p3"].code1, out["p3"].code2) == (2, 1) and out["p3"].seq.startswith("tcaatcaatcAA")
    with pytest.raises(ValueError):
        assembly.encode_probes(probes, readouts, [1, 9])


def test_single_readout(spark):
    df = spark.createDataFrame([("p", "ACGTACGTACGTACGTACGTA", "CCATGCATGCATGCATGCATGCATGC")], "name string, splint string, padlock string")
    r = assembly.single_readout(df, "GATTACAGATTACAGATTAC").first()
    body = "gattacagattacagattac" + "a" + "GCATGCATGCATGCATGCATGCATGG"
    assert r.cons_pad == body[13:] + body[:13] and len(r.cons_pad) == 47
    turn = lambda x: x[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    assert r.cons_splint == turn("ACGTACGTACGTACGTACGTA") + "ta" + turn(r.cons_pad[:6]) + turn(r.cons_pad[-6:])


def test_pairs_first_free(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1), (4, 2, 1), (5, 2, 5)], "k int, i int, j int")
    assert {(r.i, r.j) for r in assembly.pair_first_free(df).collect()} == {(0, 0), (1, 1), (2, 5)}


def test_transcripts_and_exports(spark):
    t = spark.createDataFrame([("a", "g1", "t1", "Ensembl_canonical"), ("a", "g1", "t2", "basic"), ("b", "g2", "t3", "basic"), ("b", "g2", "t4", "basic"), ("c", "g3", "t5", None)], "gene_name string, gene_id string, transcript_id string, tag string")
    genes = spark.createDataFrame([("g1",), ("g2",)], "gene_id string")
    notes = spark.createDataFrame([("t1", "ALTERNATIVE"), ("t2", "PRINCIPAL:1"), ("t3", "PRINCIPAL:1"), ("t4", "ALTERNATIVE")], "transcript_id string, annotation string")
    got = lambda *a: sorted(r.transcript_id for r in assembly.resolve_transcripts(t, genes, *a).collect())
    assert got("all") == ["t1", "t2", "t3", "t4"] and got("principal", notes) == ["t1", "t3"] and got("annotated", notes) == ["t1", "t2", "t3", "t4"]
    assert got("canonical", None, spark.createDataFrame([("t2",), ("t5",)], "transcript_id string")) == ["t2"]
    spots = spark.createDataFrame([(10.0, 20.0, "G-1", 7), (0.0, 0.0, "Blank-2", 8)], "x double, y double, target string, idx int")
    micron = assembly.micron_table(spots)
    assert {(round(r.X, 3), round(r.Y, 3), r.gene) for r in micron.collect()} == {(2.08, 3.16, "G"), (1.0, 1.0, "Blank")}
    assert {(r["name"], round(r.value, 3)) for r in assembly.extent_table(micron).collect()} == {("xmin", 1.0), ("xmax", 2.08), ("ymin", 1.0), ("ymax", 3.16)}
    assert {(r.gene, r.Count) for r in assembly.feature_table(micron).collect()} == {("G", 1), ("Blank", 1)}


def test_later_tile_wins(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 5, 0, 15, 10)], "id int, x0 int, y0 int, x1 int, y1 int")
    points = spark.createDataFrame([(1, 7, 5), (2, 7, 5), (1, 2, 5), (2, 12, 5)], "tile int, x int, y int")
    assert {(r.tile, r.x) for r in spatial.exclusive(points, boxes, 4, later_wins=True).collect()} == {(2, 7), (1, 2), (2, 12)}
    assert {(r.tile, r.x) for r in spatial.exclusive(points, boxes, 4).collect()} == {(1, 7), (1, 2), (2, 12)}


def test_spots_path(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert readers.spots_path(spark, root, "r", "a b-c") == f"{root}/analysis/output/r+a_b_c.parquet"
    with pytest.raises(FileNotFoundError):
        readers.spots_path(spark, root, "r", "a-c", must_exist=True)
    (tmp_path / "analysis/deconv/r+a-c.parquet").mkdir(parents=True)
    assert readers.spots_path(spark, root, "r", "a-c", must_exist=True).endswith("deconv/r+a-c.parquet")


def test_exact_percentile_over_ranges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.integers(0, 40, 301)] + [("b", float(x)) for x in rng.normal(size=200)] + [("c", 2.0), ("d", None), ("e", 1.0), ("e", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.2, 0.5, 0.9999, 1.0):
        want = {r.k: r.p for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", F.lit(q)).alias("p")).collect()}
        assert {r.k: r.p for r in histograms.exact_percentile(df, ["k"], "v", q, "p").collect()} == want and len(want) == 4
    # a bin's values are in no aggregate that holds them all
    monkeypatch.setattr(histograms.F, "percentile", None)
    points = [("a", float(i % 50), float(i)) for i in range(2000)]
    assert histograms.conditional_percentiles(spark.createDataFrame(points, "k string, x double, y double"), "k", "x", "y", points=5, least=10).count() > 0
