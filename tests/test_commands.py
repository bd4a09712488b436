"""Whole commands against brute force and values worked out by hand."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexum.operators import commands, fields, screening, spatial
from plexum.operators.thermo import Sums
from plexum.plans import commands as plans
from plexum.sources import readers


def test_nearest_in_plane(spark):
    rng = random.Random(2)
    fixed = [(g, i, rng.uniform(0, 300), rng.uniform(0, 300)) for g in "ab" for i in range(40)] + [("c", 1, 5.0, 5.0), ("c", 0, 5.0, 5.0)]
    moving = [(g, i, rng.uniform(-50, 350), rng.uniform(-50, 350)) for g in "ab" for i in range(120)]
    moving += [("a", 900, 1e6, -1e6), ("b", 901, -3e4, 2.0), ("c", 1, 2.0, 1.0), ("d", 1, 0.0, 0.0)]
    kind = "g string, id int, x double, y double"
    for size in (0.5, 20.0, 1e4):
        got = {(r.g, r.id): (r.target_id, r.distance, r.dx, r.dy) for r in spatial.nearest_in_plane(spark.createDataFrame(moving, kind), spark.createDataFrame(fixed, kind), "g", size).collect()}
        for g, i, x, y in moving:
            near = min(((math.hypot(fx - x, fy - y), fi, fx - x, fy - y) for fg, fi, fx, fy in fixed if fg == g), default=None)
            if near is None:
                assert (g, i) not in got
            else:
                assert got[g, i][0] == near[1] and got[g, i][1:] == pytest.approx((near[0], *near[2:]))


def test_drift_from_points(spark):
    rng = random.Random(4)
    fixed = [("r", i, rng.uniform(0, 2000), rng.uniform(0, 2000), 0.0) for i in range(200)]
    moving = [(g, i, x - 3.2, y + 1.7, float(i)) for g, i, x, y, _ in fixed] + [("r", 500 + i, rng.uniform(0, 2000), rng.uniform(0, 2000), 900.0) for i in range(30)]
    kind = "g string, id int, x double, y double, mag double"
    f, m = spark.createDataFrame(fixed, kind), spark.createDataFrame(moving, kind)
    matched = commands.match_fixed(m, f, "g", 50.0).collect()
    assert len({r.fixed_id for r in matched}) == len(matched) <= 200
    few = commands.fiducial_drift(m, f, "g", 50.0, brightest=60).first()
    assert (few.dx, few.dy) == (3.2, -1.7)
    mode = commands.fiducial_drift(m, f, "g", 50.0).first()
    assert abs(mode.dx - 3.2) <= 1 and abs(mode.dy + 1.7) <= 1

    def detect(sigma, fwhm):  # too few points until the threshold has come down twice
        return m.where("mag < 100") if sigma <= 2.0 else m.limit(3)

    row = commands.drift_with_retries(detect, f, "g", 50.0, (3.0, 8.0), (50, 150)).collect()
    assert [(r.g, r.dx, r.dy, r.sigma, r.fwhm) for r in row] == [("r", 3.2, -1.7, 2.0, 8.0)]
    assert commands.drift_with_retries(lambda s, w: m.limit(1), f, "g", 50.0, (3.0, 8.0), (50, 150), attempts=2).count() == 0


def test_next_detection():
    n = commands.next_detection
    assert n(3.0, 8.0, {(3.0, 8.0)}, "few") == (2.5, 8.0) and n(2.0, 8.0, set(), "few") == (2.0, 8.5)
    assert n(3.0, 8.0, {(3.5, 8.0), (3.5, 8.5)}, "many") == (3.5, 9.0)
    assert n(3.0, 8.0, {(3.5, 8.0)}, "drift") == (3.5, 7.5) and n(3.0, 3.5, {(3.5, 3.5)}, "residual") == (3.5, 4.0)
    with pytest.raises(ValueError):
        n(3.0, 8.0, set(), "none")


def test_threshold(spark):
    rng = random.Random(6)
    rows = []
    for i in range(4000):
        blank, low = i % 4 == 0, i % 4 == 0 or rng.random() < 0.3
        rows.append(("r", i, rng.uniform(12, 40) if low else rng.uniform(60, 190), rng.uniform(0.01, 0.02) if low else rng.uniform(0.1, 0.5), rng.uniform(0, 0.2), blank))
    rows += [("r", 5000, 300.0, 0.5, 0.1, False), ("r", 5001, 50.0, 0.001, 0.1, False), ("r", 5002, 50.0, 0.5, 0.9, False), ("r", 5003, None, 0.5, 0.1, False)]
    spots = spark.createDataFrame(rows, "roi string, id long, area double, norm double, distance double, is_blank boolean")
    p = commands.Threshold(least_spots=3)
    kept = {r.id: r.is_blank for r in commands.density_threshold(spots, "roi", F.col("id"), 10, p).collect()}
    assert not kept.keys() & {5000, 5001, 5002, 5003} and sum(kept.values()) / len(kept) < 0.05 and len(kept) > 1500
    curve = commands.threshold_curves(spots, "roi", F.col("id"), p).orderBy("level").collect()
    assert [r.level for r in curve] == list(range(1, 15, 2)) and [r.spots for r in curve] == sorted(r.spots for r in curve)
    assert commands.density_threshold(spots, "roi", F.col("id"), {"other": 3}, p).count() == 0
    assert commands.density_threshold(spots.limit(0), "roi", F.col("id"), 3, p).count() == 0
    one = spots.where("id = 4")  # a grid of one point has no steps
    assert commands.density_threshold(one, "roi", F.col("id"), 3, p).columns == spots.columns and commands.density_threshold(one, "roi", F.col("id"), 3, p).count() == 0


def test_levels():
    z = np.array([[0.0, 1.0], [4.0, 9.0]])
    assert np.allclose(commands.spaced_levels(z, "sqrt", 4), [0, 1, 4, 9]) and np.allclose(commands.spaced_levels(z, "log", 3), [1, 3, 9])
    assert np.allclose(commands.spaced_levels(-z, "log", 4), [-9, -6, -3, 0]) and len(commands.spaced_levels(z * 0 + 2, "log", 5)) == 5
    with pytest.raises(ValueError):
        commands.spaced_levels(z, "cubic", 3)


def test_candidates(spark):
    seq = "ACGATTCAGGCTAACGTCAGATTCGACCTA"
    rows = [("a", "own", 30), ("a", "far", 16), ("b", "own", 30), ("b", "far", 25), ("c", "far", 10), ("d", "own", 30), ("d", "kin", 30), ("e", "own", 30)]
    hits = spark.createDataFrame([(n, t, "A" * 30 if n == "e" else seq, f"{m}M", str(m), m, m, 30) for n, t, m in rows], "name string, transcript string, seq string, cigar string, md string, match int, match_consec int, length int")
    ok = spark.createDataFrame([("own",), ("kin",)], "transcript string")
    names = spark.createDataFrame([("own", "Own-1"), ("kin", "Own-2")], "transcript string, transcript_name string")
    out = {r.name: r for r in commands.candidates(hits, ok, bad_kmers=spark.createDataFrame([("A" * 18,)], "kmer string"), others=names.where("transcript = 'kin'"), same_gene=names, hairpin=lambda s: F.length(s)).collect()}
    assert set(out) == {"a", "d"}  # b maps elsewhere, c never to its own, e holds a bad word
    assert out["a"].oks == 6 and out["a"].hp == 30 and out["a"].max_tm_offtarget == 0 and out["a"].maps_to_pseudo is None
    assert out["d"].maps_to_pseudo == "kin" and out["d"].isoforms == ["Own-1", "Own-2"]
    assert commands.candidates(hits.limit(0), ok).count() == 0


def test_arms(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(30)] + ["ACG", "", None, "A" * 60]
    hot = lambda s: 100.0 if s.startswith("C") else 0.0
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")
    found = 0
    for hairpin in (None, hot):
        for r in screening.split_arms(df, 50.0, hairpin=hairpin).collect():
            assert (r.splint == "") == (r.pad_start == -1)
            if r.pad_start > 0:
                found += 1
                assert Sums(r.padlock).celsius(0, len(r.padlock)) > 55 and Sums(r.splint).celsius(0, len(r.splint)) > 55
                assert r.seq[r.pad_start :].startswith(r.splint) and any(r.seq[: r.pad_start - k].endswith(r.padlock) for k in (0, 1))
                assert not hairpin or not (r.padlock.startswith("C") or r.splint.startswith("C"))
    assert found > 20


def test_orthogonal_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ATCC") for _ in range(20)) for _ in range(400)]
    words += [words[0], "CCC" + "A" * 17]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, i int")
    got = [r.word for r in commands.orthogonal_words(df, "word", "i", ["T" * 20], tm=(45, 60)).orderBy("place").collect()]

    def edits(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    want = []
    for w in words:
        if any(x in w for x in ("CCC", "AAAA", "TTTT")) or not 8 <= w.count("C") <= 12 or not 45 <= Sums(w, "dna").celsius(0, 20) <= 60:
            continue
        if all(edits(w, o) >= 6 for o in ["T" * 20, *want]):
            want.append(w)
    assert got == want and len(got) > 3


def test_manifest(spark):
    headers = {"splint": ("CCATTACCA", "ACTGATTGATT"), "padlock": ("TTGATCCAATTGGACCTTATAG", "GGTATTCATGCAATTCA")}
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ACT") for _ in range(n))
    rows = [(g, f"{g}{i}", [1, i % 3], [float(i)], text(25), text(22) + ("N" if i == 1 else ""), text(80)) for g, n in (("few", 3), ("low", 5), ("many", 20)) for i in range(n)]
    rows[-1] = (*rows[-1][:4], "ACT" + "GGATCC" + text(16), *rows[-1][5:])  # a site in the arm
    df = spark.createDataFrame(rows, "gene string, name string, priority array<int>, hp array<double>, splint string, padlock string, seq string")
    out = commands.ordering_manifest(df, "gene", headers, F.substring("padlock", 1, 6)).collect()
    count = lambda g: sum(r.gene == g for r in out)
    assert count("few") == 0 and count("low") == 8 and 14 <= count("many") <= 15  # masked rows go after heads are repeated
    turn = lambda x: x[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    for r in out:
        assert r.pad_cut.startswith("TAG" + r.padlock[:6].lower() + "ta" + turn(r.seq)) and r.pad_cut.endswith("at" + "AGT" + "GGT")
        assert r.spl_cut.endswith(turn(r.splint) + "ca" + turn(r.pad_cut[:6]) + turn(r.pad_cut[-6:])) and 139 <= len(r.padlockcons) <= 150
        assert not any(s in x.upper() for s in commands.SITES for x in (r.spl_cut, r.pad_cut))


def test_fields(spark):
    rng = np.random.default_rng(1)
    points = rng.uniform(0, 1000, (40, 2))
    plane = 2.0 + 0.01 * points[:, 0] - 0.02 * points[:, 1]
    for smoothing in (0.0, 1.0):  # a plane is kept whatever the smoothing
        rows = fields.evaluate(spark, points, plane, plane + 5, (0, 0, 900, 500), 100.0, 12, smoothing).collect()
        assert len(rows) == 10 * 6
        for r in rows:
            assert r.low == pytest.approx(2.0 + 0.01 * r.x - 0.02 * r.y, abs=1e-6) and r.high == pytest.approx(r.low + 5, abs=1e-6)
    bumpy = rng.normal(size=40)
    z = fields._plates(points / 300, np.stack([bumpy, -bumpy], 1), points / 300, 0, 0.0)
    assert np.allclose(z[:, 0], bumpy, atol=1e-6)
    assert all(r.high == pytest.approx(r.low + 1e-3) for r in fields.evaluate(spark, points, plane, plane - 9, (0, 0, 10, 10)).collect())
    field = spark.createDataFrame([(0, 0, 1.0, 5.0), (1, 0, 1.0, 9.0), (2, 0, 0.0, 100.0)], "x int, y int, low double, high double")
    gain = {r.x: r.gain for r in fields.range_gain(field, 4.0).collect()}
    inverse = [1.0, 0.5, 1 / 3]
    assert [gain[i] for i in range(3)] == pytest.approx([v / np.mean(inverse) for v in inverse])
    pixels = spark.createDataFrame([(0, 0, 3.0), (1, 0, 0.5), (9, 9, 1.0)], "x int, y int, value double")
    assert {r.x: r.value for r in fields.correct(pixels, fields.range_gain(field, 4.0)).collect()} == {0: pytest.approx(2 * gain[0]), 1: 0.0}
    flat = spark.createDataFrame([(0, 0, 2.0, 1.0), (1, 0, 0.0, 0.0)], "x int, y int, flat double, dark double")
    assert {r.x: r.value for r in fields.flat_field(pixels, flat).collect()} == {0: 1.0, 1: None}


def tiff(order="<", strip=(100, 8), size=120, following=0):
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    entries = struct.pack(order + "HHHI", 2, 273, 4, 1) + struct.pack(order + "I", strip[0]) + struct.pack(order + "HHII", 279, 4, 1, strip[1])
    return (head + entries + struct.pack(order + "I", following)).ljust(size, b"\0")


def test_verify(spark, tmp_path):
    assert readers.tiff_fault(tiff()) is None and readers.tiff_fault(tiff(">")) is None
    assert readers.tiff_fault(tiff(strip=(100, 90))) == "data past the end" and readers.tiff_fault(tiff()[:20]) == "cut off"
    assert readers.tiff_fault(b"") == readers.tiff_fault(b"nothing like it") == "no TIFF header" and readers.tiff_fault(tiff(following=8)) == "directories in a circle"
    for roi, name, data in (("r1", "a.tif", tiff()), ("r1", "b.tif", tiff()[:30]), ("r2", "a.tif", tiff(">"))):
        (tmp_path / f"registered--{roi}+cb").mkdir(exist_ok=True)
        (tmp_path / f"registered--{roi}+cb" / name).write_bytes(data)
    root = f"file://{tmp_path}"
    assert {(r.roi, r.path[-5:], r.fault) for r in readers.verify_codebook(spark, root, "cb").collect()} == {("r1", "a.tif", None), ("r1", "b.tif", "cut off"), ("r2", "a.tif", None)}
    assert readers.verify_codebook(spark, root, "cb", ["r2"]).count() == 1
    with pytest.raises(ValueError):
        readers.verify_codebook(spark, root, "cb", ["r3"])


def test_spaced_table_rounds_places_and_tells_rows_of_one_name_apart(spark):
    part = spark.createDataFrame([(1, "p" * 10, "t" * 10, "brand")], "p_partkey long, p_name string, p_type string, p_brand string")
    # gene 1: 1000.6 rounds to 1001, 50 below 1050.7 -> 1051, and 49.6 below 1050.2; gene 2: one name twice, the second row too near
    rows = [(1, 1, 1, 1, 1000.6, 1.0), (2, 1, 1, 1, 1050.2, 2.0), (3, 1, 2, 1, 500.0, 1.0), (3, 1, 2, 1, 520.0, 2.0), (4, 1, 3, 1, 50.6, 1.0), (5, 1, 3, 1, 300.0, 1.0), (5, 1, 3, 1, 300.0, 1.0)]
    lineitem = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_quantity double")
    out = sorted(tuple(r) for r in plans.spaced_table(lineitem, part).collect())
    assert out == [(1, "17"), (2, "25"), (3, "33"), (3, "41")]


def test_grid_components_makes_no_pairs_of_tiles_that_share_a_place(spark, monkeypatch):
    rows = [(i, x, 0) for i, x in zip(range(300), [0, 1, 5] * 100)]
    seen, kept = [], spatial.kept
    monkeypatch.setattr(spatial, "kept", lambda df: seen.append(df := kept(df)) or df)
    out = {r.id: r.label for r in spatial.grid_components(spark.createDataFrame(rows, "id long, col int, row int")).collect()}
    assert out == {i: 2 if x == 5 else 0 for i, x, _ in rows}
    assert max(df.count() for df in seen) <= 5 * 3


def test_nearest_in_plane_has_cells_as_fine_as_dense_targets(spark):
    side = range(40)
    fixed = spark.createDataFrame([("a", 40 * i + j, i / 4, j / 4) for i in side for j in side], "g string, id long, x double, y double")
    moving = spark.createDataFrame([("a", 40 * i + j, i / 4 + 0.1, j / 4 - 0.05) for i in side for j in side], "g string, id long, x double, y double")
    near = spatial.nearest_in_plane(moving, fixed, "g", 16.0)
    assert all(r.id == r.target_id for r in near.collect())
    assert 0.25 / 8 < 16.0 / 4 ** spatial._finer(fixed, "g", 16.0) <= 0.25


def test_nearest_in_plane_sends_no_points_through_the_driver(spark, tmp_path):
    """Points of a small file are many rows at all levels: no size of a file may make them a broadcast."""
    rng = random.Random(6)
    moving = [("a", i, rng.uniform(0, 900), rng.uniform(0, 900)) for i in range(300)]
    fixed = [("a", i, rng.uniform(0, 900), rng.uniform(0, 900)) for i in range(30)]
    kind = "g string, id long, x double, y double"
    for name, rows in (("moving", moving), ("fixed", fixed)):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}")
    near = spatial.nearest_in_plane(spark.read.parquet(f"{tmp_path}/moving"), spark.read.parquet(f"{tmp_path}/fixed"), "g", 16.0)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.target_id for r in near.collect()}
    assert got == {i: min((math.hypot(fx - x, fy - y), k) for _, k, fx, fy in fixed)[1] for _, i, x, y in moving}
