import math

import pytest
from pyspark.sql import functions as F

from plexum.functions import numbers as N
from plexum.functions import sequences as S
from plexum.operators import spatial, thermo
from plexum.sources import readers, writers
from plexum.streaming.counts import windowed_counts


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_sequences(spark):
    lit = F.lit
    assert one(spark, S.reverse_complement(lit("AACG"))) == "CGTT"
    assert one(spark, S.rotate(lit("abcdef"), 2)) == "cdefab"
    assert one(spark, S.gc_content(lit("GATC"))) == 0.5
    assert one(spark, S.gc_content(lit(""))) is None
    assert one(spark, S.kmers(lit("ABCD"), 3)) == ["ABC", "BCD"] and one(spark, S.kmers(lit("A"), 3)) == []
    assert one(spark, S.cigar_expand(lit("3M1D2M"))) == "MMMDMM"
    assert one(spark, S.md_match(lit("20A31"))) == 51 and one(spark, S.md_longest(lit("10^AC42"))) == 42
    assert one(spark, S.has_site(lit("AAGGATCCAA"), "GGATCC")) and not one(spark, S.has_site(lit("AAAA"), "GGATCC", ""))
    assert one(spark, S.pcr(lit("TTACGTAAGGCATT"), "ACG", "TGCC")) == "ACGTAAGGCA"
    # the last place of the reverse site behind the primer, not one before it
    assert one(spark, S.pcr(lit("GGCATTACGTAAGGCATTGGCATT"), "ACG", "TGCC")) == "ACGTAAGGCATTGGCA" and one(spark, S.pcr(lit("GGCATTACG"), "ACG", "TGCC")) is None
    assert one(spark, S.clipped_match(lit("5S30M2I40M"))) == (5, 30) and one(spark, S.clipped_match(lit("30M2I40M"))) == (0, 40) and one(spark, S.clipped_match(lit("*"))) == (0, 0)
    assert one(spark, S.duration_seconds(lit("1h30m"))) == 5400 and one(spark, S.duration_seconds(lit("x"))) is None
    assert one(spark, S.format_si(lit(1500.0))) == "1.5k"
    assert one(spark, S.well_name(lit(13))) == "B02" and one(spark, S.well_name(lit(9), by_column=True)) == "B02"


def test_numbers(spark):
    assert one(spark, N.bits(F.lit(6).cast("long"), 4)) == [0, 1, 1, 0]
    assert one(spark, N.unit(F.array(F.lit(0.0), F.lit(0.0)))) == pytest.approx([2**-0.5] * 2)
    assert one(spark, N.phase(F.lit(0.0), F.lit(-1.0))) == pytest.approx(3.14159265)
    assert one(spark, N.quantile_nearest(F.array(*[F.lit(float(i)) for i in range(11)]), 0.1)) == 1.0
    assert 50 < one(spark, thermo.melting_temperature(F.lit("ACGTACGTACGTACGTACGT"), "dna")) < 80
    # AAC, hybrid: H -3.11 - 6.62 - 9.79, S -18.8 - 18.5 - 25.8; a third G or C; 10 % formamide
    log, gc = math.log(0.39), 1 / 3
    warm = -19520 / (-63.1 + 1.987 * math.log(1e-9)) - 273.15 + (-1.842 * gc + 2.675) * log - 0.7348 * log**2 + (0.453 * gc / 100 - 2.88) * 113 / 45.04
    assert one(spark, thermo.melting_temperature(F.lit("AAC"), "hybrid", 10.0)) == pytest.approx(warm)
    # AAC, dna: H -7.9 - 8.4 + 2.3 + 0.1, S -22.2 - 22.4 + 4.1 - 2.8 and salt
    cold = -13900 / (-43.3 + 0.368 * 2 * log + 1.987 * math.log(1e-9)) - 273.15
    assert one(spark, thermo.melting_temperature(F.lit("AAC"), "dna")) == pytest.approx(cold)
    for model in thermo.MODELS:
        sums, text = thermo.Sums("GGACTNACGTTGCAAC", model, 20.0), "ACTNACGTTGCA"
        assert sums.celsius(2, 14) == pytest.approx(one(spark, thermo.melting_temperature(F.lit(text), model, 20.0)))
    assert one(spark, thermo.melting_temperature(F.lit("A"))) is None


def test_edges_of_boxes_and_rings(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 0.5, 0.0, 1.5, 1.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 0.2, 0.5), (1, 0.7, 0.5), (2, 0.7, 0.5), (2, 1.2, 0.5), (2, 1.0, 0.5), (2, 1.5, 0.5)], "tile int, x double, y double")
    kept = {tuple(r) for r in spatial.exclusive(points, boxes, 0.4).collect()}
    assert kept == {(1, 0.2, 0.5), (1, 0.7, 0.5), (2, 1.2, 0.5)}
    ring = spark.createDataFrame([(7, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], "label int, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (2.1, 1.0), (0.0, 0.0)], "x double, y double")
    assert {(r.x, r.y) for r in spatial.points_in_polygons(p, ring, 0.7).collect()} == {(1.0, 1.0), (2.0, 1.0), (0.0, 0.0)}


def test_intervals(spark):
    rows = spark.createDataFrame([("g", i, s, e, 1.0) for i, (s, e) in enumerate([(0, 5), (3, 8), (5, 9), (8, 12)])], "g string, id int, start int, stop int, weight double")
    taken = lambda df: sorted(r.id for r in df.collect())
    assert taken(spatial.greedy_intervals(rows, "g", 0)) == [0, 3]
    assert taken(spatial.greedy_intervals(rows, "g", -2)) == [0, 2, 3]
    heavy = rows.withColumn("weight", F.when(F.col("id") == 2, 3.0).otherwise(F.col("weight")))
    assert taken(spatial.best_intervals(heavy, "g", 1)) == [0, 2]
    assert len(taken(spatial.best_intervals(rows, "g", 1))) == 2
    assert {tuple(r) for r in spatial.coverage(rows.where("id < 2"), "g").collect()} == {("g", 0, 2, 1), ("g", 3, 5, 2), ("g", 6, 8, 1)}


def test_text_formats(spark, tmp_path):
    (tmp_path / "t.txt").write_text("dim=2\n# c\n0001.tif; ; (0.0, 0.0)\nCH1-0002.tif; ; (10.5, -20.0)\n")
    assert [tuple(r) for r in readers.tile_list(spark, str(tmp_path / "t.txt")).orderBy("index").collect()] == [(None, 1, "0001.tif", 0.0, 0.0), ("CH1-", 2, "CH1-0002.tif", 10.5, -20.0)]
    (tmp_path / "a.fa").write_text(">id.2 words here\nACGT\nAC\n>b\nGG\n")
    assert {tuple(r) for r in readers.fasta(spark, str(tmp_path / "a.fa")).collect()} == {("id.2", "words here", "ACGTAC"), ("b", "", "GG")}
    (tmp_path / "c.json").write_text('{"GeneA": [1, 2, 3], "Blank-1": [4, 5, 6]}')
    codes = readers.code_book(spark, str(tmp_path / "c.json"))
    assert {(r.target, r.is_blank) for r in codes.collect()} == {("GeneA", False), ("Blank-1", True)}
    assert [r.target for r in readers.usable_codes(codes, [1, 2, 3]).collect()] == ["GeneA"]
    (tmp_path / "g.gtf").write_text('#x\n1\ts\ttranscript\t1\t9\t.\t+\t.\tgene_id "G1.4"; transcript_id "T1.2"; tag "b"; tag "a";\n1\ts\texon\t1\t9\t.\t+\t.\tgene_id "G1.4";\n')
    got = readers.gtf(spark, str(tmp_path / "g.gtf")).collect()
    assert [(r.gene_id, r.transcript_id, r.tags) for r in got] == [("G1", "T1", ["a", "b"])]
    (tmp_path / "x.sam").write_text("@HD\nr1\t0\tT1\t5\t40\t52M\t*\t0\t0\tACGT\tAS:i:-3\tMD:Z:20A31\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\n")
    assert [(r.name, r.AS, r.match, r.match_consec) for r in readers.sam(spark, str(tmp_path / "x.sam")).orderBy("name").collect()] == [("r1", -3, 51, 31), ("r2", None, 0, 0)]
    writers.parquet(codes, str(tmp_path / "o"))
    writers.parquet(codes.limit(0), str(tmp_path / "o"))
    assert readers.tables(spark, str(tmp_path / "o"), ["target"]).count() == 2


def test_stream(spark, tmp_path):
    spark.range(10).selectExpr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) as ts", "'a' as k").write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in")), "k")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sum(r.n for r in spark.table("counted").collect()) == 10


def test_codes_and_budgets():
    from plexum.operators import probes

    codes = probes.spread_codes(10, 3)
    assert all(c.bit_count() == 3 for c in codes) and all((a ^ b).bit_count() >= 4 for i, a in enumerate(codes) for b in codes[:i])
    assert probes.code_size(100, {10: 90, 12: 106, 14: 300}) == 12
    assert probes.file_budget({"a": 2, "b": 10, "c": 5}, 12) == {"a": 2, "b": 5, "c": 5}
