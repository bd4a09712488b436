"""Counts of k-mers against a counter, and bound sequences in temperatures."""

from collections import Counter

import pytest
from plexum.operators import kmers
from plexum.operators.thermo import melting_temperature
from pyspark.sql import functions as F


@pytest.mark.parametrize("k,part", [(1, kmers.PART), (5, kmers.PART), (5, 3), (40, kmers.PART)])
def test_counts_like_counter(spark, monkeypatch, k, part):
    monkeypatch.setattr(kmers, "PART", part)
    texts = ["abcabcabcabc", "", None, "ab", "éß漢🙂é" * 20, "x" * 300, "".join(map(chr, range(0x4E00, 0x5200))), "abcabc"]
    want = Counter(t[i : i + k] for t in texts if t for i in range(len(t) - k + 1))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert {r.kmer: r.n for r in kmers.counts(df, "text", k).collect()} == want
    assert kmers.counts(df.limit(0), "text", k).count() == 0


def test_sequence_is_bound_once(spark):
    seq = F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    plan = spark.range(3).select(melting_temperature(seq, "dna").alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == 1
