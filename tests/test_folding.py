"""Hairpins against a slow recursion over one sequence at a time."""

import random
from functools import cache

import numpy as np
from pyspark.sql import functions as F

from plexum.operators import commands, folding, screening
from plexum.operators.thermo import MODELS
from plexum.plans import commands as plans


def slow(seq, sodium):
    own, n = MODELS["dna"].neighbours(), len(seq)
    weak = lambda i: seq[i] in "AT"
    end = lambda i: (folding.END_AT[0] * weak(i), folding.END_AT[1] * weak(i))
    cost = lambda g: (0.0, -g * 1000 / 310.15)
    free = lambda x: x[0] - 310.15 * x[1] / 1000
    add = lambda *xs: (sum(x[0] for x in xs), sum(x[1] for x in xs))

    def stack(i, k):
        h, s = own[seq[i] + seq[k]]
        return h, s + 0.368 * np.log(sodium)

    @cache
    def best(i, j):
        if {seq[i], seq[j]} not in ({"A", "T"}, {"C", "G"}) or j - i <= 3:
            return None
        options = [add(end(i), cost(folding.loop(folding.HAIRPIN, j - i - 1)))]
        for k in range(i + 1, j):
            for m in range(k + 1, j):
                gap = k - i - 1, j - m - 1
                inside = best(k, m) if sum(gap) <= folding.MOST else None
                if inside is None:
                    continue
                if sum(gap) == 0:
                    options.append(add(inside, stack(i, k)))
                elif sum(gap) == 1:
                    options.append(add(inside, stack(i, k), cost(folding.BULGE[1])))
                else:
                    options.append(add(inside, end(i), end(k), cost(folding.loop(folding.INNER if all(gap) else folding.BULGE, sum(gap)))))
        return min(options, key=free)

    whole = [add(x, end(i)) for i in range(n) for j in range(i + 1, n) if (x := best(i, j))]
    h, s = min(whole, key=free, default=(0.0, 0.0))
    return h * 1000 / s - 273.15 if h < 0 and s < 0 else 0.0


def test_like_slow_recursion():
    rng = random.Random(5)
    words = ["".join(rng.choice("ACGT") for _ in range(rng.choice((5, 9, 14, 18)))) for _ in range(1000)]
    got = folding.celsius(words)
    want = np.array([slow(w, folding.SODIUM) for w in words])
    same = np.isclose(got, want, atol=1e-6)
    # of folds of equal energy another may be told; nothing else differs
    assert same.mean() > 0.995 and ((got != 0) == (want != 0)).mean() > 0.995 and (want != 0).sum() > 50


def test_known_folds_and_odd_sequences(spark):
    stem = "GCGCATGC"
    turned = stem[::-1].translate(str.maketrans("ACGT", "TGCA"))
    hot, bulged, cool, none = folding.celsius([stem + "TTTT" + turned, stem[:4] + "A" + stem[4:] + "TTTT" + turned, stem[:4] + "TTTT" + turned[-4:], "ACACACACACAC"])
    assert hot > bulged > 40 and hot > cool > 0 and none == 0
    assert folding.celsius([None, "", "ACG", "NNNNNNNNNN"]).tolist() == [0, 0, 0, 0]
    assert folding.celsius([(stem + "TTTT" + turned).lower()])[0] == hot and folding.celsius([stem + "TTTT" + turned], formamide=30.0)[0] < hot
    df = spark.createDataFrame([(stem + "TTTT" + turned,), (None,)], "seq string")
    assert sorted(r.t for r in df.select(folding.hairpin_temperature(F.col("seq")).alias("t")).collect()) == [0.0, hot]


def test_rules_that_take_hairpins(spark):
    """Barcodes, arms and windows are refused for their hairpins."""
    folds, plain = "CCTACACTTCTGTGTAGGCA", "CATCACTCCATCCACCATAC"
    df = spark.createDataFrame([(folds, 0), (plain, 1)], "word string, i int")
    take = lambda accept: {r.word for r in commands.orthogonal_words(df, "word", "i", ["T" * 20], tm=(30, 90), accept=accept).collect()}
    assert take(None) == {folds, plain} and take(commands.without_hairpin) == {plain}
    probe = "ACGTTGCAACGATCAGGCTAAGTCCGATTGCAATGCCGTTAGCATCGGATCATGCAATCGGATTACGCATGCAAGTCCGTAGCATTAGCCAGTCGAA"
    arms = spark.createDataFrame([(probe,)], "seq string")
    free = screening.split_arms(arms, 40.0).first()
    strict = screening.split_arms(arms, 40.0, hairpin=lambda s: 99.0).first()
    real = screening.split_arms(arms, 40.0, hairpin=lambda s: float(folding.celsius([s])[0])).first()
    assert free.pad_start > 0 and strict.pad_start == -1
    assert real.pad_start == -1 or folding.celsius([real.padlock])[0] <= 40.0 and folding.celsius([real.splint])[0] < 42.0
    windows = spark.createDataFrame([("t", probe)], "name string, seq string")
    some = {r.seq for r in screening.crawl(windows, (20, 30), (0.2, 0.8), (-50, 95), accept=lambda w: folding.celsius([w])[0] <= 0).collect()}
    every = {r.seq for r in screening.crawl(windows, (20, 30), (0.2, 0.8), (-50, 95)).collect()}
    assert some == {w for w in every if folding.celsius([w])[0] <= 0} and len(some) < len(every)
    hits = spark.createDataFrame([("p", "t", "GCGCATGCTTTTGCATGCGCACACAC", "26M", "26", 26, 26, 26)], "name string, transcript string, seq string, cigar string, md string, match int, match_consec int, length int")
    best = commands.candidates(hits, hits.select("transcript"), hairpin=folding.hairpin_temperature).first()
    assert best.hp == folding.celsius([best.seq])[0] > 50


def test_hairpins_are_folded_in_several_tasks(spark):
    part = spark.range(200).withColumnRenamed("id", "p_partkey").coalesce(1)
    out = plans.hairpin_temperatures(part)
    assert out.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 4
