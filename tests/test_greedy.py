"""Choices in order, in rounds, against the sequential fold."""

import random
from itertools import cycle, permutations

import numpy as np
import pytest

from plexum.operators import assembly, greedy


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, above = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(above[j] + 1, d[-1] + 1, above[j - 1] + (x != y)))
    return d[-1]


def test_edits_like_table():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ABCé") for _ in range(n))
    texts, words = [word(rng.randrange(0, 70)) for _ in range(60)], [word(rng.randrange(0, 64)) for _ in range(20)] + ["", "A", word(63)]
    for distance in (0, 1, 6, 30):
        assert (greedy.edits_below(texts, words, distance) == np.array([[edits(t, w) < distance for w in words] for t in texts])).all()
    assert greedy.edits_below([], words, 3).shape == (0, 23)
    with pytest.raises(ValueError):
        greedy.edits_below(["a"], ["b" * 64], 3)


@pytest.mark.parametrize("block", [greedy.BLOCK, 7])
def test_words_apart_like_fold(spark, monkeypatch, block):
    monkeypatch.setattr(greedy, "BLOCK", block)
    rng = random.Random(2)
    words = [("".join(rng.choice("ACT") for _ in range(rng.randrange(5, 10))), rng.randrange(40)) for _ in range(200)]
    df = spark.createDataFrame([*words, (None, 0), ("", 3)], "w string, o int").repartition(5)
    want = []
    first = {}
    for w, o in [*words, ("", 3)]:
        first[w] = min(o, first.get(w, o))
    for w in sorted(first, key=lambda w: (first[w], w)):
        if all(edits(w, t) >= 4 for t in want):
            want.append(w)
    got = greedy.words_apart(df, "w", "o", 4)
    assert [r.w for r in got.orderBy("place").collect()] == want and len(want) > 10
    assert greedy.words_apart(df.limit(0), "w", "o", 4).count() == 0


def test_pairs_like_fold(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(60), rng.randrange(300)) for _ in range(500)] + [(1, 1, k) for k in range(50)]
    rows += [(100 + k, 100 + k + e, 2 * k + e) for k in range(12) for e in (0, 1)]  # a chain of pairs, each later than the one before
    df = spark.createDataFrame([*rows, (None, 1, 0), (1, None, 0)], "i int, j int, k int").repartition(4)
    a, b, want = set(), set(), set()
    for i, j, _ in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if i not in a and j not in b:
            a.add(i)
            b.add(j)
            want.add((i, j))
    got = [tuple(r) for r in greedy.first_free_pairs(df, "i", "j", "k").collect()]
    assert set(got) == want and len(got) == len(want)
    assert greedy.first_free_pairs(df.limit(0), "i", "j", "k").count() == 0


@pytest.mark.parametrize("codes", [[1, 2], [2, 3, 1], [4]])
def test_encoding_like_one_cycle_over_all(spark, codes):
    """Over several partitions, with ties, the cycle goes on as it would through one list."""
    rng = random.Random(4)
    readouts = {k: "".join(rng.choice("ACT") for _ in range(20)) for k in range(1, 5)}
    pads = ["".join(rng.choice("ACGT") for _ in range(12)) for _ in range(300)]
    for k in range(0, 300, 4):
        pads[k] = ("GGGGG", "AAAAG" + pads[k], "TTTT" + pads[k], "GATCC" + pads[k])[k // 4 % 4]
    rows = [(f"p{i:03d}", pad, i % 90) for i, pad in enumerate(pads)]
    turns, want = cycle(permutations(codes)), []
    for name, pad, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        for sep, own in zip(("AA", "TA", "AT", "TT"), turns):
            seq = sep.join(readouts[c][::-1].translate(str.maketrans("ACGT", "TGCA")).lower() for c in own) + pad
            if any(x in seq for x in ("AAAAAA", "TTTTTT", "CCCCC", "GGGGG")) or "GGATCC" in seq.upper():
                continue
            want.append((name, seq, *own))
            break
    df = spark.createDataFrame([*rows, ("null", None, 5)], "name string, padlock string, o int").repartition(6)
    got = assembly.encode_probes(df, readouts, codes, ["o", "name"])
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(want) < 300
    assert assembly.encode_probes(df.limit(0), readouts, codes, ["o", "name"]).count() == 0
