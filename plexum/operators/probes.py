"""Codes, budgets and spot filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_codes(n_bits: int, ones: int, distance: int = 4) -> list[int]:
    """Codes of n_bits with so many ones, in ascending order, each at least `distance` from all before it."""
    out: list[int] = []
    code, last = (1 << ones) - 1, ((1 << ones) - 1) << (n_bits - ones)
    while code <= last:
        if all((code ^ c).bit_count() >= distance for c in out):
            out.append(code)
        low = code & -code  # the next number with as many ones
        up = code + low
        code = up | ((code ^ up) >> 2) // low
    return out


def code_size(genes: int, capacity: dict[int, int], spare: float = 1.05) -> int:
    """The smallest code length with room for the genes and a share of blanks."""
    fits = [n for n, room in capacity.items() if genes * spare < room]
    if not fits:
        raise ValueError(f"no code has room for {genes} genes")
    return min(fits)


def file_budget(counts: dict[str, int], total: int) -> dict[str, int]:
    """A total dealt over regions as evenly as their counts allow, by name."""
    out, left = dict.fromkeys(counts, 0), min(total, sum(counts.values()))
    while left:
        open_ = [k for k in sorted(counts) if out[k] < counts[k]]
        each = max(1, left // len(open_))
        for k in open_:
            step = min(each, counts[k] - out[k], left)
            out[k] += step
            left -= step
    return out


def density_filter(spots: DataFrame, x: str, y: str, blank: str, steps: tuple[float, float], level: float) -> DataFrame:
    """Spots in cells of a grid over (x, y) where fewer than a share `level` of all spots are blanks."""
    cell = {"_i": F.floor(F.col(x) / steps[0]), "_j": F.floor(F.col(y) / steps[1])}
    placed = spots.withColumns(cell)
    good = placed.groupBy("_i", "_j").agg((F.count_if(F.col(blank)) / (F.count("*") + F.lit(1e-9))).alias("_d")).where(F.col("_d") < level)
    return placed.join(good, ["_i", "_j"], "left_semi").drop("_i", "_j")


def within_distance(df: DataFrame, code: str, others: Sequence[int], distance: int) -> DataFrame:
    """Codes at least `distance` bits from each of a short list."""
    test = F.lit(True)
    for c in others:
        test = test & (F.bit_count(F.col(code).bitwiseXOR(F.lit(c).cast("long"))) >= distance)
    return df.where(test)


def round_peaks(intensities: Column, rounds: int, channels: int) -> Column:
    """The strongest channel of each round, the first of equals, from intensities laid out round by round."""
    parts = [F.slice(intensities, 1 + r * channels, channels) for r in range(rounds)]
    return F.array(*[(F.array_position(p, F.array_max(p)) - 1).cast("int") for p in parts])
