"""Melting temperatures by nearest neighbours, as Catalyst expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[float, float]
_SWAP = str.maketrans("ACGT", "TGCA")
_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = range(4)
SODIUM, STRAND, GAS = 0.39, 1e-9, 1.987  # mol/l of salt and of probe, cal/(mol K)


@dataclass(frozen=True)
class Model:
    """Enthalpy (kcal/mol) and entropy (cal/mol K) of neighbours, of the start, and of an end in A or T, or in G or C. Salt
    lowers the entropy of DNA; elsewhere it moves the temperature by a share of G and C."""

    pairs: dict[str, Pair]
    start: Pair = (0.0, 0.0)
    weak: Pair = (0.0, 0.0)
    strong: Pair = (0.0, 0.0)
    salt_in_entropy: bool = False

    def neighbours(self) -> dict[str, Pair]:
        """All sixteen pairs; those not listed are reverse complements of listed ones."""
        return {k[::-1].translate(_SWAP): v for k, v in self.pairs.items()} | self.pairs


#: DNA by Allawi and SantaLucia 1997, RNA by Chen 2012, RNA with DNA by the 2022 table for mixed duplexes.
MODELS = {
    "dna": Model({
        "AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
        "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9),
    }, weak=(2.3, 4.1), strong=(0.1, -2.8), salt_in_entropy=True),
    "rna": Model({
        "AA": (-7.09, -19.8), "AT": (-9.11, -25.8), "TA": (-8.50, -22.9), "CA": (-11.03, -28.8), "GT": (-11.98, -31.3),
        "CT": (-10.90, -28.5), "GA": (-13.21, -34.9), "CG": (-10.88, -27.4), "GC": (-16.04, -40.6), "GG": (-14.18, -35.0),
    }, start=(6.40, 6.99), weak=(3.85, 11.04)),
    "hybrid": Model({
        "AA": (-6.62, -18.5), "AT": (-6.37, -17.7), "AG": (-8.30, -21.8), "AC": (-9.79, -25.8),
        "TA": (-9.89, -30.0), "TT": (-5.33, -16.1), "TG": (-5.33, -12.7), "TC": (-9.29, -26.1),
        "GA": (-10.78, -29.3), "GT": (-9.26, -25.0), "GG": (-9.03, -20.9), "GC": (-14.06, -37.2),
        "CA": (-7.15, -18.7), "CT": (-4.79, -12.2), "CG": (-8.53, -22.1), "CC": (-5.28, -11.0),
    }, start=(-3.11, -18.8)),
}


def formamide_shift(gc: Column | float, percent: float) -> Column | float:
    """Degrees by so many percent of formamide, which has 1.13 g/ml and 45.04 g/mol; gc is a share of 1, read as percent."""
    return (0.453 * (gc / 100.0) - 2.88) * (percent * 10 * 1.13 / 45.04)


def salt_shift(gc: Column | float, sodium: float = SODIUM) -> Column | float:
    """Degrees by salt, against 1 mol/l, where it does not enter the entropy."""
    log = math.log(sodium)
    return (-1.842 * gc + 2.675) * log - 0.7348 * log * log


def _sum(seq: Column, model: Model, which: int) -> Column:
    """Sum of one of the two quantities over neighbours, ends and the start: each pair counts with overlaps."""
    out = F.lit(model.start[which])
    for pair, values in model.neighbours().items():
        out = out + F.regexp_count(seq, F.lit(f"{pair[0]}(?={pair[1]})")) * F.lit(values[which])
    for at in (F.left(seq, F.lit(1)), F.right(seq, F.lit(1))):
        out = out + F.when(at.isin("A", "T"), F.lit(model.weak[which])).when(at.isin("G", "C"), F.lit(model.strong[which])).otherwise(0.0)
    return out


def melting_temperature(seq: Column, model: str = "hybrid", formamide: float = 0.0, sodium: float = SODIUM, strand: float = STRAND) -> Column:
    """Degrees Celsius of a sequence bound without mismatches, in so many percent of formamide. Null for fewer than two bases."""
    # as a lambda's argument the sequence is computed once, not for each neighbour
    return F.get(F.transform(F.array(seq), lambda own: _melting(own, model, formamide, sodium, strand)), F.lit(0))


def _melting(seq: Column, model: str, formamide: float, sodium: float, strand: float) -> Column:
    own, n = MODELS[model], F.length(seq)
    gc = F.length(F.regexp_replace(seq, "[^GC]", "")) / F.nullif(n, F.lit(0))
    entropy = _sum(seq, own, 1) + (F.lit(0.368 * math.log(sodium)) * (n - 1) if own.salt_in_entropy else F.lit(0.0))
    celsius = F.lit(1000.0) * _sum(seq, own, 0) / (entropy + F.lit(GAS * math.log(strand))) - 273.15 + formamide_shift(gc, formamide)
    return F.when(n > 1, celsius if own.salt_in_entropy else celsius + salt_shift(gc, sodium))


class Sums:
    """Melting temperatures of the windows of one sequence, each from prefix sums, so that a window costs the same at any
    length. `celsius(a, b)` is of the bases from a up to b, `share(a, b)` their share of G and C."""

    def __init__(self, seq: str, model: str = "hybrid", formamide: float = 0.0, sodium: float = SODIUM, strand: float = STRAND):
        self.seq, self.model, self.formamide, self.sodium = seq, MODELS[model], formamide, sodium
        heat = self.model.neighbours()
        self.h, self.s, self.gc = [0.0], [0.0], [0]
        for i, base in enumerate(seq):
            h, s = heat.get(seq[i : i + 2], (0.0, 0.0))
            self.h.append(self.h[-1] + h)
            self.s.append(self.s[-1] + s)
            self.gc.append(self.gc[-1] + (base in "GC"))
        self.salt = 0.368 * math.log(sodium) if self.model.salt_in_entropy else 0.0
        self.strand = GAS * math.log(strand)

    def share(self, a: int, b: int) -> float:
        return (self.gc[b] - self.gc[a]) / (b - a)

    def celsius(self, a: int, b: int) -> float:
        m, gc = self.model, self.share(a, b)
        ends = [m.weak if c in "AT" else m.strong if c in "GC" else (0.0, 0.0) for c in (self.seq[a], self.seq[b - 1])]
        h, s = (t[b - 1] - t[a] + m.start[k] + ends[0][k] + ends[1][k] for k, t in enumerate((self.h, self.s)))
        out = 1000.0 * h / (s + (b - a - 1) * self.salt + self.strand) - 273.15 + formamide_shift(gc, self.formamide)
        return out if m.salt_in_entropy else out + salt_shift(gc, self.sodium)


def window_temperatures(seqs: list[str], length: tuple[int, int], model: str = "hybrid", formamide: float = 0.0, gc: Pair = (0.0, 1.0), sodium: float = SODIUM, strand: float = STRAND) -> np.ndarray:
    """Sums.celsius of all windows of texts of one length, by text, start and length, from length[0] on up to length[1]; -inf for
    windows that do not fit into the text or whose share of G and C lies out of bounds."""
    own, n, (low, high) = MODELS[model], len(seqs[0]), length
    codes = _CODE[np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8)].reshape(len(seqs), n)
    pairs = np.zeros((2, 5, 5))
    for pair, values in own.neighbours().items():
        pairs[:, "ACGT".index(pair[0]), "ACGT".index(pair[1])] = values
    ends = [np.array([own.weak[k], own.strong[k], own.strong[k], own.weak[k], 0.0])[codes] for k in (0, 1)]
    sums = [np.concatenate([np.zeros((len(seqs), 1)), np.cumsum(pairs[k][codes[:, :-1], codes[:, 1:]], axis=1)], axis=1) for k in (0, 1)]
    strong = np.concatenate([np.zeros((len(seqs), 1), np.int64), np.cumsum((codes == 1) | (codes == 2), axis=1)], axis=1)
    out = np.full((len(seqs), n, high - low + 1), -np.inf)
    salt = 0.368 * math.log(sodium) if own.salt_in_entropy else 0.0
    for size in range(low, min(high, n) + 1):
        m = n - size + 1
        share = (strong[:, size:] - strong[:, :m]) / size
        h, s = (t[:, size - 1 :] - t[:, :m] + own.start[k] + ends[k][:, :m] + ends[k][:, size - 1 :] for k, t in enumerate(sums))
        celsius = 1000.0 * h / (s + (size - 1) * salt + GAS * math.log(strand)) - 273.15 + formamide_shift(share, formamide)
        celsius = celsius if own.salt_in_entropy else celsius + salt_shift(share, sodium)
        out[:, :m, size - low] = np.where((share >= gc[0]) & (share <= gc[1]), celsius, -np.inf)
    return out
