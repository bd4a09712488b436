"""Screening of probe candidates: words, windows, alignments, off-target temperatures, tiers and code books."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexum.operators import ordering, spatial, tables
from plexum.operators.thermo import Sums, melting_temperature, window_temperatures


def words(spark: SparkSession, length: int, letters: str = "ACT", c_share: tuple[float, float] = (0.45, 0.55), a_share: float = 0.28, away: tuple[str, int] | None = None) -> DataFrame:
    """(n, seq): words of three letters with a bounded share of C and of A, no CCC, TTTT or AAAA, no four C in six letters that
    begin in the first seven, and over `away[1]` edits from `away[0]`. Numbers are digits; nothing is held but the word itself."""
    digit = lambda i: F.substring(F.lit(letters), (F.floor(F.col("n") / F.lit(len(letters) ** (length - 1 - i))) % len(letters) + 1).cast("int"), F.lit(1))
    df = spark.range(len(letters) ** length).withColumnRenamed("id", "n").withColumn("seq", F.concat(*[digit(i) for i in range(length)]))
    count = lambda c, s: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    s = F.col("seq")
    df = df.where(~s.rlike("CCC|TTTT|AAAA") & (count("C", s) / length).between(*c_share) & (count("A", s) / length < a_share))
    for i in range(min(7, length - 5)):
        df = df.where(count("C", F.substring("seq", i + 1, 6)) < 4)
    return df.where(F.levenshtein("seq", F.lit(away[0])) > away[1]) if away else df


def _letters_of(md: str) -> list[str]:
    """The reference letter at each aligned place of an MD tag; empty where the read's own letter matches."""
    out: list[str] = []
    for run, gap, letter in re.findall(r"(\d+)|\^([A-Z]+)|([A-Z])", md.upper()):
        out += [""] * int(run) if run else list(gap or letter)
    return out


def align_read(read: str | None, cigar: str | None, md: str | None) -> tuple[str, str, str] | None:
    """(reference, marks, read) as three texts of one length: | match, : mismatch, blank for gaps. Null for unmapped reads."""
    if not read or not cigar or cigar == "*" or not md:
        return None
    known, at, told, rows = _letters_of(md), 0, 0, ([], [], [])
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        own = read[at : at + n] if op in "MIS=X" else ""
        there = known[told : told + n] if op in "MDX=" else []
        ref = {"M": "".join(k or r for k, r in zip(there, own)), "=": own, "X": "".join(there), "D": "".join(there), "I": "-" * n, "N": "." * n, "S": "." * n, "P": "*" * n, "H": ""}[op]
        marks = {"M": "".join(":" if k else "|" for k in there), "=": "|" * n, "X": ":" * n, "H": ""}.get(op, " " * n)
        seen = {"D": "-" * n, "N": "." * n, "P": "*" * n, "H": "", "S": own.lower()}.get(op, own)
        for row, text in zip(rows, (ref, marks, seen)):
            row.append(text)
        at, told = at + len(own), told + len(there)
    return tuple("".join(row) for row in rows)


def pairwise(read: Column, cigar: Column, md: Column) -> Column:
    """align_read as a struct of reference, marks and read."""

    @F.pandas_udf("reference string, marks string, read string")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align_read(*x) or (None, None, None) for x in zip(a, b, c)], columns=["reference", "marks", "read"])

    return run(read, cigar, md)


def off_target_tm(aligned: Column, least: int = 15, formamide: float = 0.0, model: str = "hybrid") -> Column:
    """The highest melting temperature of runs of at least `least` matching bases; 0 without one."""
    marks = F.concat(aligned["marks"], F.lit(" "))
    # the ends of runs: cut the marks into pieces that each end a run, and sum their lengths
    pieces = F.regexp_extract_all(marks, F.lit(r"([|]+[^|]+|[^|]+)"), F.lit(1))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("runs"))
    folded = F.aggregate(pieces, empty, lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["runs"], F.array(F.substring(aligned["read"], acc["at"] + 1, F.length(p) - F.length(F.translate(p, "|", ""))))).alias("runs")))
    runs = F.filter(folded["runs"], lambda r: F.length(r) >= least)
    return F.coalesce(F.array_max(F.transform(runs, lambda r: melting_temperature(r, model, formamide))), F.lit(0.0))


def off_target(hits: DataFrame, accepted: DataFrame, formamide: float = 10.0) -> DataFrame:
    """hits (name, transcript, seq, cigar, md, match_consec): one row for each name with an accepted (transcript), its largest
    off-target temperature and longest off-target match. Equal alignments are computed once."""
    bad = hits.where("match_consec > 16").join(accepted.select("transcript"), "transcript", "left_anti")
    distinct = bad.select("seq", "cigar", "md").distinct().withColumn("aligned", pairwise(F.col("seq"), F.col("cigar"), F.col("md"))).withColumn("tm", off_target_tm(F.col("aligned"), formamide=formamide))
    same = reduce(lambda a, b: a & b, [bad[c].eqNullSafe(distinct[c]) for c in ("seq", "cigar", "md")])
    worst = bad.join(distinct, same).groupBy("name").agg(F.max("tm").alias("max_tm_offtarget"), F.max("match_consec").alias("match_consec_all"))
    good = tables.best_per_key(hits.join(accepted.select("transcript"), "transcript", "left_semi"), ["name"], ["transcript", "seq", "cigar"])
    return good.join(worst, "name", "left").na.fill({"max_tm_offtarget": 0.0, "match_consec_all": 0})


#: A place at which an N or too long a run of a base begins; cells of temperatures that are computed at once.
_RUNS, CELLS = re.compile("(?=(N|A{6}|T{6}|C{5}|G{5}))"), 1 << 20


def crawl(sequences: DataFrame, length: tuple[int, int] = (43, 55), gc: tuple[float, float] = (0.3, 0.7), tm: tuple[float, float] = (54, 68), formamide: float = 50.0, accept: Callable[[str], bool] | None = None, model: str = "hybrid") -> DataFrame:
    """sequences (name, seq): windows (name, seq, pos_start, pos_end). From each start the end moves on, never back, to the first
    window with fit GC that is warm enough; it counts unless too hot, with N, long runs of a base, or refused by `accept`."""
    def windows(seqs: list[str]) -> Iterator[tuple[int, int, int]]:
        """Row, start and stop of the windows of texts of one length: all temperatures at once, then start by start."""
        n = len(seqs[0])
        heat, ends = window_temperatures(seqs, length, model, formamide, gc), _run_ends(seqs)
        rows, masked = np.arange(len(seqs)), np.array([[c == "N" for c in s] for s in seqs])
        stop = np.full(len(seqs), length[0])
        for start in range(n - length[0]):
            live = rows[~masked[:, start]]
            low, last = np.maximum(stop[live], start + length[0]), min(start + length[1], n)
            warm = heat[live, start, : last - start - length[0] + 1]
            warm = np.where(start + length[0] + np.arange(warm.shape[1]) >= low[:, None], warm, -np.inf)
            fit = warm > tm[0]
            found, at = fit.any(axis=1), fit.argmax(axis=1)
            end = start + length[0] + at
            stop[live] = np.where(found, end, np.maximum(low, last + 1))
            good = found & (warm[np.arange(len(live)), at] <= tm[1]) & (ends[live, start] > end)
            for row, b in zip(live[good].tolist(), end[good].tolist()):
                if accept is None or accept(seqs[row][start:b]):
                    yield row, start, b

    def run(frames):
        for pdf in frames:
            names, seqs = pdf["name"].tolist(), [s.upper() if s else "" for s in pdf["seq"]]
            sizes = np.array([len(s) for s in seqs], np.int64)
            rows = []
            for n in np.unique(sizes[sizes > length[0]]).tolist():
                alike, step = np.flatnonzero(sizes == n), max(1, CELLS // (n * (length[1] - length[0] + 1)))
                for k in range(0, len(alike), step):
                    of = alike[k : k + step].tolist()
                    rows += [(f"{names[of[r]]}:{a}-{b - 1}", seqs[of[r]][a:b], a, b - 1) for r, a, b in windows([seqs[i] for i in of])]
            yield pd.DataFrame(rows, columns=["name", "seq", "pos_start", "pos_end"])

    return ordering.spread(sequences.select("name", "seq")).mapInPandas(run, "name string, seq string, pos_start long, pos_end long")


def _run_ends(seqs: list[str]) -> np.ndarray:
    """For each place of texts of one length where the first N or long run that begins there or later has ended; past all, where none is."""
    n = len(seqs[0])
    out = np.full((len(seqs), n + 1), n + 1)
    for row, seq in enumerate(seqs):
        for m in _RUNS.finditer(seq):
            out[row, m.start()] = m.start() + len(m[1])
    return np.minimum.accumulate(out[:, ::-1], axis=1)[:, ::-1]


def split_arms(probes: DataFrame, target: float, seq: str = "seq", hairpin: Callable[[str], float] | None = None) -> DataFrame:
    """probes with padlock, splint and pad_start: two neighbouring pieces of a probe, each the shortest over 5 degrees warmer
    than the target. The first one begins in the first eight bases, has 18 to 27 and no hairpin over the target; the second
    follows at once or one base on, the latter preferred, has 18 to 29 and a hairpin less than 2 degrees over it. `hairpin` gives
    a hairpin's temperature; without it none is looked for. Probes without such pieces have empty texts and -1."""
    fields = "padlock string, splint string, pad_start int"

    def split(own: str) -> tuple[str, str, int]:
        sums = Sums(own)
        for start in range(8):
            ends = range(start + 18, min(start + 28, len(own) + 1))
            stop = next((e for e in ends if sums.celsius(start, e) - 5 > target), ends[-1] if ends else None)
            if stop is None or (hairpin and hairpin(own[start:stop]) > target):
                continue
            for at in (stop + 1, stop):
                ends = (at + j for j in range(18, 30) if at + j < len(own) and sums.celsius(at, at + j) - 5 > target)
                if end := next((e for e in ends if not hairpin or hairpin(own[at:e]) < target + 2), None):
                    return own[start:stop], own[at:end], at
        return "", "", -1

    @F.pandas_udf(fields)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split(t.upper()) if t else ("", "", -1) for t in texts], columns=["padlock", "splint", "pad_start"])

    return ordering.spread(probes).withColumn("_arms", run(F.col(seq))).select(*probes.columns, "_arms.*")


def tiered_selection(probes: DataFrame, group: str, tiers: int, overlap: int, enough: int) -> DataFrame:
    """probes (group, id, start, stop, priority from 1): tier i selects among priorities up to i, the first greedily, later ones by
    weight sqrt(tiers + 1 - priority). Of each group the first tier that selects over `enough` counts, else the last."""
    picked = None
    for i in range(1, tiers + 1):
        run = probes.where(F.col("priority") <= i)
        if i == 1:
            found = spatial.greedy_intervals(run.select(group, "id", "start", "stop"), group, overlap).select(group, "id")
        else:
            found = spatial.best_intervals(run.select(group, "id", "start", "stop", F.sqrt(tiers + 1 - F.col("priority")).alias("weight")), group, overlap).select(group, "id")
        found = found.withColumn("tier", F.lit(i))
        picked = found if picked is None else picked.unionByName(found)
    sizes = picked.groupBy(group, "tier").agg(F.count("*").alias("n")).groupBy(group)
    chosen = sizes.agg(F.coalesce(F.min(F.when(F.col("n") > enough, F.col("tier"))), F.max("tier")).alias("tier"))
    return picked.join(chosen, [group, "tier"], "left_semi")


def relaxed_selection(select: Callable[[int], DataFrame], group: str, overlaps: Sequence[int], minimum: int) -> DataFrame:
    """select(overlap) gives (group, ...); of each group the rows of the first overlap that gives `minimum`, else of the last."""
    runs = reduce(lambda a, b: a.unionByName(b), [select(o).withColumn("overlap", F.lit(o)) for o in overlaps])
    place = F.array_position(F.array(*[F.lit(o) for o in overlaps]), F.col("overlap"))
    sizes = runs.groupBy(group, "overlap").agg(F.count("*").alias("n")).withColumn("p", place)
    chosen = sizes.groupBy(group).agg(F.coalesce(F.min(F.when(F.col("n") >= minimum, F.col("p"))), F.max("p")).alias("p")).select(group, F.element_at(F.array(*[F.lit(o) for o in overlaps]), F.col("p").cast("int")).alias("overlap"))
    return runs.join(chosen, [group, "overlap"], "left_semi")


def related_transcripts(counts: DataFrame, genes: Sequence[str]) -> DataFrame:
    """counts (transcript, transcript_name, count) with is_related, significant (over a tenth of the largest count) and
    maybe_acceptable: a predicted gene with over half of it that counts more than the least of the related."""
    names = "|".join(re.escape(g) for g in genes)
    rows = counts.withColumn("is_related", F.coalesce(F.col("transcript_name").rlike(f"^({names})-"), F.lit(False)) | F.col("transcript").isin(*genes))
    top = rows.agg(F.max("count").alias("_top"), F.min(F.when(F.col("is_related"), F.struct("count", "transcript"))).alias("_last"))
    before = (F.col("count") > F.col("_last.count")) | ((F.col("count") == F.col("_last.count")) & (F.col("transcript") > F.col("_last.transcript")))
    maybe = F.col("transcript_name").startswith("Gm") & (F.col("count") > 0.5 * F.col("_top")) & before
    out = rows.join(F.broadcast(top)).withColumns({"significant": F.col("count") > 0.1 * F.col("_top"), "maybe_acceptable": F.coalesce(maybe, F.lit(False))})
    return out.drop("_top", "_last")


def name_faults(names: DataFrame, name: str) -> DataFrame:
    """(name, n, fault) of names that are not ASCII or come more than once."""
    n = names.where(F.col(name) != "").groupBy(name).agg(F.count("*").alias("n"))
    fault = F.when(~F.col(name).rlike(r"^[\x00-\x7F]*$"), "not ASCII").when(F.col("n") > 1, "repeated")
    return n.withColumn("fault", fault).where("fault is not null")


def export_codes(genes: DataFrame, gene: str, codes: Sequence[int], bits: int, seed: int, offset: int = 1) -> DataFrame:
    """(name, code_bits): codes dealt to genes in an order that the seed's digest decides; codes left over are blanks."""
    n = genes.limit(len(codes) + 1).count()
    if n > len(codes):
        raise ValueError(f"over {len(codes)} genes for {len(codes)} codes")
    session = genes.sparkSession
    shuffled = session.createDataFrame([(c,) for c in codes], "code long").withColumn("i", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("code").cast("string"))), "code")))
    named = genes.select(F.col(gene).cast("string").alias("name"), F.row_number().over(Window.orderBy(gene)).alias("i"))  # at most as many as codes
    on = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.expr("code").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) > 0)
    name = F.coalesce("name", F.concat(F.lit("Blank-"), (F.col("i") - n).cast("string")))
    return shuffled.join(named, "i", "left").select(name.alias("name"), F.transform(on, lambda b: b + offset).alias("code_bits"))


def project(counts: DataFrame, loadings: DataFrame, cell: str, gene: str, value: str) -> DataFrame:
    """counts (cell, gene, value) and loadings (gene, pc1, pc2), few genes: each cell's two projections and their angle."""
    both = counts.join(loadings, gene).groupBy(cell).agg(F.sum(F.col(value) * F.col("pc1")).alias("p1"), F.sum(F.col(value) * F.col("pc2")).alias("p2"))
    turn = F.atan2(F.col("p2"), F.col("p1") + 1.0) + F.pi() / 2
    return both.withColumn("angle", F.pmod(turn, 2 * F.pi()) - F.pi())


def orthogonal_columns(df: DataFrame, columns: Sequence[str], given: Sequence[str], k: int) -> list[str]:
    """k of columns that tell most beside those given, one at a time: each is the one with most variance left once those before
    it are regressed out. Rows are read once, for the sums of products; what follows is a pivoted factor of that matrix."""
    every = [*given, *columns]
    sums = df.agg(*[F.covar_pop(a, b).alias(f"_{i}_{j}") for i, a in enumerate(every) for j, b in enumerate(every) if j >= i]).first()
    left = np.array([[sums[f"_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(every))] for i in range(len(every))])
    floor, out = 1e-10 * max(np.trace(left), 1e-300), []
    for step in range(len(given) + k):
        free = [i for i, c in enumerate(every) if c in columns and c not in out]
        pick = step if step < len(given) else max(free, key=lambda i: (left[i, i], -i), default=None)
        if pick is None or (step >= len(given) and left[pick, pick] <= floor):
            break
        if step >= len(given):
            out.append(every[pick])
        if left[pick, pick] > floor:
            left = left - np.outer(left[:, pick], left[:, pick]) / left[pick, pick]
    return out


def variance_captured(df: DataFrame, columns: Sequence[str], selected: Sequence[str], components: int) -> float:
    """The share of the leading principal components' variance that a regression on the selected columns explains."""
    sums = df.agg(*[F.covar_pop(a, b).alias(f"_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]).first()
    cov = np.array([[sums[f"_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(columns))] for i in range(len(columns))])
    values, vectors = np.linalg.eigh(cov)
    top = vectors[:, np.argsort(values)[::-1][:components]]
    at = [list(columns).index(c) for c in selected]
    cross = cov[at] @ top
    explained = np.trace(cross.T @ np.linalg.pinv(cov[np.ix_(at, at)]) @ cross)
    return float(explained / np.trace(top.T @ cov @ top))


def blank_classifier(spots: DataFrame, features: Sequence[str], blank: str, depth: int = 4) -> DataFrame:
    """spots with p_blank, a decision tree's chance that a spot is a blank; null for spots without one of the features, which
    the tree is not fitted on."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="keep").transform(spots.withColumn("_y", F.col(blank).cast("double")))
    whole = F.forall(vector_to_array("_f"), lambda v: ~F.isnan(v))
    model = DecisionTreeClassifier(featuresCol="_f", labelCol="_y", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_k", maxDepth=depth, seed=0).fit(ready.where(whole))
    return model.transform(ready).withColumn("p_blank", F.when(whole, F.element_at(vector_to_array("_p"), 2))).drop("_f", "_y", "_p", "_r", "_k")
