"""From screened probes to tables that are ordered and exported."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexum.functions import sequences as S
from plexum.operators import greedy


def equal_to(df: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns have the given values, or one of a list of them."""
    tests = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set, frozenset)) else F.col(k) == v for k, v in values.items()]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def chained_left(df: DataFrame, others: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """df with the columns of each other table joined by its key; rows without a match keep nulls."""
    return reduce(lambda out, other: out.join(other[0], other[1], "left"), others, df)


def arms_side_by_side(probes: DataFrame, name: str = "name", seq: str = "seq", carried: Sequence[str] = ()) -> DataFrame:
    """One row for each pair of arms: name, splint, padlock, and the first of each carried column. The name's first two parts,
    between underscores, are the pair's name, its third the arm; several texts of an arm are joined."""
    part = F.split(F.col(name), "_")
    arm = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(part[2] == kind, F.col(seq)))), "").alias(kind)
    return probes.groupBy(F.concat_ws("_", part[0], part[1]).alias("name")).agg(arm("splint"), arm("padlock"), *[F.min_by(c, F.struct(name, seq)).alias(c) for c in carried])


def spaced(df: DataFrame, group: str, at: str, tie: str, gap: int = 50) -> DataFrame:
    """Rows of a group by place, from the end backwards: whatever stands next before a row, less than gap away, goes, and may
    not remove others itself once it is gone. Places are numbers; the fold holds one group's places, not its rows. Of rows of one
    place and tie one stays."""
    places = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))), lambda a, b: F.when(a["at"] > b["at"], -1).when(a["at"] < b["at"], 1).when(a["tie"] > b["tie"], -1).when(a["tie"] < b["tie"], 1).otherwise(0))
    kind = f"struct<last:{df.schema[at].dataType.simpleString()},kept:array<struct<at:{df.schema[at].dataType.simpleString()},tie:{df.schema[tie].dataType.simpleString()}>>>"
    zero = F.from_json(F.lit('{"kept":[]}'), kind)

    def step(acc: Column, x: Column) -> Column:
        near = acc["last"].isNotNull() & (acc["last"] - x["at"] < gap)
        return F.when(near, acc).otherwise(F.struct(x["at"].alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept")))

    kept = df.groupBy(group).agg(F.aggregate(places, zero, step)["kept"].alias("_k")).select(group, F.inline("_k").alias(at, tie))
    same = F.row_number().over(Window.partitionBy(group, at, tie).orderBy(F.xxhash64(*df.columns)))
    return df.join(kept, [group, at, tie], "left_semi").withColumn("_s", same).where("_s = 1").select(df.columns)


def with_heads_again(df: DataFrame, group: str, order: Sequence[Column], too_few: int = 4, full: int = 12) -> DataFrame:
    """Groups of at least too_few rows; of those below twice that the first rows once more, as many as are missing to `full`,
    twice the group's rows at most (of which there is one copy each). Column `again` tells these."""
    by = Window.partitionBy(group)
    x = df.withColumns({"_n": F.count("*").over(by), "_r": F.row_number().over(by.orderBy(*order))}).where(F.col("_n") >= too_few)
    more = x.where((F.col("_n") < 2 * too_few) & (F.col("_r") <= F.least(full - F.col("_n"), 2 * F.col("_n"))))
    return x.withColumn("again", F.lit(False)).unionByName(more.withColumn("again", F.lit(True))).drop("_n", "_r")


def filter_counts(counts: DataFrame, cell: str, gene: str, value: str = "n", min_genes: int = 0, min_cells: int = 0, min_counts: int = 0, max_counts: int | None = None) -> DataFrame:
    """Counts of cells with enough genes and total counts, then of genes that enough of these cells hold."""
    held = counts.where(F.col(value) > 0)
    total = F.sum(value)
    fits = (F.count("*") >= min_genes) & (total >= min_counts)
    if max_counts is not None:
        fits = fits & (total <= max_counts)
    cells = held.groupBy(cell).agg(fits.alias("_ok")).where("_ok").select(cell)
    kept = held.join(cells, cell, "left_semi")
    genes = kept.groupBy(gene).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_cells).select(gene)
    return kept.join(genes, gene, "left_semi")


def top_share(counts: DataFrame, cell: str, value: str, tops: Sequence[int]) -> DataFrame:
    """(cell, pct_top_k for each k): percent of a cell's counts in its k largest genes."""
    by = Window.partitionBy(cell)
    x = counts.withColumns({"_r": F.row_number().over(by.orderBy(F.col(value).desc())), "_t": F.sum(value).over(by)})
    return x.groupBy(cell).agg(*[(F.sum(F.when(F.col("_r") <= k, F.col(value)).otherwise(0)) * 100.0 / F.max("_t")).alias(f"pct_top_{k}") for k in tops])


#: Separators between readouts in the order in which they are tried, and texts that an encoding must not hold.
SEPARATORS = ("AA", "TA", "AT", "TT")
FORBIDDEN = ("AAAAAA", "TTTTTT", "CCCCC", "GGGGG", "GGATCC")


def encode_probes(probes: DataFrame, readouts: Mapping[int, str], codes: Sequence[int], order: Sequence[str] = ("name",)) -> DataFrame:
    """name, seq, code1..codeN: in front of each padlock the reverse complements of the readouts, in lower case and joined by
    the first separator that gives no forbidden text; probes without one, and null padlocks, are left out.

    The orders of the codes are dealt out in a cycle: each try takes the next one, whatever probe it is for. A probe moves the
    cycle by as many as it tries, which is known for each place of the cycle it may begin at; so ranges of probes are moved
    over as wholes, see greedy.scan_states. Probes that tie in `order` go by padlock."""
    turned = {k: S.reverse_complement_text(v).lower() for k, v in readouts.items()}
    if missing := [c for c in codes if c not in turned]:
        raise ValueError(f"no readout for {missing}")
    orders = list(permutations(codes))
    heads = [[sep.join(turned[c] for c in own) for own in orders] for sep in SEPARATORS]

    def passes(seq: str) -> bool:
        return not any(f in seq for f in FORBIDDEN[:-1]) and FORBIDDEN[-1] not in seq.upper()

    def tries(pad: str) -> list[int | None]:
        """For each place of the cycle the first separator that passes."""
        ok = [[passes(head + pad) for head in of] for of in heads]
        return [next((k for k in range(len(heads)) if ok[k][(at + k) % len(orders)]), None) for at in range(len(orders))]

    def moves(batch: pa.RecordBatch) -> np.ndarray:
        used = [[len(heads) if k is None else k + 1 for k in tries(pad)] for pad in batch.column("padlock").to_pylist()]
        return (np.arange(len(orders)) + np.array(used, np.int64).reshape(-1, len(orders))) % len(orders)

    def emit(batch: pa.RecordBatch, met: np.ndarray) -> pa.RecordBatch:
        rows = []
        for name, pad, at in zip(batch.column("name").to_pylist(), batch.column("padlock").to_pylist(), met.tolist()):
            if (k := tries(pad)[at]) is not None:
                turn = (at + k) % len(orders)
                rows.append((name, heads[k][turn] + pad, *orders[turn]))
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), *[pa.int64()] * len(codes)])], names=names)

    names = ["name", "seq", *(f"code{i + 1}" for i in range(len(codes)))]
    schema = ", ".join(["name string", "seq string", *(f"{n} long" for n in names[2:])])
    by = [*order, *(c for c in ("padlock",) if c not in order)]
    own = probes.where("padlock is not null").select(*dict.fromkeys(["name", "padlock", *by]))
    return greedy.scan_states(own, by, len(orders), moves, emit, schema)


def single_readout(probes: DataFrame, readout: str, filler: str = "tattcaat", long: int = 46, turn: int = 13) -> DataFrame:
    """name, cons_splint, cons_pad: the padlock's reverse complement behind the readout and one letter, filled up and rotated;
    the first of a, t, c, g that gives no run of five is the letter, null rows if none does. The splint's reverse complement
    carries both ends of the padlock, reversed."""
    pad = S.reverse_complement(F.col("padlock"))
    fill = F.lit(filler).substr(F.lit(1), F.greatest(F.lit(long - 20) - F.length(pad), F.lit(0)))
    tries = [S.rotate(F.concat(F.lit(readout.lower() + x), pad, fill), turn) for x in "atcg"]
    ok = lambda c: ~c.rlike("AAAAA|TTTTT|CCCCC|GGGGG")
    chosen = F.coalesce(*[F.when(ok(t), t) for t in tries])
    out = probes.select("name", S.reverse_complement(F.col("splint")).alias("_s"), chosen.alias("cons_pad"))
    foot = F.concat(F.lit("ta"), S.reverse_complement(F.left("cons_pad", F.lit(6))), S.reverse_complement(F.right("cons_pad", F.lit(6))))
    return out.select("name", F.concat("_s", foot).alias("cons_splint"), "cons_pad")


def pair_first_free(passed: DataFrame, left: str = "i", right: str = "j", order: str = "k") -> DataFrame:
    """(left, right): in order, a pair is taken if neither side is."""
    return greedy.first_free_pairs(passed, left, right, order)


def resolve_transcripts(transcripts: DataFrame, genes: DataFrame, mode: str, annotations: DataFrame | None = None, canonical: DataFrame | None = None) -> DataFrame:
    """Transcripts (gene_name, gene_id, transcript_id, transcript_name, tag) of genes (gene_id).

    all: every one; canonical: those listed in `canonical` (transcript_id); annotated: those in annotations (transcript_id,
    annotation); principal: of these, a gene's single one tagged canonical, else its single one marked PRINCIPAL, else all."""
    own = transcripts.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    if mode == "all":
        return own
    if mode == "canonical":
        return own.join(canonical.select("transcript_id").distinct(), "transcript_id", "left_semi")
    marked = own.join(annotations.select("transcript_id", "annotation").where("annotation is not null"), "transcript_id")
    if mode == "annotated":
        return marked
    if mode != "principal":
        raise ValueError(f"unknown mode {mode}")
    by = Window.partitionBy("gene_name")
    tagged, principal = F.coalesce(F.col("tag") == "Ensembl_canonical", F.lit(False)), F.col("annotation").contains("PRINCIPAL")
    x = marked.withColumns({"_c": F.count_if(tagged).over(by), "_p": F.count_if(principal).over(by)})
    return x.where(F.when(F.col("_c") == 1, tagged).when(F.col("_p") == 1, principal).otherwise(F.lit(True))).drop("_c", "_p")


def segmentation_table(spots: DataFrame) -> DataFrame:
    """x, y, z, gene, cell of spots that are not blanks; cell 0 where there is none."""
    gene = F.split("target", "-")[0]
    return spots.select("x", "y", "z", gene.alias("gene"), F.coalesce(F.col("label"), F.lit(0)).alias("cell")).where("gene <> 'Blank'")


def micron_table(spots: DataFrame, step: float = 0.108) -> DataFrame:
    """X, Y, gene, MoleculeID, Count: places in microns, shifted so that the least is 1. Sort by Y when writing."""
    x, y = F.col("x") * step, F.col("y") * step
    least = spots.agg(F.min(x).alias("_x"), F.min(y).alias("_y"))
    placed = spots.select(x.alias("X"), y.alias("Y"), F.split("target", "-")[0].alias("gene"), F.col("idx").alias("MoleculeID"), F.lit(1).alias("Count"))
    return placed.join(F.broadcast(least)).select((F.col("X") - F.col("_x") + 1).alias("X"), (F.col("Y") - F.col("_y") + 1).alias("Y"), "gene", "MoleculeID", "Count")  # one row of bounds


def feature_table(micron: DataFrame) -> DataFrame:
    return micron.groupBy("gene").agg(F.count("*").alias("Count")).select("gene", F.col("gene").alias("transcript_id"), "Count")


def extent_table(micron: DataFrame) -> DataFrame:
    """name, value: xmin, xmax, ymin, ymax."""
    one = micron.agg(F.min("X").alias("xmin"), F.max("X").alias("xmax"), F.min("Y").alias("ymin"), F.max("Y").alias("ymax"))
    return one.unpivot([], ["xmin", "xmax", "ymin", "ymax"], "name", "value")
