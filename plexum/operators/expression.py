"""Cells by genes: variable genes by Pearson residuals, dense residuals of the chosen ones, and principal components.

The matrix is never filled. A zero's residual depends on its cell's and its gene's total alone, and cells of equal total count
alike; so a gene's zeros are one sum over the distinct totals, of which there are at most the square root of twice all counts.
What is not zero corrects that sum, entry by entry.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexum.operators.spatial import need_folder

#: Distinct totals of cells that a task holds at once.
TOTALS = 1_000_000


def _residual(n: np.ndarray | float, mu: np.ndarray, theta: float, clip: float) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.clip(np.where(mu > 0, (n - mu) / np.sqrt(mu + mu * mu / theta), 0.0), -clip, clip)


def _zeros(genes: DataFrame, gene: str, totals: tuple[np.ndarray, np.ndarray], all_counts: float, theta: float, clip: float) -> DataFrame:
    """Sums of the residuals, and of their squares, that each gene (gene, _c) would have with no count in cells of these totals."""
    r, n = totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((2, batch.num_rows))
            for i, c in enumerate(batch.column("_c").to_numpy()):
                z = _residual(0.0, r * (float(c) / all_counts), theta, clip)
                sums[:, i] = n @ z, n @ (z * z)
            yield pa.RecordBatch.from_arrays([batch.column(gene), *map(pa.array, sums)], names=[gene, "_s", "_q"])

    return genes.select(gene, F.col("_c").cast("double").alias("_c")).mapInArrow(run, f"`{gene}` {genes.schema[gene].dataType.simpleString()}, _s double, _q double")


def gene_variances(counts: DataFrame, cell: str, gene: str, value: str = "n", theta: float = 100.0, clip: float | None = None) -> DataFrame:
    """gene, mean and residual_variance over all cells of counts, which has one row for each cell and gene that go together.
    clip is the root of the number of cells unless given. Null cells, genes and values are left out; no counts give no rows."""
    need_folder(counts)
    own = counts.where(F.col(cell).isNotNull() & F.col(gene).isNotNull() & (F.col(value) > 0)).select(cell, gene, F.col(value).cast("double").alias("_n"))
    rows = own.groupBy(cell).agg(F.sum("_n").alias("_r")).checkpoint()
    cols = own.groupBy(gene).agg(F.sum("_n").alias("_c")).checkpoint()
    cells, all_counts, different = rows.agg(F.count("*"), F.sum("_r"), F.countDistinct("_r")).first()
    limit = float(np.sqrt(cells)) if clip is None else clip
    alike = rows.groupBy("_r").agg(F.count("*").cast("double").alias("_k"))
    parts, sums = -(-different // TOTALS) or 1, []
    for i in range(parts):
        held = alike.where(F.pmod(F.xxhash64("_r"), F.lit(parts)) == i).toArrow()  # about TOTALS rows, see above for all
        sums.append(_zeros(cols, gene, (held.column("_r").to_numpy(), held.column("_k").to_numpy()), all_counts or 1.0, theta, limit))
    mu = F.col("_r") * F.col("_c") / F.lit(all_counts or 1.0)
    scale = F.sqrt(mu + mu * mu / theta)
    cut = lambda z: F.greatest(F.least(z, F.lit(limit)), F.lit(-limit))
    here = own.join(rows, cell).join(cols, gene).select(gene, cut((F.col("_n") - mu) / scale).alias("z"), cut(-mu / scale).alias("o"))
    sums.append(here.groupBy(gene).agg(F.sum(F.col("z") - F.col("o")).alias("_s"), F.sum(F.col("z") * F.col("z") - F.col("o") * F.col("o")).alias("_q")))
    total = reduce(DataFrame.unionByName, sums).groupBy(gene).agg((F.sum("_s") / cells).alias("_m"), (F.sum("_q") / cells).alias("_v"))
    return total.join(cols, gene).select(gene, (F.col("_c") / cells).alias("mean"), (F.col("_v") - F.col("_m") * F.col("_m")).alias("residual_variance"))


def variable_genes(counts: DataFrame, cell: str, gene: str, top: int, **how) -> DataFrame:
    """The `top` genes of largest residual variance; of equal ones those that sort first."""
    return gene_variances(counts, cell, gene, **how).orderBy(F.col("residual_variance").desc(), gene).limit(top)


def residual_vectors(counts: DataFrame, cell: str, gene: str, genes: Sequence, value: str = "n", theta: float = 100.0) -> DataFrame:
    """cell, raw, sqrt_norm and residuals: for each cell with a count of these genes an array over them, in their order, zeros
    included. Totals are those of these genes. sqrt_norm is the root of counts scaled to the cells' median total."""
    need_folder(counts)
    place = counts.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], f"`{gene}` {counts.schema[gene].dataType.simpleString()}, _i int")
    own = counts.join(F.broadcast(place), gene).where(F.col(cell).isNotNull() & (F.col(value) > 0)).select(cell, "_i", F.col(value).cast("double").alias("_n"))
    rows = own.groupBy(cell).agg(F.sum("_n").alias("_r"), F.collect_list("_i").alias("_at"), F.collect_list("_n").alias("_of")).checkpoint()
    cols = np.zeros(len(genes))
    for r in own.groupBy("_i").agg(F.sum("_n").alias("c")).collect():  # a row for each of the genes
        cols[r["_i"]] = r["c"]
    cells, middle = rows.agg(F.count("*"), F.percentile("_r", 0.5)).first()
    all_counts, clip = cols.sum() or 1.0, float(np.sqrt(cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("_at").value_lengths().to_numpy()
            for k in range(0, batch.num_rows, 500):
                part, n = batch.slice(k, 500), size[k : k + 500]
                x = np.zeros((len(n), len(cols)))
                x[np.repeat(np.arange(len(n)), n), part.column("_at").flatten().to_numpy()] = part.column("_of").flatten().to_numpy()
                r = part.column("_r").to_numpy()[:, None]
                dense = [x, np.sqrt(x * (middle / r)), _residual(x, r * cols / all_counts, theta, clip)]
                edges = pa.array(np.arange(0, x.size + 1, len(cols), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(cell), *[pa.ListArray.from_arrays(edges, pa.array(d.ravel())) for d in dense]], names=[cell, "raw", "sqrt_norm", "residuals"])

    return rows.mapInArrow(run, f"`{cell}` {counts.schema[cell].dataType.simpleString()}, raw array<double>, sqrt_norm array<double>, residuals array<double>")


def principal_components(df: DataFrame, vector: str, k: int, name: str = "components") -> DataFrame:
    """df with its vectors' first k principal components, centred. The driver holds one square matrix of the vectors' length.
    Null vectors are left out; lengths must be equal; a component's sign is arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    own = df.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    if own.isEmpty():
        return own.withColumn(name, F.col(vector).cast("array<double>")).drop("_v")
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(own)
    middle = np.asarray(model.pc.toArray()).T @ own.agg(Summarizer.mean(F.col("_v"))).first()[0].toArray()
    shift = F.array(*[F.lit(float(m)) for m in middle])
    return model.transform(own).withColumn(name, F.zip_with(vector_to_array("_p"), shift, lambda p, m: p - m)).drop("_v", "_p")


def marker_scores(values: DataFrame, clusters: DataFrame, cell: str, gene: str, cluster: str, value: str = "n") -> DataFrame:
    """cluster, gene, score: of each gene and cluster how far the ranks of the cluster's cells lie above those of all others, in
    deviations of the rank-sum statistic without ties. values holds what is not zero; all cells stand in clusters, one row each.

    Zeros tie below all else, negative values below zero. Equal values of a gene are counted before they are ranked, so a window
    holds a gene's different values. Clusters of all cells have no score; null cells, genes and clusters are left out."""
    groups = clusters.where(F.col(cell).isNotNull() & F.col(cluster).isNotNull()).select(cell, F.col(cluster).alias("_k"))
    own = values.where(F.col(cell).isNotNull() & F.col(gene).isNotNull() & (F.col(value) != 0)).select(cell, F.col(gene).alias("_g"), F.col(value).cast("double").alias("_v")).join(groups, cell)
    sizes = groups.groupBy("_k").agg(F.count("*").alias("_n"))
    whole = sizes.agg(F.sum("_n").alias("_cells"))
    alike = own.groupBy("_g", "_v", "_k").agg(F.count("*").alias("_c"))
    levels = alike.groupBy("_g", "_v").agg(F.sum("_c").alias("_t"))
    by = Window.partitionBy("_g")
    below = F.coalesce(F.sum("_t").over(by.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = levels.withColumns({"_below": below, "_seen": F.sum("_t").over(by), "_under": F.sum(F.when(F.col("_v") < 0, F.col("_t")).otherwise(0)).over(by)}).join(F.broadcast(whole))
    zeros = F.col("_cells") - F.col("_seen")
    rank = F.col("_below") + F.when(F.col("_v") > 0, zeros).otherwise(0) + (F.col("_t") + 1) / 2
    ranked = seen.select("_g", "_v", rank.alias("_r"), (F.col("_under") + (zeros + 1) / 2).alias("_zero"))
    summed = alike.join(ranked, ["_g", "_v"]).groupBy("_g", "_k").agg(F.sum(F.col("_c") * F.col("_r")).alias("_sum"), F.sum("_c").alias("_held"))
    # clusters in which a gene has no value but zero, too
    pairs = ranked.groupBy("_g").agg(F.first("_zero").alias("_zero")).join(F.broadcast(sizes.agg(F.collect_list(F.struct("_k", "_n")).alias("_all")))).select("_g", "_zero", F.inline("_all"))
    full = pairs.join(summed, ["_g", "_k"], "left").join(F.broadcast(whole))
    total = F.coalesce("_sum", F.lit(0.0)) + (F.col("_n") - F.coalesce("_held", F.lit(0))) * F.col("_zero")
    spread = F.sqrt(F.col("_n") * (F.col("_cells") - F.col("_n")) * (F.col("_cells") + 1) / 12.0)
    return full.where("_n < _cells").select(F.col("_k").alias(cluster), F.col("_g").alias(gene), ((total - F.col("_n") * (F.col("_cells") + 1) / 2.0) / spread).alias("score"))


def marker_genes(values: DataFrame, clusters: DataFrame, cell: str, gene: str, cluster: str, head: int = 5, value: str = "n") -> DataFrame:
    """The `head` genes of largest score of each cluster, with their place from 0; of equal ones those that sort first."""
    scores = marker_scores(values, clusters, cell, gene, cluster, value)
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.round("score", 9).desc(), gene)) - 1
    return scores.withColumn("place", place).where(F.col("place") < head)
