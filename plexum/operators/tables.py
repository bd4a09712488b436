"""Filters, joins back and grouped summaries as lazy DataFrame transformations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_bounds(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows inside half-open bounds; a missing end is open."""
    tests = [F.col(c) >= lo for c, (lo, _) in bounds.items() if lo is not None] + [F.col(c) < hi for c, (_, hi) in bounds.items() if hi is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def rebase(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows inside the bounds, moved so that the lower ends are 0."""
    return within_bounds(df, bounds).withColumns({c: F.col(c) - lo for c, (lo, _) in bounds.items()})


def first_criterion(criteria: Sequence[Column]) -> Column:
    """The number, from 1, of the first criterion that holds; 0 if none does."""
    out = None
    for i, c in enumerate(criteria, 1):
        out = F.when(c, i) if out is None else out.when(c, i)
    return out.otherwise(0) if out is not None else F.lit(0)


def reject_groups(df: DataFrame, key: str, bad: Column) -> DataFrame:
    """All rows of keys none of whose rows is bad."""
    return df.join(df.where(bad).select(key).distinct(), key, "left_anti")


def groups_of(df: DataFrame, key: str, size: int) -> DataFrame:
    """All rows of keys with exactly `size` rows."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == size).select(key), key, "left_semi")


def over_share_of_max(df: DataFrame, value: str, share: float) -> DataFrame:
    """Rows whose value is over a share of the largest."""
    top = df.agg(F.max(value).alias("_top"))
    return df.join(F.broadcast(top)).where(F.col(value) > share * F.col("_top")).drop("_top")  # one row


def best_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return top_per_key(df, key, order, 1, w)


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, window=None) -> DataFrame:
    w = window or Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def weighted_centroids(df: DataFrame, key: Sequence[str], weight: str, axes: Sequence[str]) -> DataFrame:
    """Total weight and weighted mean of each axis."""
    w = F.col(weight).cast("double")
    means = [(F.sum(F.col(a).cast("double") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias(a) for a in axes]
    return df.groupBy(*key).agg(F.sum(w).alias(weight), *means)


def weighted_mean(value: Column, weight: Column) -> Column:
    """A mean in which rows of null or NaN value weigh nothing."""
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.sum(v * weight) / F.nullif(F.sum(F.when(v.isNotNull(), weight)), F.lit(0.0))


def cross_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """A row for each `row`, a column of counts for each listed value; 0 where none."""
    return df.where(F.col(column).isin(*values)).groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def unpivot(df: DataFrame, ids: Sequence[str], measures: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(measures), name, value)


def shift_rows_to_grid(df: DataFrame, key: str, x: str, y: str, columns: int, padding: float) -> DataFrame:
    """Each key's bounds, and the offset that lays the keys out on a grid of equal cells, by key order."""
    b = df.groupBy(key).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    everything = Window.partitionBy()  # one row for each key
    i = F.row_number().over(Window.orderBy(key)) - 1
    return (
        b.withColumns({"i": i, "w": F.max(F.col("x1") - F.col("x0")).over(everything), "h": F.max(F.col("y1") - F.col("y0")).over(everything)})
        .select(key, ((F.col("i") % columns) * (F.col("w") + padding) - F.col("x0")).alias("dx"), (F.floor(F.col("i") / columns) * (F.col("h") + padding) - F.col("y0")).alias("dy"))
    )


def entropy(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Bits of entropy of the counts of each key."""
    total = F.sum(n).over(Window.partitionBy(key))
    p = F.col(n) / total
    return counts.withColumn("_h", -p * F.log2(p)).groupBy(key).agg(F.sum("_h").alias("entropy"))


def histogram(df: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """Counts of fixed-width bins."""
    return df.where(F.col(value).isNotNull()).groupBy(key, F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def normalise_log1p(counts: DataFrame, cell: str, value: str = "n") -> DataFrame:
    """Counts scaled to the median total of all cells, then ln(1 + x)."""
    totals = counts.groupBy(cell).agg(F.sum(value).alias("_total"))
    target = totals.where("_total > 0").agg(F.percentile("_total", F.lit(0.5)).alias("_target"))
    return counts.join(totals, cell).join(F.broadcast(target)).withColumn("x", F.log1p(F.col(value) * F.col("_target") / F.nullif(F.col("_total"), F.lit(0)))).drop("_total", "_target")


def pearson_residuals(counts: DataFrame, cell: str, gene: str, theta: float = 100.0, value: str = "n") -> DataFrame:
    """Pearson residuals of counts under a negative binomial with the cells' and genes' totals."""
    rows = counts.groupBy(cell).agg(F.sum(value).alias("_r"))
    cols = counts.groupBy(gene).agg(F.sum(value).alias("_c"))
    total = counts.agg(F.sum(value).alias("_t"))
    mu = F.col("_r") * F.col("_c") / F.col("_t")
    return counts.join(rows, cell).join(cols, gene).join(F.broadcast(total)).withColumn("x", (F.col(value) - mu) / F.sqrt(mu + mu * mu / theta)).drop("_r", "_c", "_t")


def preferred_rows(df: DataFrame, key: str, tiers: Sequence[Column]) -> DataFrame:
    """Of each key the rows of the first tier that any of its rows meets; all its rows if none does."""
    rank = first_criterion(tiers)
    ranked = df.withColumn("_t", F.when(rank > 0, rank).otherwise(len(tiers) + 1))
    best = ranked.groupBy(key).agg(F.min("_t").alias("_t"))
    return ranked.join(best, [key, "_t"], "left_semi").drop("_t").select(df.columns)


def transpose(df: DataFrame, row: str, columns: Sequence[str], rows: Sequence[str], name: str = "column") -> DataFrame:
    """A row for each of columns, a column for each listed value of row."""
    return df.unpivot([row], list(columns), name, "_v").groupBy(name).pivot(row, list(rows)).agg(F.sum("_v"))


def distance_to_mean(df: DataFrame, key: str, axes: Sequence[str]) -> DataFrame:
    """df with l2, each row's distance to the mean of its key."""
    means = df.groupBy(key).agg(*[F.avg(a).alias(f"_{a}") for a in axes])
    squares = reduce(lambda a, b: a + b, [(F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in axes])
    return df.join(means, key).withColumn("l2", F.sqrt(squares)).drop(*[f"_{a}" for a in axes])


def channel_deviation(df: DataFrame, channel: str, deviation: str, n: str, least: int) -> DataFrame:
    """(channel, deviation, cv): mean deviation of channels over tiles of at least `least` spots, weighted by their number, over
    the mean of all channels; cv is the root mean square of what is left from 1."""
    means = df.where(F.col(n) >= least).groupBy(channel).agg((F.sum(F.coalesce(F.nanvl(deviation, F.lit(1.0)), F.lit(1.0)) * F.col(n)) / F.sum(n)).alias("_d"))
    whole = means.agg(F.avg("_d").alias("_m"), F.avg(F.col("_d") * F.col("_d")).alias("_q"))
    cv = F.sqrt(F.greatest(F.col("_q") / (F.col("_m") * F.col("_m")) - 1, F.lit(0.0)))  # mean of (d/m - 1)^2
    return means.join(F.broadcast(whole)).select(channel, (F.col("_d") / F.col("_m")).alias("deviation"), cv.alias("cv"))


def initial_scale(df: DataFrame, channel: str, scale: str) -> DataFrame:
    """(channel, scale): channels' mean scales over their mean, clipped at 2, over the mean, raised to 0.5, over the mean."""
    everything = Window.partitionBy()  # one row for each channel
    out = df.groupBy(channel).agg(F.avg(scale).alias("scale"))
    for clip in (lambda c: F.greatest(F.least(c, F.lit(2.0)), F.lit(0.0)), lambda c: F.greatest(c, F.lit(0.5)), lambda c: c):
        out = out.withColumn("scale", F.col("scale") / F.avg("scale").over(everything)).withColumn("scale", clip(F.col("scale")))
    return out


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs of a list of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def relaxed_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by name; missing columns are null, columns whose types differ take the wider one, or string."""
    seen: dict[str, set[str]] = {}
    for df in frames:
        for f in df.schema:
            seen.setdefault(f.name, set()).add(f.dataType.simpleString())
    text = {c for c, kinds in seen.items() if len(kinds) > 1 and "string" in kinds}
    cast = [df.withColumns({c: F.col(c).cast("string") for c in text if c in df.columns}) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def require_subset(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """df, or an error if a key of it is not in other."""
    lost = [r[0] for r in df.join(other, key, "left_anti").select(key).limit(5).collect()]
    if lost:
        raise ValueError(f"{key} not in the other table: {lost}")
    return df


def best_seed(genes: DataFrame, gene: str, weight: str, codes: Sequence[int], bits: int, seeds: int) -> DataFrame:
    """(seed, entropy) of the seed whose deal of codes to genes loads the bits most evenly. A seed sorts genes by digest; genes
    are at most as many as codes, so a seed's genes fit one group."""
    n = genes.limit(len(codes) + 1).count()
    if n > len(codes):
        raise ValueError(f"over {len(codes)} genes for {len(codes)} codes")
    tried = genes.select(gene, weight, F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col(gene).cast("string"))), gene))
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), place)
    loads = tried.withColumn("code", code).groupBy("seed").agg(*[F.sum(F.when(F.col("code").bitwiseAND(1 << i) > 0, F.col(weight)).otherwise(0.0)).alias(f"_{i}") for i in range(bits)])
    total = reduce(lambda a, b: a + b, [F.col(f"_{i}") for i in range(bits)])
    h = reduce(lambda a, b: a + b, [F.when(F.col(f"_{i}") > 0, -F.col(f"_{i}") / total * F.log2(F.col(f"_{i}") / total)).otherwise(0.0) for i in range(bits)])
    return loads.select("seed", F.round(h, 9).alias("entropy")).agg(F.max_by(F.struct("seed", "entropy"), F.struct("entropy", -F.col("seed"))).alias("b")).select("b.*")


def by_patterns(df: DataFrame, columns: Sequence[str], include: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """Rows of which a column matches any pattern to include, all if there is none, and no column one to exclude."""
    hit = lambda patterns: reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(p), F.lit(False)) for c in columns for p in patterns], F.lit(False))
    return df.where((hit(include) if include else F.lit(True)) & ~hit(exclude))
