"""Histograms and what is read from them: quantiles, common edges, thresholds, modes, robust lines.

A histogram is rows (key, lo, width, bin, n): bins of one width from lo on, numbered from 0; empty bins have no row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexum.operators.ordering import dealt_by
from plexum.operators.spatial import kept


def linear(df: DataFrame, key: Sequence[str], value: str, bins: int) -> DataFrame:
    """Counts of `bins` equal bins from the least to the largest value of a key, the last one closed. A key of one value alone
    has bins from 0 to 1."""
    v = F.col(value).cast("double")
    ends = df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
    ends = ends.select(*key, F.when(F.col("_b") > F.col("_a"), F.col("_a")).otherwise(0.0).alias("lo"), F.when(F.col("_b") > F.col("_a"), F.col("_b")).otherwise(1.0).alias("_hi"))
    at = F.floor((v - F.col("lo")) / F.col("width"))
    held = df.where(F.col(value).isNotNull()).join(ends.withColumn("width", (F.col("_hi") - F.col("lo")) / bins), list(key)).where((v >= F.col("lo")) & (v <= F.col("_hi")))
    return held.groupBy(*key, "lo", "width", F.least(at, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").cast("double").alias("n"))


def rebin(hists: DataFrame, key: Sequence[str], bins: int) -> DataFrame:
    """Histograms of several sources of a key, on common edges: each count is spread evenly over its bin's width. A source bin
    goes to the bins that it overlaps, by number; no pair is compared."""
    span = hists.groupBy(*key).agg(F.min("lo").alias("_lo"), F.max("_end").alias("_hi")) if "_end" in hists.columns else None
    if span is None:
        raise ValueError("add _end, the last edge of each source")
    x = hists.join(span.withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins), list(key))
    left, right = F.col("lo") + F.col("bin") * F.col("width"), F.col("lo") + (F.col("bin") + 1) * F.col("width")
    number = lambda edge: F.least(F.greatest(F.floor((edge - F.col("_lo")) / F.col("_w")), F.lit(0)), F.lit(bins - 1)).cast("long")
    spread = x.withColumns({"_l": left, "_r": right}).withColumn("_to", F.explode(F.sequence(number(left), number(right))))
    part = F.least("_r", F.col("_lo") + (F.col("_to") + 1) * F.col("_w")) - F.greatest("_l", F.col("_lo") + F.col("_to") * F.col("_w"))
    return spread.withColumn("_p", part / F.col("width")).where("_p > 0").groupBy(*key, F.col("_lo").alias("lo"), F.col("_w").alias("width"), F.col("_to").alias("bin")).agg(F.sum(F.col("n") * F.col("_p")).alias("n"))


def with_end(hist: DataFrame, bins: int) -> DataFrame:
    """A histogram of so many bins with its last edge."""
    return hist.withColumn("_end", F.col("lo") + F.col("width") * bins)


def quantile(hist: DataFrame, key: Sequence[str], q: Column) -> DataFrame:
    """The quantile from the running shares, taken to stand at the middle of their bins and linear between these."""
    by = Window.partitionBy(*key)
    shares = hist.withColumns({"_t": F.sum("n").over(by), "_c": F.sum("n").over(by.orderBy("bin"))})
    at = shares.withColumns({"_y1": F.col("_c") / F.col("_t"), "_y0": (F.col("_c") - F.col("n")) / F.col("_t")}).where(F.col("_y1") >= q)
    first = at.groupBy(*key).agg(F.min_by(F.struct("bin", "lo", "width", "_y0", "_y1", q.alias("_q")), "bin").alias("b"))
    inside = F.col("b.lo") + (F.col("b.bin") - 0.5 + (F.col("b._q") - F.col("b._y0")) / (F.col("b._y1") - F.col("b._y0"))) * F.col("b.width")
    return first.select(*key, F.when(F.col("b.bin") == 0, F.col("b.lo") + 0.5 * F.col("b.width")).otherwise(inside).alias("quantile"))


def exact_percentile(df: DataFrame, key: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """(key, name): the exact percentile as F.percentile computes it, from distinct values in ranges of their order: no task holds a
    key's values, however many differ. Nulls do not count; keys of nulls alone are left out."""
    v = F.col(value).cast("double")
    once = kept(df.where(v.isNotNull()).groupBy(*key, v.alias("_v")).agg(F.count("*").alias("_n")))
    dealt = dealt_by(once, "_v")
    before = Window.partitionBy(*key).orderBy("_b")  # a row for each key and range
    starts = dealt.groupBy(*key, "_b").agg(F.sum("_n").alias("_t")).withColumns({"_s": F.sum("_t").over(before) - F.col("_t"), "_all": F.sum("_t").over(Window.partitionBy(*key))})
    at = (F.col("_all") - 1) * F.lit(q)
    starts = starts.withColumns({"_lo": F.floor(at), "_hi": F.ceil(at), "_at": at}).where((F.col("_s") <= F.col("_hi")) & (F.col("_s") + F.col("_t") > F.col("_lo")))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*key, "_b"]]
    inside = dealt.alias("d").join(starts.alias("s"), reduce(lambda a, b: a & b, same)).select("d.*", "_s", "_lo", "_hi", "_at")
    c = F.col("_s") + F.sum("_n").over(Window.partitionBy(*key, "_b").orderBy("_v"))
    found = inside.withColumn("_c", c).where((F.col("_c") > F.col("_lo")) & (F.col("_c") - F.col("_n") <= F.col("_hi")))
    ends = found.groupBy(*key).agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_at").alias("_at"))
    between = (F.col("_hi") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_lo")) * F.col("_z")
    return ends.select(*key, F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(between).alias(name))


def quantise_parameters(hist: DataFrame, key: str, bins: int, low: float, high: float, gamma: float, top: int, overrides: dict[str, float]) -> DataFrame:
    """(key, m, s) for quantising: m the low quantile, s what brings the range up to the high one, times gamma, to top. Where
    the quantiles do not differ, the edges count."""
    upper = F.lit(high)
    for k, q in overrides.items():
        upper = F.when(F.col(key) == k, F.lit(q)).otherwise(upper)
    lo, hi = quantile(hist, [key], F.lit(low)), quantile(hist, [key], upper).withColumnRenamed("quantile", "_hi")
    edges = hist.groupBy(key).agg(F.min("lo").alias("_first"), F.max("width").alias("_w"))
    x = lo.join(hi, key).join(edges, key)
    degenerate = F.col("_hi") <= F.col("quantile")
    m = F.when(degenerate, F.col("_first")).otherwise(F.col("quantile"))
    span = (F.when(degenerate, F.col("_first") + F.col("_w") * bins).otherwise(F.col("_hi")) - m) * gamma
    return x.select(key, m.alias("m"), F.when(span > 0, top / span).otherwise(1.0).alias("s"))


def otsu(hist: DataFrame, key: Sequence[str]) -> DataFrame:
    """The middle of the bin after which a cut parts the values into the two classes that differ most."""
    by = Window.partitionBy(*key)
    run = by.orderBy("bin")
    centre = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    x = hist.withColumn("_x", centre).withColumns({"_w": F.sum("n").over(run), "_s": F.sum(F.col("n") * F.col("_x")).over(run), "_wt": F.sum("n").over(by), "_st": F.sum(F.col("n") * F.col("_x")).over(by)})
    rest = F.nullif(F.col("_wt") - F.col("_w"), F.lit(0.0))
    gap = F.col("_s") / F.col("_w") - (F.col("_st") - F.col("_s")) / rest
    between = x.withColumn("_v", F.col("_w") * rest * gap * gap).where("_v is not null")
    return between.groupBy(*key).agg(F.max_by("_x", F.struct("_v", -F.col("bin"))).alias("threshold"))


def conditional_percentiles(df: DataFrame, key: str, x: str, y: str, percentile: float = 20.0, top: float = 99.99, points: int = 50, least: int = 100) -> DataFrame:
    """(key, bin, x, y): over bins of x from its Otsu threshold to a high percentile, `points` edges in all, a low percentile of
    y in bins of `least` rows or more; x is the bin's middle. Histograms, ends and bins are kept, so the table is read for its
    least and largest x, for the histogram, for the percentile and for the bins, and not again."""
    cut = otsu(kept(linear(df, [key], x, 256)), [key])
    ends = exact_percentile(df, [key], x, top / 100, "_b").join(cut, key).withColumn("_w", F.nullif((F.col("_b") - F.col("threshold")) / (points - 1), F.lit(0.0)))
    ends = kept(ends)
    at = F.floor((F.col(x) - F.col("threshold")) / F.col("_w")).cast("long")
    held = df.join(ends, key).where((F.col(x) >= F.col("threshold")) & (F.col(x) < F.col("_b"))).withColumn("bin", at)
    full = held.groupBy(key, "bin", "threshold", "_w").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    low = exact_percentile(held, [key, "bin"], y, percentile / 100, "y")
    out = full.join(low, [key, "bin"], "left")
    return kept(out.select(key, "bin", (F.col("threshold") + (F.col("bin") + 0.5) * F.col("_w")).alias("x"), "y"))


def robust_line(points: DataFrame, key: str) -> DataFrame:
    """(key, inliers, slope, intercept): of the lines through two points of a key, the one that most points lie near, refitted
    to these. Near is within the median deviation of y from its median. All pairs are tried, where sampling would try some;
    a key's points are bins, a few dozen at most."""
    p = points.select(key, "bin", "x", "y")
    mid = p.groupBy(key).agg(F.percentile("y", F.lit(0.5)).alias("_m"))
    near = p.join(mid, key).groupBy(key).agg(F.percentile(F.abs(F.col("y") - F.col("_m")), F.lit(0.5)).alias("_r"))
    a = p.select(key, F.col("bin").alias("_i"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    b = p.select(key, F.col("bin").alias("_j"), F.col("x").alias("_u"), F.col("y").alias("_v"))
    lines = a.join(b, key).where("_i < _j").withColumn("_k", F.try_divide(F.col("_v") - F.col("_y"), F.col("_u") - F.col("_x")))
    off = F.col("y") - F.col("_y") - F.col("_k") * (F.col("x") - F.col("_x"))
    held = lines.join(p, key).join(near, key).withColumn("_e", off).where("abs(_e) <= _r + 1e-9")
    tried = held.groupBy(key, "_i", "_j").agg(F.count("*").alias("inliers"), F.round(F.sum(F.col("_e") * F.col("_e")), 6).alias("_q"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    best = tried.groupBy(key).agg(F.max_by(F.struct("inliers", "slope", "intercept"), F.struct("inliers", -F.col("_q"), -F.col("_i"), -F.col("_j"))).alias("b"))
    return best.select(key, "b.*")


def binned_mode(df: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """(key, mode): values are numbered by bins from the least one on; the mode is the middle of the bin after the fullest one,
    the first of equals, as bins count from the edge before them; the median if that lies past the last bin."""
    v = F.col(value).cast("double")
    per = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(v).alias("_a"), F.max(v).alias("_b")).join(exact_percentile(df, [key], value, 0.5, "_m"), key)
    held = df.where(F.col(value).isNotNull()).join(per, key).groupBy(key, "_a", "_b", "_m", (F.floor((v - F.col("_a")) / width) + 1).alias("_i")).agg(F.count("*").alias("_n"))
    top = held.groupBy(key, "_a", "_b", "_m").agg(F.min_by("_i", F.struct(-F.col("_n"), "_i")).alias("_i"))
    last = F.ceil((F.col("_b") - F.col("_a")) / width)
    return top.select(key, F.when(F.col("_i") >= last, F.col("_m")).otherwise(F.col("_a") + (F.col("_i") + 0.5) * width).alias("mode"))


def drift(df: DataFrame, key: str, dx: str, dy: str, enough: int = 100, farthest: float = 40.0, width: float = 0.5, digits: int = 2) -> DataFrame:
    """(key, dx, dy, cv): the binned modes of the shifts of a key of over `enough` points if they lie below `farthest`, else the
    medians; cv is the deviation of the shifts' lengths over their mean."""
    length, half = F.hypot(dx, dy), F.lit(0.5)
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.percentile(dx, half).alias("ex"), F.percentile(dy, half).alias("ey"), F.try_divide(F.stddev_pop(length), F.avg(length)).alias("cv"))
    out = per.join(binned_mode(df, key, dx, width).withColumnRenamed("mode", "mx"), key).join(binned_mode(df, key, dy, width).withColumnRenamed("mode", "my"), key)
    by_mode = (F.col("n") > enough) & (F.hypot("mx", "my") < farthest)
    return out.select(key, F.round(F.when(by_mode, F.col("mx")).otherwise(F.col("ex")), digits).alias("dx"), F.round(F.when(by_mode, F.col("my")).otherwise(F.col("ey")), digits).alias("dy"), "cv")


def threshold_curve(spots: DataFrame, density: str, blank: str, levels: DataFrame, most: int = 15) -> DataFrame:
    """(level, spots, blank_share): for the odd levels below the number of levels and `most`, the spots whose density lies below
    the level's value, and the share of blanks among them. levels: level (from 0) and v, a handful of rows."""
    values = [float(r["v"]) for r in levels.orderBy("level").limit(most).collect()]
    asked = list(range(1, min(len(values), most), 2))
    one = spots.agg(*[F.struct(F.lit(k).alias("level"), F.count_if(F.col(density) < values[k]).alias("spots"), F.count_if((F.col(density) < values[k]) & F.col(blank)).alias("b")).alias(f"_{k}") for k in asked])
    rows = one.select(F.inline(F.array(*[f"_{k}" for k in asked])))
    return rows.select(F.col("level").cast("long").alias("level"), "spots", (F.col("b") / F.greatest(F.col("spots"), F.lit(1))).alias("blank_share"))
