"""Histogram thresholds, robust fits, drift, and the tables that follow a screen."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexum.operators import assembly, grids, histograms
from plexum.plans.base import query

BINS = 64
_EDGES = "select {k}, min({v})::double as lo, max({v})::double as hi from {t} where {v} is not null group by all"


def _linear(keys: str, value: str, table: str, bins: int = BINS) -> str:
    """SQL of histograms.linear over keys whose values differ."""
    join = " and ".join(f"e.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"e.{k.strip()}" for k in keys.split(","))
    return f"""(with e as (select {keys}, min({value})::double as lo, max({value})::double as hi from {table} group by all)
select {own}, lo, (hi - lo) / {bins} as width, least(floor(({value} - lo) / ((hi - lo) / {bins})), {bins - 1})::bigint as bin, count(*)::double as n from {table} t join e on {join} where {value} is not null and hi > lo group by all)"""


_QUANTILE = """r as (select *, sum(n) over (partition by k order by bin) as c, sum(n) over (partition by k) as t from h),
f as (select k, q, bin, lo, width, (c - n) / t as y0, c / t as y1, row_number() over (partition by k, q order by bin) as i from r, qs where c / t >= q),
v as (select k, q, case when bin = 0 then lo + 0.5 * width else lo + (bin - 0.5 + (q - y0) / (y1 - y0)) * width end as quantile from f where i = 1)"""


@query("events", sql=f"select event_type, bin, n::bigint as n from {_linear('event_type', 'value', 'events')}")
def hist_linear(events):
    return histograms.linear(events, ["event_type"], "value", BINS).select("event_type", "bin", F.col("n").cast("long").alias("n"))


@query("events", sql=f"with h as (select event_type as k, lo, width, bin, n from {_linear('event_type', 'value', 'events')}), qs as (select 0.9::double as q), {_QUANTILE} select k as event_type, round(quantile, 6) as quantile from v")
def hist_quantile(events):
    out = histograms.quantile(histograms.linear(events, ["event_type"], "value", BINS), ["event_type"], F.lit(0.9))
    return out.select("event_type", F.round("quantile", 6).alias("quantile"))


def _tiles(events):
    """Four tiles of each event type, each with a histogram on its own edges."""
    return events.select("event_type", F.pmod("user_id", F.lit(4)).alias("tile"), "value")


_TILES = "(select event_type, user_id % 4 as tile, value from events)"
_REBINNED = f"""s as (select *, lo + {BINS} * width as hi from {_linear("event_type, tile", "value", _TILES)}), g as (select event_type, min(lo) as glo, (max(hi) - min(lo)) / {BINS} as gw from s group by 1),
x as (select s.event_type as k, glo, gw, n, width, lo + bin * width as l, lo + (bin + 1) * width as r, unnest(range(least(greatest(floor((lo + bin * width - glo) / gw), 0), {BINS - 1})::bigint, least(greatest(floor((lo + (bin + 1) * width - glo) / gw), 0), {BINS - 1})::bigint + 1)) as b from s join g using (event_type)),
o as (select *, (least(r, glo + (b + 1) * gw) - greatest(l, glo + b * gw)) / width as part from x),
h as (select k, glo as lo, gw as width, b as bin, sum(n * part) as n from o where part > 0 group by all)"""


def _rebinned(events):
    own = histograms.with_end(histograms.linear(_tiles(events), ["event_type", "tile"], "value", BINS), BINS)
    return histograms.rebin(own, ["event_type"], BINS)


@query("events", sql=f"with {_REBINNED} select k as event_type, bin, round(n, 4) as n from h where n > 0.0001")
def hist_rebin(events):
    return _rebinned(events).where("n > 0.0001").select("event_type", "bin", F.round("n", 4).alias("n"))


@query("events", sql=f"""with {_REBINNED}, qs as (select unnest([0.01, 0.999, 0.9, 0.85]) as q), {_QUANTILE},
p as (select l.k, l.quantile as m, u.quantile as hi from v l join v u on l.k = u.k and l.q = 0.01 and u.q = case l.k when 'click' then 0.9 when 'view' then 0.85 else 0.999 end)
select k as event_type, round(m, 5) as m, round(65534 / ((hi - m) * 1.05), 5) as s from p""")
def quantise_params(events):
    out = histograms.quantise_parameters(_rebinned(events), "event_type", BINS, 0.01, 0.999, 1.05, 65_534, {"click": 0.9, "view": 0.85})
    return out.select("event_type", F.round("m", 5).alias("m"), F.round("s", 5).alias("s"))


_POINTS = 12


@query("lineitem", sql=f"""with h as (select l_returnflag as k, lo + (bin + 0.5) * width as x, n, bin from {_linear("l_returnflag", "l_quantity", "lineitem", 256)}),
r as (select k, x, bin, sum(n) over w as w1, sum(n * x) over w as s1, sum(n) over (partition by k) as wt, sum(n * x) over (partition by k) as st from h window w as (partition by k order by bin)),
o as (select k, arg_max(x, (w1 * (wt - w1) * (s1 / w1 - (st - s1) / (wt - w1)) * (s1 / w1 - (st - s1) / (wt - w1)), -bin)) as t from r where wt > w1 group by 1),
e as (select l_returnflag as k, any_value(t) as t, (quantile_cont(l_quantity::double, 0.9999) - any_value(t)) / {_POINTS - 1} as w, quantile_cont(l_quantity::double, 0.9999) as b from lineitem join o on l_returnflag = k group by 1),
p as (select k, floor((l_quantity - t) / w)::bigint as bin, any_value(t) + (floor((l_quantity - t) / w)::bigint + 0.5) * any_value(w) as x, quantile_cont(l_extendedprice::double, 0.2) as y from lineitem join e on l_returnflag = k where l_quantity >= t and l_quantity < b group by 1, 2 having count(*) >= 100),
m as (select k, median(y) as m from p group by 1), n as (select k, median(abs(y - m)) as near from p join m using (k) group by 1),
l as (select a.k, a.bin as i, b.bin as j, a.x, a.y, (b.y - a.y) / (b.x - a.x) as slope from p a join p b on a.k = b.k and a.bin < b.bin),
t as (select l.k, i, j, count(*) as inliers, round(sum(pow(p.y - l.y - slope * (p.x - l.x), 2)), 6) as q, regr_slope(p.y, p.x) as s, regr_intercept(p.y, p.x) as c from l join p using (k) join n using (k) where abs(p.y - l.y - slope * (p.x - l.x)) <= near + 1e-9 group by all)
select k as l_returnflag, inliers, round(s, 4) as slope, round(c, 2) as intercept from (select *, row_number() over (partition by k order by inliers desc, q, i, j) as z from t) where z = 1""")
def regression_bins(lineitem):
    bins = histograms.conditional_percentiles(lineitem, "l_returnflag", "l_quantity", "l_extendedprice", points=_POINTS)
    return histograms.robust_line(bins, "l_returnflag").select("l_returnflag", "inliers", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


def _mode(value: str, key: str, table: str, width: float) -> str:
    """SQL of histograms.binned_mode: k, mode."""
    return f"""(with p as (select {key} as k, min({value})::double as a, max({value})::double as b, quantile_cont({value}::double, 0.5) as m from {table} where {value} is not null group by 1),
c as (select k, a, b, m, floor(({value} - a) / {width}) + 1 as i, count(*) as n from {table} join p on {key} = k where {value} is not null group by all), t as (select *, row_number() over (partition by k order by n desc, i) as z from c)
select k, case when i >= ceil((b - a) / {width}) then m else a + (i + 0.5) * {width} end as mode from t where z = 1)"""


@query("events", sql=f"select k as event_type, round(mode, 6) as mode_value from {_mode('value', 'event_type', 'events', 5.0)}")
def mode_bin(events):
    return histograms.binned_mode(events, "event_type", "value", 5.0).select("event_type", F.round("mode", 6).alias("mode_value"))


_SHIFTS = "(select l_suppkey, (l_quantity % 7)::double as dx, l_linenumber::double as dy from lineitem)"


@query("lineitem", sql=f"""with s as {_SHIFTS}, mx as {_mode('dx', 'l_suppkey', _SHIFTS, 0.5)}, my as {_mode('dy', 'l_suppkey', _SHIFTS, 0.5)},
a as (select l_suppkey as k, count(*) as n, quantile_cont(dx, 0.5) as ex, quantile_cont(dy, 0.5) as ey, stddev_pop(sqrt(dx * dx + dy * dy)) / avg(sqrt(dx * dx + dy * dy)) as cv from s group by 1),
j as (select a.*, n > 50 and sqrt(mx.mode * mx.mode + my.mode * my.mode) < 6 as ok, mx.mode as mx, my.mode as my from a join mx using (k) join my using (k))
select k as l_suppkey, round(case when ok then mx else ex end, 2) as dx, round(case when ok then my else ey end, 2) as dy, round(cv, 6) as cv from j""")
def robust_drift(lineitem):
    shifts = lineitem.select("l_suppkey", (F.col("l_quantity") % 7).cast("double").alias("dx"), F.col("l_linenumber").cast("double").alias("dy"))
    return histograms.drift(shifts, "l_suppkey", "dx", "dy", 50, 6.0).withColumn("cv", F.round("cv", 6))


@query("lineitem", sql="""with g as (select floor(l_quantity / 5) as i, count(*) filter (l_returnflag = 'R') / count(*) as density from lineitem group by 1), s as (select l_returnflag = 'R' as blank, density from lineitem join g on floor(l_quantity / 5) = i),
e as (select min(density) as lo, max(density) as hi from s), l as (select unnest(range(1, 8, 2)) as level)
select level, count(*) filter (density < lo + (hi - lo) * level / 7) as spots, round(count(*) filter (blank and density < lo + (hi - lo) * level / 7) / greatest(count(*) filter (density < lo + (hi - lo) * level / 7), 1), 6) as blank_share from s, e, l group by level""")
def threshold_curve(lineitem):
    cell = F.floor(F.col("l_quantity") / 5).alias("i")
    blank = F.col("l_returnflag") == "R"
    grid = lineitem.groupBy(cell).agg((F.count_if(blank) / F.count("*")).alias("density"))
    spots = lineitem.select(cell, blank.alias("blank")).join(grid, "i")
    levels = grids.contour_levels(spots, "density", "linear", 8)
    return histograms.threshold_curve(spots, "density", "blank", levels).withColumn("blank_share", F.round("blank_share", 6))


@query("part", sql="""with c as (select *, count(*) over (partition by p_brand, p_size) as c, row_number() over (partition by p_brand, p_size order by p_retailprice desc, p_partkey) as r from part)
select p_partkey, false as again from c where c >= 4 union all select p_partkey, true from c where c >= 4 and c < 8 and r <= least(12 - c, 2 * c)""")
def low_resample(part):
    named = part.withColumn("_g", F.concat_ws("/", "p_brand", "p_size"))
    return assembly.with_heads_again(named, "_g", [F.col("p_retailprice").desc(), F.col("p_partkey")]).select("p_partkey", "again")


@query("part", sql="""select p_brand || '_' || (p_partkey // 2) as name, coalesce(string_agg(p_name, '' order by p_name) filter (p_partkey % 2 = 0), '') as splint, coalesce(string_agg(p_name, '' order by p_name) filter (p_partkey % 2 = 1), '') as padlock,
arg_min(p_size, (p_brand || '_' || (p_partkey // 2) || '_' || case p_partkey % 2 when 0 then 'splint' else 'padlock' end, p_name)) as p_size from part group by p_brand || '_' || (p_partkey // 2)""")
def arm_pairs(part):
    arm = F.when(F.col("p_partkey") % 2 == 0, "splint").otherwise("padlock")
    named = part.select(F.concat_ws("_", "p_brand", F.floor(F.col("p_partkey") / 2).cast("string"), arm).alias("name"), "p_name", "p_size")
    return assembly.arms_side_by_side(named, "name", "p_name", ["p_size"])


@query("events", sql="""with c as (select user_id, event_type || '/' || (floor(value)::bigint % 10) as gene, count(*) as n from events where value is not null group by all),
k as (select user_id from c group by 1 having count(*) >= 3 and sum(n) >= 4 and sum(n) <= 60), s as (select * from c where user_id in (select user_id from k)), g as (select gene from s group by 1 having count(*) >= 5)
select user_id, gene, n from s where gene in (select gene from g)""")
def cell_gene_filter(events):
    gene = F.concat_ws("/", "event_type", (F.floor("value") % 10).cast("string"))
    counts = events.where("value is not null").groupBy("user_id", gene.alias("gene")).agg(F.count("*").alias("n"))
    return assembly.filter_counts(counts, "user_id", "gene", "n", min_genes=3, min_cells=5, min_counts=4, max_counts=60)


@query("events", sql="""with c as (select user_id, event_type, count(*) as n from events group by all), r as (select *, row_number() over (partition by user_id order by n desc) as r, sum(n) over (partition by user_id) as t from c)
select user_id, round(sum(n) filter (r <= 1) * 100.0 / max(t), 6) as pct_top_1, round(sum(n) filter (r <= 2) * 100.0 / max(t), 6) as pct_top_2 from r group by 1""")
def top_gene_share(events):
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    out = assembly.top_share(counts, "user_id", "n", [1, 2])
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("pct_top_1", "pct_top_2")])


@query("lineitem", sql="""with recursive o as (select l_suppkey as g, l_orderkey * 8 + l_linenumber as id, min(l_extendedprice)::double as pos from lineitem group by all),
t as (select g, pos, row_number() over (partition by g order by pos desc, id desc) as r, id from o),
f as (select g, r, id, pos as last, true as kept from t where r = 1
  union all select t.g, t.r, t.id, case when f.last - t.pos < 50 then f.last else t.pos end, f.last - t.pos >= 50 from f join t on t.g = f.g and t.r = f.r + 1)
select g as l_suppkey, count(*) as n, sum(id)::bigint as ids from f where kept group by 1""")
def spaced_probes(lineitem):
    places = lineitem.groupBy("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(F.min("l_extendedprice").cast("double").alias("at"))
    return assembly.spaced(places, "l_suppkey", "at", "id", 50).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("orders", sql="select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P') and o_custkey % 2 = 1")
def equality_filter(orders):
    return assembly.equal_to(orders.withColumn("odd", F.col("o_custkey") % 2), o_orderstatus=["F", "P"], odd=1).select("o_orderkey", "o_orderstatus")


@query("supplier", "nation", "region", sql="select s_suppkey, n_name, r_name from supplier left join (select * from nation where n_regionkey > 0) on s_nationkey = n_nationkey left join (select * from region where r_regionkey <> 2) on n_regionkey = r_regionkey")
def chained_joins(supplier, nation, region):
    n = nation.where("n_regionkey > 0").withColumnRenamed("n_nationkey", "s_nationkey")
    r = region.where("r_regionkey <> 2").withColumnRenamed("r_regionkey", "n_regionkey")
    return assembly.chained_left(supplier.select("s_suppkey", "s_nationkey"), [(n, "s_nationkey"), (r, "n_regionkey")]).select("s_suppkey", "n_name", "r_name")


def _spots(part):
    return part.select((F.col("p_partkey") % 1000).cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"), F.col("p_size").alias("z"), F.when(F.col("p_size") % 9 == 0, F.lit("Blank-1")).otherwise(F.concat_ws("-", F.regexp_replace("p_brand", "#", ""), "p_size")).alias("target"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 50).alias("label"), F.col("p_partkey").alias("idx"))


_SPOTS = "(select (p_partkey % 1000)::double as x, p_retailprice::double as y, p_size as z, case when p_size % 9 = 0 then 'Blank-1' else replace(p_brand, '#', '') || '-' || p_size end as target, case when p_partkey % 3 > 0 then p_partkey % 50 end as label, p_partkey as idx from part)"


@query("part", sql=f"select x, y, z, split_part(target, '-', 1) as gene, coalesce(label, 0) as cell from {_SPOTS} where split_part(target, '-', 1) <> 'Blank'")
def segmentation_export(part):
    return assembly.segmentation_table(_spots(part))


@query("part", sql=f"""with s as {_SPOTS} select round(x * 0.108 - (select min(x * 0.108) from s) + 1, 6) as "X", round(y * 0.108 - (select min(y * 0.108) from s) + 1, 6) as "Y", split_part(target, '-', 1) as gene, idx as "MoleculeID", 1 as "Count" from s""")
def micron_export(part):
    return assembly.micron_table(_spots(part)).withColumns({"X": F.round("X", 6), "Y": F.round("Y", 6)})


@query("supplier", "nation", sql="""with t as (select s_suppkey as transcript_id, s_nationkey as gene_id, case when s_suppkey % 5 = 0 then 'Ensembl_canonical' else 'basic' end as tag, case s_suppkey % 3 when 0 then 'PRINCIPAL:1' when 1 then 'ALTERNATIVE' end as annotation from supplier),
m as (select *, count(*) filter (tag = 'Ensembl_canonical') over (partition by gene_id) as c, count(*) filter (annotation like 'PRINCIPAL%') over (partition by gene_id) as p from t where annotation is not null and gene_id in (select n_nationkey from nation where n_regionkey <> 4))
select transcript_id, gene_id from m where case when c = 1 then tag = 'Ensembl_canonical' when p = 1 then annotation like 'PRINCIPAL%' else true end""")
def transcript_choice(supplier, nation):
    own = supplier.select(F.col("s_suppkey").alias("transcript_id"), F.col("s_nationkey").alias("gene_id"), F.col("s_nationkey").alias("gene_name"), F.when(F.col("s_suppkey") % 5 == 0, "Ensembl_canonical").otherwise("basic").alias("tag"))
    notes = supplier.select(F.col("s_suppkey").alias("transcript_id"), F.when(F.col("s_suppkey") % 3 == 0, "PRINCIPAL:1").when(F.col("s_suppkey") % 3 == 1, "ALTERNATIVE").alias("annotation"))
    genes = nation.where("n_regionkey <> 4").select(F.col("n_nationkey").alias("gene_id"))
    return assembly.resolve_transcripts(own, genes, "principal", notes).select("transcript_id", "gene_id")
