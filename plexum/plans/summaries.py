"""Filters, joins, summaries, intervals and spatial joins over the order tables and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexum.functions import numbers as N
from plexum.operators import spatial, tables
from plexum.plans.base import query

KINDS = ["click", "error", "purchase", "signup", "view"]


def n(name: str = "n") -> Column:
    return F.count("*").alias(name)


@query("events", sql="select user_id, " + ", ".join(f"count(*) filter (event_type = '{k}') as {k}" for k in KINDS) + " from events group by user_id")
def cell_gene_pivot(events):
    return tables.cross_counts(events, "user_id", "event_type", KINDS)


@query("events", sql="select event_type, count(*) as n, event_type like 'e%' as is_blank, case when event_type like 'e%' then 'red' else 'blue' end as colour from events group by event_type")
def count_by_key(events):
    blank = F.col("event_type").startswith("e")
    return events.groupBy("event_type").agg(n()).withColumns({"is_blank": blank, "colour": F.when(blank, "red").otherwise("blue")})


@query("events", sql="select user_id, event_type, count(*) as n from events group by all")
def count_by_two_keys(events):
    return events.groupBy("user_id", "event_type").agg(n())


@query("lineitem", sql="select l_suppkey, round(sum(l_quantity), 2) as area, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as x, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as y, round(sum(l_linenumber * l_quantity) / sum(l_quantity), 6) as z from lineitem group by l_suppkey")
def weighted_centroid(lineitem):
    rows = lineitem.select("l_suppkey", F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("y"), F.col("l_linenumber").alias("z"))
    out = tables.weighted_centroids(rows, ["l_suppkey"], "area", ["x", "y", "z"])
    return out.select("l_suppkey", F.round("area", 2).alias("area"), F.round("x", 4).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


@query("lineitem", sql="select l_suppkey, round(sum(case when l_discount <> 0 then l_extendedprice end * l_quantity) / nullif(sum(case when l_discount <> 0 then l_quantity end), 0), 4) as m from lineitem group by l_suppkey")
def null_weighted_mean(lineitem):
    return lineitem.groupBy("l_suppkey").agg(F.round(tables.weighted_mean(F.when(F.col("l_discount") != 0, F.col("l_extendedprice")), F.col("l_quantity")), 4).alias("m"))


@query("customer", sql="select c_mktsegment, min(c_acctbal) as lo, max(c_acctbal) as hi, min(c_custkey) as first_key, max(c_custkey) as last_key from customer group by c_mktsegment")
def group_bounds(customer):
    return customer.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"))


@query("customer", sql="""with b as (select c_mktsegment k, min(c_custkey) x0, max(c_custkey) x1, min(c_acctbal) y0, max(c_acctbal) y1, row_number() over (order by c_mktsegment) - 1 as i from customer group by 1),
m as (select max(x1 - x0) w, max(y1 - y0) h from b)
select k as c_mktsegment, round((i % 2) * (w + 100.0) - x0, 3) as dx, round((i // 2) * (h + 100.0) - y0, 3) as dy from b, m""")
def roi_grid_layout(customer):
    out = tables.shift_rows_to_grid(customer, "c_mktsegment", "c_custkey", "c_acctbal", 2, 100.0)
    return out.select("c_mktsegment", F.round("dx", 3).alias("dx"), F.round("dy", 3).alias("dy"))


@query("supplier", sql="""with c as (select *, avg(s_suppkey) over (partition by s_nationkey) cx, avg(s_acctbal) over (partition by s_nationkey) cy from supplier)
select s_suppkey, round(cx + (s_suppkey - cx) * cos(radians(-30)) - (s_acctbal - cy) * sin(radians(-30)), 4) as x, round(cy + (s_suppkey - cx) * sin(radians(-30)) + (s_acctbal - cy) * cos(radians(-30)), 4) as y from c""")
def roi_rotation(supplier):
    w = Window.partitionBy("s_nationkey")
    x, y = N.rotate_xy(F.col("s_suppkey"), F.col("s_acctbal"), F.avg("s_suppkey").over(w), F.avg("s_acctbal").over(w), 30)
    return supplier.select("s_suppkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("lineitem", "part", sql="select p_brand, count(*) as n, round(sum(l_quantity), 2) as quantity, p_brand is null as missing from lineitem left join part on l_partkey = p_partkey group by p_brand")
def codebook_left_join(lineitem, part):
    out = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.groupBy("p_brand").agg(n(), F.round(F.sum("l_quantity"), 2).alias("quantity")).withColumn("missing", F.col("p_brand").isNull())


@query("lineitem", "orders", sql="select o_orderstatus, l_returnflag, count(*) as n, count(o_orderkey) as matched from lineitem left join orders on l_orderkey = o_orderkey group by all")
def ident_spot_join(lineitem, orders):
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderstatus", "l_returnflag").agg(n(), F.count("o_orderkey").alias("matched"))


@query("orders", "lineitem", sql="select o_orderkey, coalesce(lines, 0) as lines, round(mean_price, 6) as mean_price, max_price from orders left join (select l_orderkey, count(*) lines, avg(l_extendedprice) mean_price, max(l_extendedprice) max_price from lineitem group by 1) on o_orderkey = l_orderkey")
def polygon_intensity_merge(orders, lineitem):
    intensity = lineitem.groupBy("l_orderkey").agg(n("lines"), F.avg("l_extendedprice").alias("mean_price"), F.max("l_extendedprice").alias("max_price"))
    return orders.join(intensity, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.round("mean_price", 6).alias("mean_price"), "max_price")


@query("lineitem", sql="select l_orderkey, count(*) as n from lineitem a where not exists (select 1 from lineitem b where b.l_orderkey = a.l_orderkey and (b.l_returnflag = 'R' or b.l_discount > 0.09)) group by l_orderkey")
def match_filter_anti(lineitem):
    bad = (F.col("l_returnflag") == "R") | (F.col("l_discount") > 0.09)
    return tables.reject_groups(lineitem, "l_orderkey", bad).groupBy("l_orderkey").agg(n())


@query("orders", "lineitem", sql="select o_orderkey, o_orderstatus from orders where o_orderkey in (select l_orderkey from lineitem group by 1 having count(*) = 2)")
def membership_semi(orders, lineitem):
    pairs = lineitem.groupBy("l_orderkey").agg(n()).where("n = 2")
    return orders.join(pairs, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus")


@query("lineitem", sql="select l_orderkey, count(*) as lines from lineitem where l_orderkey in (select l_orderkey from lineitem group by 1 having count(*) = 2) group by l_orderkey")
def pair_completeness(lineitem):
    return tables.groups_of(lineitem, "l_orderkey", 2).groupBy("l_orderkey").agg(n("lines"))


@query("lineitem", sql="select l_partkey, l_extendedprice, l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_quantity) r from lineitem) where r = 1")
def best_per_name(lineitem):
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_quantity"]
    return tables.best_per_key(lineitem.select("l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber", "l_quantity"), ["l_partkey"], order)


@query("nation", "region", sql="select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def convert_lookup(nation, region):
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("lineitem", sql="select l_returnflag, count(*) as before, count(*) filter (l_discount > -0.3 / 20 * l_quantity + 0.4) as after, round(count(*) filter (l_discount > -0.3 / 20 * l_quantity + 0.4) / count(*), 6) as ratio from lineitem group by l_returnflag")
def keep_ratio(lineitem):
    kept = F.col("l_discount") > F.lit(-0.3) / 20 * F.col("l_quantity") + 0.4
    return lineitem.groupBy("l_returnflag").agg(n("before"), F.count_if(kept).alias("after"), F.round(F.count_if(kept) / F.count("*"), 6).alias("ratio"))


@query("lineitem", sql="select case when l_quantity < 5 and l_discount < 0.02 then 1 when l_quantity < 20 then 2 when l_tax > 0.05 then 3 else 0 end as priority, count(*) as n from lineitem group by 1")
def priority_case(lineitem):
    tiers = [F.expr("l_quantity < 5 and l_discount < 0.02"), F.col("l_quantity") < 20, F.col("l_tax") > 0.05]
    return lineitem.groupBy(tables.first_criterion(tiers).alias("priority")).agg(n())


@query("lineitem", sql="select (l_quantity > 10)::int + (l_discount > 0.03)::int + (l_tax < 0.04)::int as oks, count(*) as n, max(greatest(l_discount, l_tax)) as most from lineitem group by 1")
def horizontal_score(lineitem):
    flags = {"ok_q": F.col("l_quantity") > 10, "ok_d": F.col("l_discount") > 0.03, "ok_t": F.col("l_tax") < 0.04}
    df = lineitem.withColumns(flags)
    total = reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in df.columns if c.startswith("ok_")])
    return df.groupBy(total.alias("oks")).agg(n(), F.max(F.greatest("l_discount", "l_tax")).alias("most"))


@query("lineitem", sql="select count(*) as n, round(sum(l_quantity - 10), 2) as x_sum, round(sum(l_discount), 2) as y_sum from lineitem where l_quantity >= 10 and l_quantity < 30 and l_discount >= 0.02")
def bounds_rebase(lineitem):
    df = tables.within_bounds(tables.rebase(lineitem, {"l_quantity": (10, 30)}), {"l_discount": (0.02, None)})
    return df.agg(n(), F.round(F.sum("l_quantity"), 2).alias("x_sum"), F.round(F.sum("l_discount"), 2).alias("y_sum"))


@query("part", sql="select p_partkey, p_retailprice from part where p_retailprice > 0.9 * (select max(p_retailprice) from part)")
def over_share_of_max(part):
    return tables.over_share_of_max(part.select("p_partkey", "p_retailprice"), "p_retailprice", 0.9)


@query("events", sql="select event_type, count(*) as n, round(avg(value), 4) as mean, round(quantile_cont(value, 0.1), 6) as q10, round(quantile_cont(value, 0.5), 6) as median from events group by event_type")
def quantile_summary(events):
    return events.groupBy("event_type").agg(n(), F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", F.lit(0.1)), 6).alias("q10"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"))


@query("events", sql="with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as c from events where value is not null) select event_type, value as q10 from r where i = round(0.1 * (c - 1))")
def quantile_nearest(events):
    return events.groupBy("event_type").agg(N.quantile_nearest(F.collect_list("value"), 0.1).alias("q10"))


@query("events", sql="select event_type, floor(value / 10.0)::bigint as bin, count(*) as n from events where value is not null group by all")
def hist_fixed(events):
    return tables.histogram(events, "event_type", "value", 10.0)


@query("lineitem", sql="select floor(l_quantity / 5)::bigint as i, floor(log10(l_extendedprice) * 10)::bigint as j, count(*) as n, round(count(*) filter (l_returnflag = 'R') / (count(*) + 1e-9), 6) as density from lineitem where l_extendedprice > 0 group by all")
def density_grid(lineitem):
    blank = F.col("l_returnflag") == "R"
    keys = [F.floor(F.col("l_quantity") / 5).cast("long").alias("i"), F.floor(F.log10("l_extendedprice") * 10).cast("long").alias("j")]
    return lineitem.where("l_extendedprice > 0").groupBy(*keys).agg(n(), F.round(F.count_if(blank) / (F.count("*") + F.lit(1e-9)), 6).alias("density"))


@query("events", sql="with c as (select user_id, event_type, count(*) n from events group by all), p as (select user_id, n / sum(n) over (partition by user_id) p from c) select user_id, round(abs(-sum(p * log2(p))), 6) as entropy from p group by 1")
def entropy(events):
    out = tables.entropy(events.groupBy("user_id", "event_type").agg(n()), "user_id")
    return out.select("user_id", F.round(F.abs("entropy"), 6).alias("entropy"))


@query("events", sql="with r as (select user_id, sum(value) filter (event_id % 2 = 0) a, sum(value) filter (event_id % 2 = 1) b from events group by 1) select count(*) as n, round(exp(avg(ln(a / b))), 6) as fold from r where a > 0 and b > 0")
def geo_fold(events):
    even = F.pmod("event_id", F.lit(2)) == 0
    r = events.groupBy("user_id").agg(F.sum(F.when(even, F.col("value"))).alias("a"), F.sum(F.when(~even, F.col("value"))).alias("b"))
    return r.where("a > 0 and b > 0").agg(n(), F.round(F.exp(F.avg(F.ln(F.col("a") / F.col("b")))), 6).alias("fold"))


@query("part", sql="select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) r from part) where r <= 5")
def top_n_per_group(part):
    return tables.top_per_key(part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.col("p_retailprice").desc(), "p_partkey"], 5)


@query("lineitem", sql="select name, count(*) as n, round(sum(value), 2) as total from (unpivot (select l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name name value value) group by name")
def unpivot(lineitem):
    return tables.unpivot(lineitem.select("l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value").groupBy("name").agg(n(), F.round(F.sum("value"), 2).alias("total"))


@query("lineitem", sql="select l_orderkey, string_agg(l_linenumber::varchar || ':' || l_partkey::varchar, ',' order by l_linenumber, l_partkey) as lines from lineitem group by 1")
def list_collect(lineitem):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("lines"))


@query("customer", "orders", sql="select 'with' as side, count(*) as n from (select c_custkey from customer intersect select o_custkey from orders) union all select 'without', count(*) from (select c_custkey from customer except select o_custkey from orders) union all select 'all', count(*) from (select c_custkey from customer union select o_custkey from orders)")
def set_ops(customer, orders):
    a, b = customer.select("c_custkey"), orders.select(F.col("o_custkey").alias("c_custkey"))
    count = lambda name, df: df.agg(n()).select(F.lit(name).alias("side"), "n")
    return count("with", a.intersect(b)).unionByName(count("without", a.exceptAll(b).distinct())).unionByName(count("all", a.union(b).distinct()))


@query("customer", "orders", sql="select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def missing_anti(customer, orders):
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("events", sql="select event_id, event_type, value from events where event_id in (select event_id from events order by md5(event_id::varchar || '7'), event_id limit 100)")
def seeded_sample(events):
    """A sample of fixed size by a seeded hash, alike on every engine and partitioning."""
    return events.select("event_id", "event_type", "value").orderBy(F.md5(F.concat(F.col("event_id").cast("string"), F.lit("7")).cast("binary")), "event_id").limit(100)


@query("lineitem", sql="""with recursive i as (select l_suppkey g, row_number() over (partition by l_suppkey order by day, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) k, day s, day + 20 as e from (select *, date_diff('day', date '1990-01-01', l_shipdate::date) as day from lineitem)),
t as (select g, k, e from i where k = 1 union all select i.g, i.k, i.e from t join lateral (select * from i where i.g = t.g and i.s > t.e order by i.k limit 1) i on true)
select g as l_suppkey, count(*) as taken, sum(e)::bigint as ends from t group by 1""")
def greedy_intervals(lineitem):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    w = Window.partitionBy("l_suppkey").orderBy("start", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = lineitem.withColumn("start", day).withColumn("id", F.row_number().over(w)).select("l_suppkey", "id", "start", (F.col("start") + 20).alias("stop"))
    taken = spatial.greedy_intervals(rows, "l_suppkey")
    return taken.join(rows, ["l_suppkey", "id"]).groupBy("l_suppkey").agg(n("taken"), F.sum("stop").cast("long").alias("ends"))


@query("lineitem", sql="""with i as (select l_suppkey g, date_diff('day', date '1990-01-01', l_shipdate::date) as s from lineitem), v as (select g, s as p, 1 as d from i union all select g, s + 15, -1 from i),
c as (select g, p, sum(d) d from v group by all), r as (select g, p, sum(d) over (partition by g order by p) depth, lead(p) over (partition by g order by p) q from c)
select g as l_suppkey, depth::bigint as depth, sum(q - p)::bigint as bases from r where depth > 0 and q is not null group by all""")
def coverage_depth(lineitem):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    runs = spatial.coverage(lineitem.select("l_suppkey", day.alias("start"), (day + 14).alias("stop")), "l_suppkey")
    return runs.groupBy("l_suppkey", "depth").agg(F.sum(F.col("until") - F.col("since") + 1).cast("long").alias("bases"))


def _boxes(supplier: DataFrame) -> DataFrame:
    x, y = F.pmod(F.col("s_suppkey") * 37, F.lit(997)), F.pmod(F.col("s_suppkey") * 101, F.lit(991))
    return supplier.select(F.col("s_suppkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 30).alias("y1"))


BOXES = "select s_suppkey as id, (s_suppkey * 37) % 997 as x0, (s_suppkey * 101) % 991 as y0, (s_suppkey * 37) % 997 + 30 as x1, (s_suppkey * 101) % 991 + 30 as y1 from supplier"


@query("supplier", sql=f"with b as ({BOXES}) select a.id as left_id, b.id as right_id from b a join b on a.x0 <= b.x1 and a.x1 >= b.x0 and a.y0 <= b.y1 and a.y1 >= b.y0")
def box_overlap(supplier):
    b = _boxes(supplier)
    return spatial.box_overlaps(b, b, 50)


POINTS = "select p_partkey, 1 + (p_partkey * 13) % (select count(*) from supplier) as tile, (p_partkey * 7) % 30 as px, (p_partkey * 11) % 30 as py from part"


@query("part", "supplier", sql=f"with b as ({BOXES}), p as (select p_partkey, tile, x0 + px as x, y0 + py as y, x0, x1, y0, y1 from ({POINTS}) join b on b.id = tile) select p_partkey, tile, x, y from p where x > x0 and x < x1 and y > y0 and y < y1 and not exists (select 1 from b where b.id < tile and x between b.x0 and b.x1 and y between b.y0 and b.y1)")
def exclusive_dedup(part, supplier):
    b = _boxes(supplier)
    tiles = supplier.agg(n("of"))
    p = part.join(F.broadcast(tiles)).select("p_partkey", (F.lit(1) + F.pmod(F.col("p_partkey") * 13, F.col("of"))).alias("tile"), F.pmod(F.col("p_partkey") * 7, F.lit(30)).alias("px"), F.pmod(F.col("p_partkey") * 11, F.lit(30)).alias("py"))
    points = p.join(b, F.col("tile") == F.col("id")).select("p_partkey", "tile", (F.col("x0") + F.col("px")).alias("x"), (F.col("y0") + F.col("py")).alias("y"))
    return spatial.exclusive(points, b, 50)


@query("customer", "supplier", sql="with d as (select c_custkey, c_nationkey, s_suppkey, abs(c_acctbal - s_acctbal) as d from customer join supplier on c_nationkey = s_nationkey) select c_custkey as id, round(min(d), 4) as distance from d group by 1")
def nearest_point(customer, supplier):
    points = customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("v"))
    out = spatial.nearest(points, supplier.select(F.col("s_suppkey").alias("target_id"), F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("v")), "g", ["target_id"])
    return out.where("target_id is not null").select("id", F.round("distance", 4).alias("distance"))


RINGS = {1: [(0, 0), (500, 0), (500, 500), (0, 500)], 2: [(400, 400), (900, 450), (700, 950)], 3: [(100, 600), (300, 600), (300, 900), (200, 700), (100, 900)]}
_EDGES = ", ".join(f"({k}, {x0}, {y0}, {x1}, {y1})" for k, r in RINGS.items() for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1]))


@query("part", sql=f"""with e(label, x0, y0, x1, y1) as (values {_EDGES}), p as (select p_partkey, (p_partkey * 37) % 1000 as x, (p_partkey * 101) % 1000 as y from part),
t as (select p_partkey, x, y, label, (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0) as side, x0, y0, x1, y1 from p, e)
select p_partkey, x, y, label from t group by p_partkey, x, y, label having bool_or(side = 0 and x between least(x0, x1) and greatest(x0, x1) and y between least(y0, y1) and greatest(y0, y1)) or count(*) filter ((y0 > y) <> (y1 > y) and (case when y1 > y0 then side else -side end) > 0) % 2 = 1""")
def point_in_polygon(part):
    spark = part.sparkSession
    rings = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r]) for k, r in RINGS.items()], "label int, ring array<struct<x:double,y:double>>")
    p = part.select("p_partkey", F.pmod(F.col("p_partkey") * 37, F.lit(1000)).alias("x"), F.pmod(F.col("p_partkey") * 101, F.lit(1000)).alias("y"))
    return spatial.points_in_polygons(p, rings, 100)


@query("supplier", sql="""with recursive t as (select s_suppkey id, (s_suppkey * 7) % 23 as col, (s_suppkey * 5) % 19 as row from supplier), p as (select distinct col, row from t),
e as (select a.col c, a.row r, b.col c2, b.row r2 from p a join p b on abs(a.col - b.col) + abs(a.row - b.row) <= 1),
w(c, r, c0, r0) as (select col, row, col, row from p union select e.c2, e.r2, w.c0, w.r0 from w join e on e.c = w.c and e.r = w.r),
m as (select w.c0, w.r0, min(t.id) as label from w join t on t.col = w.c and t.row = w.r group by all) select t.id, m.label from t join m on t.col = m.c0 and t.row = m.r0""")
def components(supplier):
    return spatial.grid_components(supplier.select(F.col("s_suppkey").alias("id"), F.pmod(F.col("s_suppkey") * 7, F.lit(23)).alias("col"), F.pmod(F.col("s_suppkey") * 5, F.lit(19)).alias("row")))


@query("supplier", sql="with t as (select s_suppkey id, (s_suppkey * 7) % 23 as x, (s_suppkey * 5) % 19 as y from supplier), r as (select *, dense_rank() over (order by x) - 1 rx, dense_rank() over (order by y) - 1 ry from t), c as (select count(distinct x) nx, count(distinct y) ny from t) select id, x, y from r, c where rx >= 2 and rx < nx - 2 and ry >= 2 and ry < ny - 2")
def grid_rank_interior(supplier):
    return spatial.interior(supplier.select(F.col("s_suppkey").alias("id"), F.pmod(F.col("s_suppkey") * 7, F.lit(23)).alias("x"), F.pmod(F.col("s_suppkey") * 5, F.lit(19)).alias("y")), 2)


COUNTS = "c as (select user_id, event_type, count(*) n from events group by all)"


@query("events", sql=f"with {COUNTS}, s as (select user_id, sum(n) t from c group by 1), m as (select quantile_cont(t, 0.5) m from s) select user_id, event_type, n, round(ln(1 + n * m / t), 6) as x from c join s using (user_id), m")
def normalize_log1p(events):
    return tables.normalise_log1p(events.groupBy("user_id", "event_type").agg(n()), "user_id").withColumn("x", F.round("x", 6))


@query("events", sql=f"with {COUNTS}, r as (select *, sum(n) over (partition by user_id) a, sum(n) over (partition by event_type) b, sum(n) over () t from c) select user_id, event_type, n, round((n - a * b / t) / sqrt(a * b / t + (a * b / t) * (a * b / t) / 100.0), 6) as x from r")
def pearson_residuals(events):
    return tables.pearson_residuals(events.groupBy("user_id", "event_type").agg(n()), "user_id", "event_type").withColumn("x", F.round("x", 6))


@query("events", sql="select user_id, count(*) as total, count(distinct event_type) as genes, round(count(*) filter (event_type = 'error') * 100.0 / count(*), 6) as pct_error, round(ln(1 + count(*)), 6) as log_total from events group by 1")
def qc_metrics(events):
    return events.groupBy("user_id").agg(n("total"), F.countDistinct("event_type").alias("genes"), F.round(F.count_if(F.col("event_type") == "error") * 100.0 / F.count("*"), 6).alias("pct_error"), F.round(F.log1p(F.count("*")), 6).alias("log_total"))


