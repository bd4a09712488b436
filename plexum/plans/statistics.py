"""Summaries of shifts, channels and codes over the order tables, events and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plexum.functions import numbers as N
from plexum.operators import probes, tables
from plexum.plans.base import query

KINDS = ["click", "error", "purchase", "signup", "view"]


@query("part", sql="select p_partkey, p_retailprice from part, (select arg_min(p_retailprice, p_partkey) as f from part) where p_retailprice < 1.05 * f or p_retailprice < 930 or p_retailprice is null")
def relative_to_first(part):
    first = part.agg(F.min_by("p_retailprice", "p_partkey").alias("f"))
    price = F.col("p_retailprice")
    return part.join(F.broadcast(first)).where((price < 1.05 * F.col("f")) | (price < 930) | price.isNull()).select("p_partkey", "p_retailprice")


@query("lineitem", sql="select l_orderkey, l_partkey, l_quantity, round(cbrt(l_quantity) + (('0x' || substr(md5(l_orderkey::varchar), 1, 6))::int / 16777216.0 - 0.5) * 1.5, 6) as x, round(log10(l_extendedprice * (1 - l_discount)), 6) as y from lineitem")
def spot_features(lineitem):
    jitter = (N.uniform(F.col("l_orderkey").cast("string")) - 0.5) * 1.5
    return lineitem.select("l_orderkey", "l_partkey", "l_quantity", F.round(F.cbrt("l_quantity") + jitter, 6).alias("x"), F.round(F.log10(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 6).alias("y"))


@query("part", sql="select p_partkey, round(sqrt(-2 * ln(1 - ('0x' || substr(md5(p_partkey || '|a'), 1, 6))::int / 16777216.0)) * cos(2 * pi() * ('0x' || substr(md5(p_partkey || '|b'), 1, 6))::int / 16777216.0) * 0.5 + p_size, 6) as x, translate(md5('b' || p_partkey), '0123456789abcdef', 'ACGTACGTACGTACGT') as bases from part")
def jitter_and_bases(part):
    key = F.col("p_partkey").cast("string")
    return part.select("p_partkey", F.round(F.col("p_size") + 0.5 * N.normal(key), 6).alias("x"), N.random_bases(F.concat(F.lit("b"), key)).alias("bases"))


@query("part", sql="select p_partkey, p_type from part where (regexp_matches(p_type, '^E') or regexp_matches(p_type, 'S$')) and not (regexp_matches(p_type, 'BRASS') or regexp_matches(p_name, '[0-4]$'))")
def pattern_filter(part):
    return tables.by_patterns(part, ["p_type"], ["^E", "S$"], []).where(~(F.col("p_type").rlike("BRASS") | F.col("p_name").rlike("[0-4]$"))).select("p_partkey", "p_type")


@query("orders", sql="select o_custkey, o_orderkey, o_orderstatus from (select *, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as t, min(case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end) over (partition by o_custkey) as m from orders) where t = m")
def preferred_choice(orders):
    return tables.preferred_rows(orders, "o_custkey", [F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("customer", "nation", sql="select n_name, count(*) as n, round(count(*) / (max(c_acctbal) - min(c_acctbal)), 8) as density from customer join nation on c_nationkey = n_nationkey group by n_name having max(c_acctbal) > min(c_acctbal)")
def density_by_area(customer, nation):
    per = customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), (F.max("c_acctbal") - F.min("c_acctbal")).alias("area")).where("area > 0")
    return per.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n", F.round(F.col("n") / F.col("area"), 8).alias("density"))


@query("events", sql="select min(value) as lo, max(value) as hi, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from events")
def table_extremes(events):
    return events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("events", sql="select 'u' || user_id % 5 as bucket, " + ", ".join(f"count(*) filter (event_type = '{k}') as {k}" for k in KINDS) + " from events group by 1")
def matrix_transpose(events):
    wide = events.groupBy("event_type").agg(*[F.count_if(F.pmod("user_id", F.lit(5)) == i).alias(f"u{i}") for i in range(5)])
    return tables.transpose(wide, "event_type", [f"u{i}" for i in range(5)], KINDS, "bucket")


@query("supplier", "nation", sql="""with m as (select s_nationkey, avg(s_acctbal) mx, avg(s_suppkey) my from supplier group by 1)
select n_name, s_suppkey, round(n_nationkey * 10 + s_acctbal, 2) as x, round(sqrt(pow(s_acctbal - mx, 2) + pow(s_suppkey - my, 2)), 4) as l2 from supplier join m using (s_nationkey) join nation on s_nationkey = n_nationkey""")
def shift_layout(supplier, nation):
    out = tables.distance_to_mean(supplier, "s_nationkey", ["s_acctbal", "s_suppkey"]).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return out.select("n_name", "s_suppkey", F.round(F.col("n_nationkey") * 10 + F.col("s_acctbal"), 2).alias("x"), F.round("l2", 4).alias("l2"))


@query("events", sql="select event_type, round(quantile_cont(value, 0.001), 6) as lo, round(quantile_cont(value, 0.5), 6) as mid, round(quantile_cont(value, 0.9999), 6) as hi from events group by 1")
def percentile_by_channel(events):
    q = F.percentile("value", F.array(F.lit(0.001), F.lit(0.5), F.lit(0.9999)))
    return events.groupBy("event_type").agg(q.alias("q")).select("event_type", *[F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(("lo", "mid", "hi"))])


@query("embeddings", sql="select floor((atan2(embedding[2]::double, embedding[1]::double) + pi()) / (pi() / 12))::bigint as angle_bin, count(*) as n, round(median(embedding[3]::double), 6) as mid, round(avg(embedding[3]::double), 6) as mean from embeddings group by 1")
def angular_bins(embeddings):
    at = lambda i: F.col("embedding")[i].cast("double")
    angle_bin = F.floor((F.atan2(at(1), at(0)) + F.pi()) / (F.pi() / 12)).cast("long")
    return embeddings.groupBy(angle_bin.alias("angle_bin")).agg(F.count("*").alias("n"), F.round(F.median(at(2)), 6).alias("mid"), F.round(F.avg(at(2)), 6).alias("mean"))


_DEVIATIONS = "select l_suppkey, l_linenumber, avg(l_discount) * 20 as d, count(*) as n from lineitem group by all"


def _deviations(lineitem):
    return lineitem.groupBy("l_suppkey", "l_linenumber").agg((F.avg("l_discount") * 20).alias("d"), F.count("*").alias("n"))


@query("lineitem", sql=f"with t as ({_DEVIATIONS}), m as (select l_linenumber, sum(d * n) / sum(n) as d from t where n >= 5 group by 1), w as (select *, d / avg(d) over () as e from m) select l_linenumber, round(e, 6) as deviation, round(sqrt(avg(pow(e - 1, 2)) over ()), 6) as cv from w")
def weighted_deviation(lineitem):
    return tables.channel_deviation(_deviations(lineitem), "l_linenumber", "d", "n", 5).select("l_linenumber", F.round("deviation", 6).alias("deviation"), F.round("cv", 6).alias("cv"))


@query("lineitem", sql="""with a as (select l_partkey % 12 as ch, avg(l_quantity * pow(l_partkey % 12 / 6.0, 2)) as s from lineitem group by 1), b as (select ch, greatest(least(s / avg(s) over (), 2), 0) as s from a), c as (select ch, greatest(s / avg(s) over (), 0.5) as s from b)
select ch, round(s / avg(s) over (), 6) as scale from c""")
def round_zero_scale(lineitem):
    ch = F.pmod("l_partkey", F.lit(12))
    rows = lineitem.select(ch.alias("ch"), (F.col("l_quantity") * F.pow(ch / 6.0, F.lit(2))).alias("s"))
    return tables.initial_scale(rows, "ch", "s").select("ch", F.round("scale", 6).alias("scale"))


@query("lineitem", sql="select b as bit, round(avg(l_quantity + b) filter ((l_partkey >> b) & 1 = 1), 6) as mean, count(*) filter ((l_partkey >> b) & 1 = 1) as n from lineitem, range(0, 6) t(b) where l_returnflag <> 'R' group by 1")
def masked_channel_mean(lineitem):
    on = [F.col("l_partkey").bitwiseAND(1 << b) > 0 for b in range(6)]
    one = lineitem.where("l_returnflag <> 'R'").agg(*[F.struct(F.lit(b).cast("long").alias("bit"), F.round(F.avg(F.when(o, F.col("l_quantity") + b)), 6).alias("mean"), F.count_if(o).alias("n")).alias(f"b{b}") for b, o in enumerate(on)])
    return one.select(F.inline(F.array(*[f"b{b}" for b in range(6)])))


_CODES = probes.spread_codes(8, 3, 2)


@query("part", sql=f"""with g as (select p_brand, sum(p_size)::double as w from part group by 1), c as (select code, row_number() over () as i from (select unnest([{", ".join(map(str, _CODES))}]) as code)),
d as (select s as seed, w, row_number() over (partition by s order by md5(s || ':' || p_brand), p_brand) as i from g, range(0, 200) t(s)),
l as (select seed, b, sum(w * ((code >> b) & 1)) as load from d join c using (i), range(0, 8) t(b) group by all), p as (select seed, load / sum(load) over (partition by seed) as p from l),
e as (select seed, round(sum(case when p > 0 then -p * log2(p) else 0 end), 9) as entropy from p group by 1) select seed::int as seed, entropy from e order by entropy desc, seed limit 1""")
def seeded_search(part):
    genes = part.groupBy("p_brand").agg(F.sum("p_size").cast("double").alias("w"))
    return tables.best_seed(genes, "p_brand", "w", _CODES, 8, 200)


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("lineitem", sql=" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]))
def gene_correlation(lineitem):
    return tables.correlations(lineitem, _MEASURES).withColumn("r", F.round("r", 6))


@query("part", sql="select p_brand, count(*) as n from part group by 1 having count(*) > 10")
def min_count_check(part):
    return part.groupBy("p_brand").agg(F.count("*").alias("n")).where("n > 10")


@query("supplier", "customer", sql="select s_suppkey as k, s_nationkey::varchar as v, s_acctbal::double as b, null::varchar as seg from supplier union all select c_custkey, c_mktsegment, c_nationkey, c_name from customer")
def relaxed_concat(supplier, customer):
    a = supplier.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"), F.col("s_acctbal").alias("b"))
    b = customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.col("c_nationkey").alias("b"), F.col("c_name").alias("seg"))
    return tables.relaxed_union([a, b])


@query("nation", "region", sql="select n_nationkey, n_name, r_name from nation left join region on n_regionkey = r_regionkey")
def checked_left_join(nation, region):
    """A left join that fails on a key without a match."""
    out = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    missing = F.raise_error(F.concat(F.lit("no region for nation "), F.col("n_nationkey").cast("string")))
    return out.select("n_nationkey", "n_name", F.when(F.col("r_regionkey").isNull(), missing).otherwise(F.col("r_name")).alias("r_name"))


@query("orders", "customer", sql="select count(distinct o_custkey) as keys from orders")
def subset_check(orders, customer):
    keys = orders.select("o_custkey").distinct()
    return tables.require_subset(keys, customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").agg(F.count("*").alias("keys"))


@query("events", sql="select event_id, list_sum(list_transform([10, 50, 100, 250, 400], lambda e: (value >= e)::int))::int as bin, dense_rank() over (order by event_type)::int - 1 as code from events")
def digitise_and_code(events):
    names = events.select("event_type").distinct().withColumn("code", F.row_number().over(Window.orderBy("event_type")) - 1)  # one row for each type
    return events.join(F.broadcast(names), "event_type").select("event_id", N.digitise(F.col("value"), [10, 50, 100, 250, 400]).alias("bin"), "code")
