"""Operators on the order of rows, and on the grids, over the order tables and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plexum.operators import grids, ordering
from plexum.plans.base import query


@query("events", sql="select event_id, user_id, row_number() over (order by event_id) - 1 as idx from events")
def row_number_index(events):
    return ordering.row_index(events, "event_id", name="idx").select("event_id", "user_id", "idx")


@query("events", sql="select event_id, value from (select *, row_number() over (order by value, event_id) - 1 as r from events) where r % 7 = 0")
def every_nth(events):
    return ordering.every_nth(events, 7, "value", ["event_id"]).select("event_id", "value")


@query("customer", "supplier", sql="select c_custkey, s_suppkey, coalesce(a.i, b.i) as idx from (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer) a full join (select s_suppkey, row_number() over (order by s_suppkey) - 1 as i from supplier) b on a.i = b.i")
def horizontal_concat(customer, supplier):
    return ordering.side_by_side(customer.select("c_custkey"), "c_custkey", supplier.select("s_suppkey"), "s_suppkey").withColumnRenamed("index", "idx")


@query("nation", sql="""with n as (select n_regionkey, n_nationkey, case when n_nationkey % 3 = 0 then n_name else (n_nationkey * 7 % 40)::varchar || '_round' end as name from nation)
select n_nationkey, name, row_number() over (partition by n_regionkey order by try_cast(nullif(regexp_extract(name, '^(\\d+)', 1), '') as bigint) nulls last, name) as place from n""")
def natural_order(nation):
    name = F.when(F.pmod("n_nationkey", F.lit(3)) == 0, F.col("n_name")).otherwise(F.concat((F.col("n_nationkey") * 7 % 40).cast("string"), F.lit("_round")))
    w = Window.partitionBy("n_regionkey").orderBy(*ordering.natural_key(F.col("name")))
    return nation.withColumn("name", name).select("n_nationkey", "name", F.row_number().over(w).cast("long").alias("place"))


@query("lineitem", "orders", sql="""with l as (select l_orderkey, list(l_quantity) as q from lineitem group by 1)
select o_custkey, o_orderkey, list_max(q) as most, row_number() over (partition by o_custkey order by list_max(q) desc, o_orderkey) as place from orders join l on o_orderkey = l_orderkey""")
def list_max_order(lineitem, orders):
    lists = lineitem.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    w = Window.partitionBy("o_custkey").orderBy(F.array_max("q").desc(), "o_orderkey")
    return orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", F.array_max("q").alias("most"), F.row_number().over(w).cast("long").alias("place"))


_GRID = "select least(floor(l_quantity / 5), 9)::bigint as i, floor(l_discount * 100 + 1e-6)::bigint as j, count(*)::double as v from lineitem group by 1, 2"


def _grid(lineitem):
    return lineitem.groupBy(F.least(F.floor(F.col("l_quantity") / 5), F.lit(9)).alias("i"), F.floor(F.col("l_discount") * 100 + 1e-6).alias("j")).agg(F.count("*").cast("double").alias("v"))


@query("lineitem", sql=f"""with g as ({_GRID}), k as (select d, exp(-0.5 * d * d) as w from range(-4, 5) t(d)), kn as (select d, w / sum(w) over () as w from k),
a as (select t.i, s.j, sum(s.v * kn.w) as v from range(0, 10) t(i), kn, g s where s.i = case when t.i + d < 0 then -1 - t.i - d when t.i + d > 9 then 19 - t.i - d else t.i + d end group by 1, 2),
b as (select s.i, t.j, sum(s.v * kn.w) as v from range(0, 11) t(j), kn, a s where s.j = case when t.j + d < 0 then -1 - t.j - d when t.j + d > 10 then 21 - t.j - d else t.j + d end group by 1, 2)
select i, j, round(v, 6) as v from b""")
def grid_smooth(lineitem):
    return grids.smooth(_grid(lineitem), (10, 11), 1.0).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("v", 6).alias("v"))


@query("part", "lineitem", sql=f"""with g as ({_GRID}), p as (select p_partkey as id, (p_partkey % 97) / 10.0 as x, (p_partkey % 89) / 8.0 as y from part),
c as (select *, least(floor(x), 8)::bigint as a, least(floor(y), 9)::bigint as b from p where x <= 9 and y <= 10),
r as (select id, sum(g.v * (case when g.i = a then 1 - (x - a) else x - a end) * (case when g.j = b then 1 - (y - b) else y - b end)) as v from c join g on g.i between a and a + 1 and g.j between b and b + 1 group by 1)
select p.id, round(coalesce(r.v, 0), 6) as v from p left join r using (id)""")
def bilinear_lookup(part, lineitem):
    points = part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97 / 10.0).alias("x"), (F.col("p_partkey") % 89 / 8.0).alias("y"))
    return grids.bilinear(points, _grid(lineitem), (0, 0), (1, 1), (10, 11)).select("id", F.round("v", 6).alias("v"))


@query("part", sql="""with e as (select min(p_retailprice) lo, max(p_retailprice) hi from part), n as (select unnest(range(0, 8)) as level)
select level::int as level, round(lo + (hi - lo) * level / 7.0, 4) as linear, round(pow(sqrt(lo) + (sqrt(hi) - sqrt(lo)) * level / 7.0, 2), 4) as root, round(pow(10, log10(lo) + (log10(hi) - log10(lo)) * level / 7.0), 4) as logarithm from e, n""")
def contour_levels(part):
    each = [grids.contour_levels(part, "p_retailprice", mode, 8).select("level", F.round("v", 4).alias(name)) for mode, name in (("linear", "linear"), ("sqrt", "root"), ("log", "logarithm"))]
    return each[0].join(each[1], "level").join(each[2], "level")
