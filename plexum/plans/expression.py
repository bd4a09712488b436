"""Variable genes, components, neighbours and communities over order lines and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexum.operators import expression, neighbours
from plexum.plans.base import query

_TOP = 50


def _counts(lineitem):
    """Suppliers are cells, parts are genes."""
    return lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))


@query("lineitem", sql=f"""with k as (select l_suppkey as cell, l_partkey as gene, count(*) as n from lineitem group by all), r as (select cell, sum(n) as r from k group by 1), g as (select gene, sum(n) as c from k group by 1), t as (select sum(r) as t, count(*) as cells from r),
z as (select gene, c, cells, r * c / t as mu, coalesce(n, 0) as n from r cross join g cross join t left join k using (cell, gene)),
v as (select gene, any_value(c / cells) as mean, var_pop(greatest(least((n - mu) / sqrt(mu + mu * mu / 100), sqrt(cells)), -sqrt(cells))) as v from z group by 1)
select l_partkey, round(mean, 6) as mean, round(v, 6) as residual_variance from (select gene as l_partkey, mean, v from v order by v desc, gene limit {_TOP})""")
def variable_genes(lineitem):
    """The parts whose numbers by supplier vary most, given totals."""
    out = expression.variable_genes(_counts(lineitem), "l_suppkey", "l_partkey", _TOP)
    return out.select("l_partkey", F.round("mean", 6).alias("mean"), F.round("residual_variance", 6).alias("residual_variance"))


@query("lineitem")
def cell_components(lineitem):
    """Suppliers in the space of ten components of the residuals of variable parts. A component's sign is free, so lengths are told."""
    counts = _counts(lineitem)
    genes = [r[0] for r in expression.variable_genes(counts, "l_suppkey", "l_partkey", _TOP).collect()]
    out = expression.principal_components(expression.residual_vectors(counts, "l_suppkey", "l_partkey", genes), "residuals", 10)
    return out.select("l_suppkey", F.posexplode("components").alias("component", "value")).select("l_suppkey", "component", F.round(F.abs("value"), 5).alias("size"))


_UNIT = "u as (select vec_id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings)"


@query("embeddings", sql=f"""with {_UNIT}, p as (select a.vec_id as a, b.vec_id as b, 1 - list_dot_product(a.v, b.v) / (a.n * b.n) as d from u a, u b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by a order by d, b) as k from p) select a, b, round(d, 6) as distance from r where k <= 15""")
def nearest_vectors(embeddings):
    """The 15 nearest by cosine of every vector whose id 100 divides, of all vectors."""
    out = neighbours.exact_nearest(embeddings, embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", 15)
    return out.select("a", "b", F.round("distance", 6).alias("distance"))


@query("embeddings")
def neighbour_graph(embeddings):
    """About the 15 nearest of every vector; tests measure how many of nearest_vectors it finds."""
    return neighbours.nearest_graph(embeddings, "vec_id", "embedding").select("a", "b", F.round("distance", 6).alias("distance"))


@query("embeddings")
def vector_communities(embeddings):
    """Communities of the graph of nearest neighbours."""
    graph = neighbours.nearest_graph(embeddings, "vec_id", "embedding")
    return neighbours.communities(graph.select("a", "b", F.lit(1.0).alias("w")), resolution=0.8).select(F.col("id").alias("vec_id"), "community", "size")


@query("lineitem", "supplier", sql="""with k as (select l_suppkey as cell, l_partkey as gene, count(*)::double as n from lineitem group by all), c as (select s_suppkey as cell, s_nationkey % 4 as cluster from supplier),
x as (select c.cluster, g.gene, coalesce(n, 0) as v from c cross join (select distinct gene from k join c using (cell)) g left join k on k.cell = c.cell and k.gene = g.gene),
r as (select cluster, gene, rank() over (partition by gene order by v) + (count(*) over (partition by gene, v) - 1) / 2.0 as r from x), t as (select count(*) as t from c),
s as (select cluster, gene, (sum(r) - count(*) * (any_value(t) + 1) / 2.0) / sqrt(count(*) * (any_value(t) - count(*)) * (any_value(t) + 1) / 12.0) as score from r, t group by 1, 2),
p as (select *, row_number() over (partition by cluster order by round(score, 9) desc, gene) - 1 as place from s)
select cluster, gene as l_partkey, place::int as place, round(score, 6) as score from p where place < 5""")
def marker_genes(lineitem, supplier):
    """The five parts that stand out most in each group of suppliers."""
    groups = supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 4).alias("cluster"))
    return expression.marker_genes(_counts(lineitem), groups, "l_suppkey", "l_partkey", "cluster").withColumn("score", F.round("score", 6))
