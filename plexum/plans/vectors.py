"""Vectors, codes and decoding over embeddings, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plexum.functions import numbers as N
from plexum.operators import ordering, tables
from plexum.plans.base import query

_CENTRES = """e as (select vec_id, label, unnest(embedding)::double as v, unnest(range(1, len(embedding) + 1)) as i from embeddings), c as (select label, i, avg(v) as v from e group by all)"""


def centroids(embeddings):
    """The mean vector of each label."""
    long = embeddings.select("label", F.posexplode("embedding").alias("i", "v"))
    return long.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centre"))


@query("embeddings", sql=f"with {_CENTRES} select label, i - 1 as dim, round(v, 6) as mean from c")
def label_centroids(embeddings):
    return centroids(embeddings).select("label", F.posexplode("centre").alias("dim", "mean")).select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query("embeddings", sql=f"with {_CENTRES}, n as (select vec_id, sqrt(sum(v * v)) as norm from e group by 1), m as (select label, sqrt(sum(v * v)) as norm from c group by 1), d as (select e.vec_id, c.label, sum(pow(e.v / n.norm - c.v / m.norm, 2)) as d from e join n using (vec_id) join c using (i) join m on m.label = c.label group by all), r as (select *, row_number() over (partition by vec_id order by d, label) k from d) select r.vec_id, r.label as code, round(sqrt(r.d), 6) as distance, round(n.norm, 6) as norm, n.norm >= 0.5 and sqrt(r.d) <= 1.0 as passes from r join n using (vec_id) where k = 1")
def nearest_code(embeddings):
    """Each vector's nearest code by Euclidean distance of unit vectors. A codebook is small; its size is checked."""
    codes = centroids(embeddings).select(F.col("label").alias("code"), N.unit(F.col("centre")).alias("c"))
    if codes.limit(10_001).count() > 10_000:
        raise ValueError("a codebook holds at most 10 000 codes")
    book = codes.agg(F.array_sort(F.collect_list(F.struct("code", "c"))).alias("book"))
    v = embeddings.select("vec_id", N.unit(F.col("embedding")).alias("u"), N.l2_norm(F.col("embedding")).alias("norm")).join(F.broadcast(book))
    best = F.array_min(F.transform("book", lambda b: F.struct(N.squared_distance(F.col("u"), b["c"]).alias("d"), b["code"].alias("code"))))
    out = v.withColumn("best", best).withColumn("distance", F.sqrt("best.d"))
    return out.select("vec_id", F.col("best.code").alias("code"), F.round("distance", 6).alias("distance"), F.round("norm", 6).alias("norm"), ((F.col("norm") >= 0.5) & (F.col("distance") <= 1.0)).alias("passes"))


@query("embeddings", sql="select vec_id, list_position(embedding, list_max(embedding))::bigint - 1 as peak, round(list_max(embedding)::double, 6) as top from embeddings")
def per_round_max(embeddings):
    return embeddings.select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("peak"), F.round(F.array_max("embedding").cast("double"), 6).alias("top"))


@query("embeddings", sql="select vec_id, round(atan2(embedding[2]::double, embedding[1]::double), 6) as angle from embeddings")
def phase_angle(embeddings):
    return embeddings.select("vec_id", F.round(N.phase(F.col("embedding")[1].cast("double"), F.col("embedding")[0].cast("double")), 6).alias("angle"))


@query("part", sql="select p_partkey, bit_count(p_partkey)::bigint as ones, bit_count(xor(p_partkey, 85))::bigint as distance, array_to_string(list_transform(range(0, 12), lambda i: (p_partkey >> i) & 1), '') as bits from part")
def code_bits(part):
    k = F.col("p_partkey")
    return part.select("p_partkey", F.bit_count(k).cast("long").alias("ones"), N.hamming(k, F.lit(85).cast("long")).cast("long").alias("distance"), F.array_join(N.bits(k, 12).cast("array<string>"), "").alias("bits"))


@query("supplier", sql="with m as (select s_nationkey, s_suppkey % 4 as channel, avg(s_acctbal) as v from supplier group by all) select s_nationkey, round(sqrt(sum(v * v)), 4) as norm from m group by 1")
def round_mean_l2(supplier):
    m = supplier.groupBy("s_nationkey", F.pmod("s_suppkey", F.lit(4)).alias("channel")).agg(F.avg("s_acctbal").alias("v"))
    return m.groupBy("s_nationkey").agg(F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 4).alias("norm"))


@query("embeddings", sql="with t as (select label, vec_id, embedding[1]::double as x from embeddings), r as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as r from t), n as (select count(*) n from t) select label, count(*) as size, round(sum(r) - count(*) * (count(*) + 1) / 2.0, 2) as u from r group by 1")
def rank_sum_markers(embeddings):
    """The rank-sum statistic of each label's first coordinate against all others, ties at their mean rank."""
    values = embeddings.groupBy(F.col("embedding")[0].cast("double").alias("x")).agg(F.count("*").alias("c"))
    ranked = ordering.running_sum(values, "x", F.col("c"), "r").withColumn("r", F.col("r") - (F.col("c") - 1) / 2)
    rows = embeddings.select("label", F.col("embedding")[0].cast("double").alias("x")).join(ranked, "x")
    return rows.groupBy("label").agg(F.count("*").alias("size"), F.round(F.sum("r") - F.count("*") * (F.count("*") + 1) / 2, 2).alias("u"))


@query("embeddings", sql="select vec_id, label, rank_ as rank from (select vec_id, label, row_number() over (partition by label order by sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))) desc, vec_id) as rank_ from embeddings) where rank_ <= 3")
def brightest_per_label(embeddings):
    out = tables.top_per_key(embeddings.withColumn("norm", N.l2_norm(F.col("embedding"))), ["label"], [F.col("norm").desc(), "vec_id"], 3)
    w = Window.partitionBy("label").orderBy(F.col("norm").desc(), "vec_id")
    return out.select("vec_id", "label", F.row_number().over(w).cast("long").alias("rank"))
