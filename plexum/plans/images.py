"""Pixel kernels and spot filters over the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexum.operators import graphs, mosaic, outlines, probes, rasters, spots
from plexum.plans.base import query

_PIXELS = "select l_suppkey % 7 as tile, l_linenumber as z, l_orderkey % 64 as y, l_partkey % 64 as x, l_quantity as value from lineitem"


def _pixels(lineitem):
    return lineitem.select(F.pmod("l_suppkey", F.lit(7)).alias("tile"), F.col("l_linenumber").alias("z"), F.pmod("l_orderkey", F.lit(64)).alias("y"), F.pmod("l_partkey", F.lit(64)).alias("x"), F.col("l_quantity").alias("value"))


@query("lineitem", sql=f"select tile, y, x, max(value) as value from ({_PIXELS}) group by all")
def raster_projection(lineitem):
    return rasters.max_projection(_pixels(lineitem), ["tile", "y", "x"])


@query("lineitem", sql=f"select tile, (y // 8)::bigint as y, (x // 8)::bigint as x, round(avg(value), 6) as value from ({_PIXELS}) group by tile, y // 8, x // 8")
def raster_downsample(lineitem):
    return rasters.downsample(_pixels(lineitem), ["tile"], 8).withColumn("value", F.round("value", 6))


@query("lineitem", sql="select l_returnflag, round(sum(greatest(l_quantity - 40 * l_discount * 5.0, 0)), 2) as kept from lineitem group by 1")
def spillover(lineitem):
    left = rasters.spillover(F.col("l_quantity"), 40 * F.col("l_discount"), 5.0)
    return lineitem.groupBy("l_returnflag").agg(F.round(F.sum(left), 2).alias("kept"))


@query("lineitem", sql="""with s as (select *, floor(l_quantity / 5) i, floor(l_discount / 0.025) j from lineitem), g as (select i, j from s group by all having count(*) filter (l_returnflag = 'R') / (count(*) + 1e-9) < 0.3)
select l_returnflag, count(*) as n from s join g using (i, j) group by 1""")
def density_filter(lineitem):
    kept = probes.density_filter(lineitem.withColumn("blank", F.col("l_returnflag") == "R"), "l_quantity", "l_discount", "blank", (5, 0.025), 0.3)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"))


_SET = "select distinct l_suppkey % 7 as tile, l_orderkey % 96 as y, l_partkey % 96 as x from lineitem where l_quantity < 30"


def _set(lineitem):
    """The set pixels of all tiles."""
    kept = lineitem.where("l_quantity < 30")
    return kept.select(F.pmod("l_suppkey", F.lit(7)).alias("tile"), F.pmod("l_orderkey", F.lit(96)).alias("y"), F.pmod("l_partkey", F.lit(96)).alias("x")).distinct()


@query("orders", "lineitem", sql="""with l as (select l_orderkey % 100 as y, l_partkey % 100 as x, max(l_suppkey) as label from lineitem group by all)
select o_orderkey, coalesce(label, 0)::bigint as label from (select o_orderkey, o_totalprice % 100 as py, o_custkey * 0.37 % 100 as px from orders) left join l on floor(py) = y and floor(px) = x""")
def raster_lookup(orders, lineitem):
    labels = lineitem.groupBy(F.pmod("l_orderkey", F.lit(100)).alias("y"), F.pmod("l_partkey", F.lit(100)).alias("x")).agg(F.max("l_suppkey").alias("label"))
    points = orders.select("o_orderkey", (F.col("o_totalprice") % 100).alias("py"), (F.col("o_custkey") * 0.37 % 100).cast("double").alias("px"))
    return rasters.label_at(points, labels, "py", "px").select("o_orderkey", "label")


@query("part", sql="select p_partkey, p_size % 4 as split, p_partkey + case when p_size % 4 in (1, 3) then 964 else 0 end as x, p_size + case when p_size % 4 in (2, 3) then 964 else 0 end as y from part")
def quadrant_split(part):
    split = F.pmod("p_size", F.lit(4))
    x, y = rasters.split_offset(split, F.col("p_partkey"), F.col("p_size"))
    return part.select("p_partkey", split.alias("split"), x.alias("x"), y.alias("y"))


@query("lineitem", sql=f"select tile, ((y // 6) * 16 + x // 6 + 1)::bigint as label, count(*) as area, round(avg(y), 6) as centroid_y, round(avg(x), 6) as centroid_x, min(y) as y_min, max(y) as y_max, min(x) as x_min, max(x) as x_max from ({_SET}) group by 1, 2")
def region_properties(lineitem):
    labelled = _set(lineitem).withColumn("label", (F.floor(F.col("y") / 6) * 16 + F.floor(F.col("x") / 6) + 1).cast("long"))
    out = rasters.region_properties(labelled, ["tile"])
    return out.withColumns({c: F.round(c, 6) for c in ("centroid_y", "centroid_x")})


@query("lineitem", sql="select l_returnflag as k, min(l_discount) as y0, min(l_quantity) as x0, max(l_discount + 0.5) as y1, max(l_quantity + 2) as x1 from lineitem group by 1")
def merged_boxes(lineitem):
    return rasters.merge_boxes(lineitem.select(F.col("l_returnflag").alias("k"), F.col("l_discount").alias("y0"), F.col("l_quantity").alias("x0"), (F.col("l_discount") + 0.5).alias("y1"), (F.col("l_quantity") + 2).alias("x1")), "k")


@query("lineitem", sql=f"with s as ({_SET}) select distinct tile, y + a as y, x + b as x from s, range(-1, 2) t(a), range(-1, 2) u(b)")
def raster_dilate(lineitem):
    return rasters.dilate(_set(lineitem), ["tile"], 1)


@query("lineitem", sql=f"with s as ({_SET}), d as (select distinct tile, y + a as y, x + b as x from s, range(-1, 2) t(a), range(-1, 2) u(b)) select tile, y + a as y, x + b as x from d, range(-1, 2) t(a), range(-1, 2) u(b) group by all having count(*) = 9")
def raster_closing(lineitem):
    return rasters.closing(_set(lineitem), ["tile"], 1)


@query("lineitem", sql=f"select tile, (y // 16)::bigint as row, (x // 16)::bigint as col, round(quantile_cont(value, 0.01), 6) as low, round(quantile_cont(value, 0.99), 6) as high from ({_PIXELS}) group by all")
def subtile_percentiles(lineitem):
    out = rasters.subtile_percentiles(_pixels(lineitem), ["tile"], 16, [0.01, 0.99])
    return out.select("tile", "row", "col", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


@query("part", "supplier", sql="""with t as (select s_suppkey * 37 % 1000 as x0, s_suppkey * 91 % 1000 as y0 from supplier), p as (select p_partkey, p_partkey * 13 % 1000 as x, p_partkey * 29 % 1000 as y from part)
select p_partkey, x, y from p where exists (select 1 from t where x >= x0 and x < x0 + 70 and y >= y0 and y < y0 + 50)""")
def tile_coverage(part, supplier):
    tiles = supplier.select((F.col("s_suppkey") * 37 % 1000).alias("x0"), (F.col("s_suppkey") * 91 % 1000).alias("y0"))
    points = part.select("p_partkey", (F.col("p_partkey") * 13 % 1000).alias("x"), (F.col("p_partkey") * 29 % 1000).alias("y"))
    return rasters.covered(points, tiles, 70, 50)


@query("supplier", sql="select s_suppkey, round(s_acctbal * 1.01 + s_suppkey * 0.02 + 3, 4) as y, round(s_acctbal * -0.02 + s_suppkey * 0.99 - 1.5, 4) as x from supplier")
def affine_shift(supplier):
    y, x = rasters.affine(F.col("s_acctbal"), F.col("s_suppkey"), ((1.01, 0.02), (-0.02, 0.99)), (3, -1.5))
    return supplier.select("s_suppkey", F.round(y, 4).alias("y"), F.round(x, 4).alias("x"))


@query("lineitem", sql="with m as (select l_returnflag, min(l_extendedprice) as lo, avg(l_extendedprice) as s from lineitem group by 1) select l_returnflag, round(avg(greatest((l_extendedprice - lo * 1.5) / s, 0)), 6) as mean from lineitem join m using (l_returnflag) group by 1")
def channel_rescale(lineitem):
    m = lineitem.groupBy("l_returnflag").agg((F.min("l_extendedprice") * 1.5).alias("lo"), F.avg("l_extendedprice").alias("s"))
    return lineitem.join(m, "l_returnflag").groupBy("l_returnflag").agg(F.round(F.avg(rasters.rescale(F.col("l_extendedprice"), F.col("lo"), F.col("s"))), 6).alias("mean"))


@query("lineitem")
def pixel_components(lineitem):
    """Spots of whole tiles: all set pixels, no corner. Recursive SQL over these has no end in sight, so tests compare with a flood fill."""
    out = graphs.pixel_components(_set(lineitem), ["tile"], 2, 400)
    return out.withColumns({"y": F.round("y", 6), "x": F.round("x", 6)})


@query("supplier", sql="""with recursive u as (select s_suppkey as id from supplier), f as (select s_suppkey as a, s_suppkey * 3 % 211 as b from supplier where s_suppkey % 4 <> 0), k as (select a, b from f where b in (select id from u)),
e as (select a, b from k union select b, a from k union select id, id from u), w(a, b) as (select id, id from u union select w.a, e.b from w join e on w.b = e.a), l as (select a as id, min(b) as label from w group by 1)
select id, dense_rank() over (order by label) as merged from l""")
def label_merge(supplier):
    faces = supplier.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 3 % 211).alias("b"))
    return graphs.merge_labels(supplier.select(F.col("s_suppkey").alias("id")), faces)


@query("embeddings", sql="""with e as (select vec_id, label, [list_position(embedding[1:4], list_max(embedding[1:4])) - 1, list_position(embedding[5:8], list_max(embedding[5:8])) - 1, list_position(embedding[9:12], list_max(embedding[9:12])) - 1] as code from embeddings),
b as (select code, min(label) as target from e where vec_id % 3 = 0 group by 1) select vec_id, array_to_string(e.code, '') as code, target from e left join b on e.code = b.code""")
def exact_code(embeddings):
    """Per-round strongest channels looked up in a code book; the book is made of the vectors whose id 3 divides."""
    v = embeddings.select("vec_id", "label", probes.round_peaks(F.col("embedding"), 3, 4).alias("code"))
    book = v.where("vec_id % 3 = 0").groupBy("code").agg(F.min("label").alias("target"))
    return v.select("vec_id", "code").join(book, "code", "left").select("vec_id", F.array_join(F.col("code").cast("array<string>"), "").alias("code"), "target")


@query("lineitem", sql=f"""with p as ({_SET}), v as (select tile, y + dy as vy, x + dx as vx, count(*) as n, sum((2 * dy - 1) * (2 * dx - 1)) as diagonal from p, (values (0, 0), (0, 1), (1, 0), (1, 1)) as c(dy, dx) group by all),
k as (select tile, sum(case when n in (1, 3) then 1 when n = 2 and abs(diagonal) = 2 then 2 else 0 end) as corners from v group by 1), a as (select tile, count(*) as area from p group by 1),
j as (select a.tile, count(*) as joined from p a join p b on a.tile = b.tile and ((a.y = b.y and a.x + 1 = b.x) or (a.x = b.x and a.y + 1 = b.y)) group by 1)
select tile, corners::bigint as corners, area, 4 * area - 2 * coalesce(joined, 0) as perimeter from k join a using (tile) left join j using (tile)""")
def region_outlines(lineitem):
    """Corners of the rings around all set pixels of each tile, the area that they go around and their length."""
    own = _set(lineitem).withColumn("label", F.lit(1))
    corners = outlines.outlines(own, ["tile"]).groupBy("tile").agg(F.count("*").alias("corners"))
    x, y, x1, y1 = (F.col(c) for c in ("x", "y", "x1", "y1"))
    sums = outlines.edges(own, ["tile"]).groupBy("tile").agg((F.sum(x * y1 - x1 * y) / 2).cast("long").alias("area"), F.sum(F.abs(x1 - x) + F.abs(y1 - y)).alias("perimeter"))
    return corners.join(sums, "tile")


@query("lineitem", sql="select distinct l_suppkey % 7 as tile, (l_suppkey % 7 + 1)::double as dy, (l_suppkey % 7 * -2)::double as dx from lineitem")
def tile_shifts(lineitem):
    """How far each tile's image, moved round by known steps, lies from itself."""
    image = _pixels(lineitem).groupBy("tile", "y", "x").agg(F.sum("value").alias("value"))
    moved = image.withColumns({"y": F.pmod(F.col("y") - F.col("tile") - 1, F.lit(64)), "x": F.pmod(F.col("x") + 2 * F.col("tile"), F.lit(64))})
    return spots.phase_shifts(image, moved, ["tile"])


@query("lineitem")
def image_spots(lineitem):
    """Spots of each tile's image of 256 x 256 pixels; tests compare cuts into blocks with each other and with planted spots."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(256))
    image = lineitem.groupBy(F.pmod("l_suppkey", F.lit(7)).alias("tile"), at("l_orderkey").alias("y"), at("l_partkey").alias("x")).agg(F.sum("l_quantity").alias("value"))
    out = spots.find_spots(image, ["tile"], 3.0, 3.0, side=64)
    return out.select("tile", "idx", *[F.round(c, 4).alias(c) for c in ("y", "x", "mag", "sharpness", "roundness")])


@query("lineitem", sql=f"""with t as (select tile, y, x, sum(value)::double as v from ({_PIXELS}) group by all),
g as (select y + tile // 3 * 50 as y, x + tile % 3 * 48 as x, v, least(y + 1, x + 1, 64 - y, 64 - x)::double as w from t)
select y, x, round(sum(v * w) / sum(w), 6) as value from g group by 1, 2""")
def mosaic_fused(lineitem):
    """The tiles' images side by side with overlaps, in one."""
    image = _pixels(lineitem).groupBy("tile", "y", "x").agg(F.sum("value").alias("value"))
    tiles = image.select("tile").distinct().select("tile", (F.floor(F.col("tile") / 3) * 50).alias("y"), (F.col("tile") % 3 * 48).alias("x"), F.lit(64).alias("h"), F.lit(64).alias("w"))
    return mosaic.fuse(image, tiles).withColumn("value", F.round("value", 6))
