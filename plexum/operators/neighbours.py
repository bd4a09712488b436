"""Nearest neighbours of vectors and communities of a graph, both by rounds of joins and aggregates.

Neighbours are found twice over. First every vector is sorted, several times, by the sides of random planes it lies on; rows
that follow each other in such an order share most sides, and each window of that order is compared within itself. Windows hold
a fixed number of rows however many are alike. Then neighbours of a vector propose each other: two that stand in one list are
compared, and what is nearer than a list's last is taken in, until hardly anything changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexum.operators import graphs, ordering
from plexum.operators.spatial import kept

#: Rows of an order that are compared with each other, orders, and planes of each.
WINDOW, ORDERS, PLANES = 512, 6, 48

Lists = DataFrame  # a, near: array of (d, b), nearest first


def unit_vectors(df: DataFrame, id: str, vector: str, metric: str) -> DataFrame:
    """a and v; for cosines v has length 1. Null ids and vectors with null or non-finite components are left out, and for cosines zeros."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c))
    sound = F.col(id).isNotNull() & (F.size(vector) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = df.where(F.coalesce(sound, F.lit(False))).select(F.col(id).alias("a"), x.alias("v"), norm.alias("n"))
    if metric == "euclidean":
        return own.select("a", "v")
    return own.where("n > 0").select("a", F.transform("v", lambda c: c / F.col("n")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances; for vectors of length 1 twice the cosine distance."""
    return np.maximum((x * x).sum(axis=-1)[..., :, None] + (y * y).sum(axis=-1)[..., None, :] - 2 * (x @ np.swapaxes(y, -1, -2)), 0)


def _sorted_windows(base: DataFrame, k: int, dim: int, seed: int) -> DataFrame:
    """(a, b, d): each row's k nearest within its window, for every order."""
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(ORDERS, dim, PLANES))
    middle = np.array([base.agg(*[F.avg(F.col("v")[i]) for i in range(dim)]).first()])
    kind = base.schema["a"].dataType.simpleString()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v")) - middle
            for t in range(ORDERS):
                code = ((x @ planes[t] > 0) @ (1 << np.arange(PLANES, dtype=np.int64)[::-1])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), t, np.int32)), pa.array(code), *batch.columns], names=["t", "code", "a", "v"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def near(part: pa.Table) -> pa.RecordBatch:
            x = _matrix(part.column("v").combine_chunks())
            d = _distances(x, x)
            a = part.column("a").combine_chunks()
            same = a.dictionary_encode().indices.to_numpy()
            d[same[:, None] == same[None]] = np.inf
            m = min(k, len(d) - 1)
            at = np.argpartition(d, m - 1, axis=1)[:, :m] if 0 < m < len(d) - 1 else np.broadcast_to(np.arange(len(d)), (len(d), len(d)))
            r, c = np.repeat(np.arange(len(d)), at.shape[1]), at.ravel()
            ok = np.isfinite(d[r, c])
            return pa.RecordBatch.from_arrays([a.take(pa.array(r[ok])), a.take(pa.array(c[ok])), pa.array(d[r, c][ok])], names=["a", "b", "d"])

        for batch in batches:
            held.append(batch.select(["a", "v"]))
            rows = pa.Table.from_batches(held)
            while rows.num_rows >= 2 * WINDOW:
                yield near(rows.slice(0, WINDOW))
                rows = rows.slice(WINDOW)
            held = rows.to_batches()
        if held:
            yield near(pa.Table.from_batches(held))

    coded = base.select("a", "v").mapInArrow(codes, f"t int, code long, a {kind}, v array<double>")
    dealt = coded.repartitionByRange("t", "code", F.xxhash64("a")).sortWithinPartitions("t", "code", F.xxhash64("a"))
    return dealt.mapInArrow(within, f"a {kind}, b {kind}, d double")


def _nearest(found: DataFrame, k: int) -> Lists:
    """The k nearest of each a, ties by b."""
    once = found.groupBy("a", "b").agg(F.min("d").alias("d"))
    w = Window.partitionBy("a").orderBy("d", "b")
    kept = once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return kept.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("near"))


def _proposals(lists: Lists, base: DataFrame, k: int) -> DataFrame:
    """(a, b, d): pairs of one list, and of a list and its owner, where b is nearer to a than the last in a's list."""
    kind = base.schema["a"].dataType.simpleString()
    bound = F.when(F.size("near") < k, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"])
    known = base.join(lists.select("a", bound.alias("bound")), "a").select(F.col("a").alias("u"), "v", "bound")
    members = lists.select("a", F.explode(F.array_append(F.transform("near", lambda x: x["b"]), F.col("a"))).alias("u"))
    groups = members.join(known, "u").groupBy("a").agg(F.collect_list(F.struct("u", "v", "bound")).alias("of"))  # k + 1 each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("of").flatten()
            ids, x, bound = of.field("u"), _matrix(of.field("v")), of.field("bound").to_numpy()
            ends = np.cumsum(batch.column("of").value_lengths().to_numpy())
            left, right, dist = [], [], []
            for size in np.unique(np.diff(np.concatenate([[0], ends]))):  # lists of one length together
                start = (ends - size)[np.diff(np.concatenate([[0], ends])) == size]
                for k in range(0, len(start), 256):
                    at = start[k : k + 256, None] + np.arange(size)
                    d = _distances(x[at], x[at])
                    g, i, j = np.nonzero((d < bound[at][:, :, None]) & ~np.eye(size, dtype=bool))
                    left.append(at[g, i])
                    right.append(at[g, j])
                    dist.append(d[g, i, j])
            if left:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(left))), ids.take(pa.array(np.concatenate(right))), pa.array(np.concatenate(dist))], names=["a", "b", "d"])

    return groups.select("of").mapInArrow(run, f"a {kind}, b {kind}, d double")


def nearest_graph(df: DataFrame, id: str, vector: str, k: int = 15, metric: str = "cosine", rounds: int = 4, settled: float = 0.01, seed: int = 0) -> DataFrame:
    """(a, b, distance): about the k nearest neighbours of each vector, by cosine or Euclidean distance. Rounds end once under
    `settled` of all entries change. ids are unique; fewer than k others give fewer; an empty table gives no rows."""
    base = kept(unit_vectors(df, id, vector, metric))
    one = base.first()
    kind = base.schema["a"].dataType.simpleString()
    if one is None:
        return df.sparkSession.createDataFrame([], f"a {kind}, b {kind}, distance double")
    lists = kept(_nearest(_sorted_windows(base, k, len(one["v"]), seed), k))
    flat = lambda x: x.select("a", F.explode("near").alias("e")).select("a", "e.b", "e.d")
    for _ in range(rounds):
        new = kept(_nearest(flat(lists).unionByName(_proposals(lists, base, k)), k))
        changed, entries = new.join(lists.select("a", F.col("near").alias("old")), "a").agg(F.sum(F.size(F.array_except(F.transform("near", lambda x: x["b"]), F.transform("old", lambda x: x["b"])))), F.sum(F.size("near"))).first()
        lists = new
        if (changed or 0) <= settled * (entries or 1):
            break
    distance = F.sqrt("d") if metric == "euclidean" else F.col("d") / 2
    return flat(lists).select("a", "b", distance.alias("distance"))


def exact_nearest(df: DataFrame, queries: DataFrame, id: str, vector: str, k: int, metric: str = "cosine", block: int = 4096) -> DataFrame:
    """(a, b, distance) of the k nearest of each query, by comparing a stated set of queries with all rows, block by block."""
    base = unit_vectors(df, id, vector, metric)
    kind = base.schema["a"].dataType.simpleString()
    wanted = kept(unit_vectors(queries, id, vector, metric))
    blocks = -(-wanted.count() // block) or 1
    out = None
    for i in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == i).toArrow()  # a block of queries
        ids, q = rows.column("a").combine_chunks(), _matrix(rows.column("v").combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(q):
                    continue
                d = ((q[:, None] - _matrix(batch.column("v"))[None]) ** 2).sum(axis=2) if len(q) * batch.num_rows < 10**5 else _distances(q, _matrix(batch.column("v")))
                m = min(k + 1, batch.num_rows)
                at = np.argpartition(d, m - 1, axis=1)[:, :m]
                r, c = np.repeat(np.arange(len(q)), m), at.ravel()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), batch.column("a").take(pa.array(c)), pa.array(d[r, c])], names=["a", "b", "d"])

        near = base.mapInArrow(run, f"a {kind}, b {kind}, d double").where("a <> b")
        out = near if out is None else out.unionByName(near)
    flat = _nearest(out, k).select("a", F.explode("near").alias("e"))
    return flat.select("a", F.col("e.b").alias("b"), (F.sqrt("e.d") if metric == "euclidean" else F.col("e.d") / 2).alias("distance"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, w): edges (a, b, w) of any direction from either end, each pair once with its largest weight; loops go."""
    turned = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.max("w").alias("w"))
    return turned.unionByName(turned.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def modularity(adjacency: DataFrame, of: DataFrame, resolution: float = 1.0, m2: float | None = None) -> float:
    """Of a partition (id, c) of a graph whose edges stand in adjacency from both ends; a loop's weight counts both its ends. m2:
    the weight of all edges, where it is known."""
    m2 = adjacency.agg(F.sum("w")).first()[0] if m2 is None else m2
    if not m2:
        return 0.0
    left = adjacency.join(of.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    parts = left.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("total"))
    return parts.agg(F.sum(F.col("inside") / m2 - resolution * F.pow(F.col("total") / m2, 2))).first()[0]


def _moved(adjacency: DataFrame, degree: DataFrame, of: DataFrame, m2: float, resolution: float, turn: int) -> DataFrame:
    """(id, c, moved): every second node, by a digest that changes with the turn, may go to the neighbouring community of largest gain."""
    total = of.join(degree, "id").groupBy("c").agg(F.sum("k").alias("total"))
    towards = adjacency.where("a <> b").join(of.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("w"))
    stay = of.select("id", "c", F.lit(0.0).alias("w"))
    options = towards.unionByName(stay).groupBy("id", "c").agg(F.sum("w").alias("w")).join(total, "c")
    own = of.join(degree, "id").select("id", F.col("c").alias("now"), "k")
    here = F.col("c") == F.col("now")
    gain = F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(here, F.col("k")).otherwise(0.0)) / m2
    scored = options.join(own, "id").select("id", "now", "c", F.round(gain, 9).alias("gain"), here.alias("here"))
    # a struct's largest: by gain, then staying, then an arbitrary but fixed order of communities
    best = scored.groupBy("id", "now").agg(F.max(F.struct("gain", "here", F.xxhash64("c").alias("h"), "c")).alias("best"))
    may = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
    to = F.when(may, F.col("best.c")).otherwise(F.col("now"))
    return best.select("id", to.alias("c"), (to != F.col("now")).alias("moved"))


def communities(edges: DataFrame, resolution: float = 1.0, turns: int = 8, levels: int = 6, least_gain: float = 1e-4) -> DataFrame:
    """(id, community, size): local moves by modularity, on the graph and then on the graph of its communities, level by level.
    edges: (a, b, w) in any direction; w is positive. A community whose members are not connected is taken apart. Communities
    are numbered from 0 by size, then by least member. A level ends when a turn and the next bring less than least_gain.

    Nodes that move at once do not see each other's moves; so only half may move in a turn, and the best partition seen stays."""
    whole = kept(both_ways(edges.where("a is not null and b is not null and w > 0").select("a", "b", F.col("w").cast("double").alias("w"))))
    graph = whole
    member = kept(whole.select(F.col("a").alias("id")).distinct().withColumn("c", F.col("id")))
    m2 = whole.agg(F.sum("w")).first()[0]
    if not m2:
        return member.select("id", F.lit(0).cast("long").alias("community"), F.lit(0).cast("long").alias("size")).limit(0)
    reached = modularity(graph, member, resolution, m2)
    for level in range(levels):
        degree = kept(graph.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
        of = degree.select("id", F.col("id").alias("c"))
        best, best_q, idle = of, reached, 0
        for turn in range(turns):
            new = kept(_moved(graph, degree, of, m2, resolution, level * turns + turn))
            of = new.select("id", "c")
            q = modularity(graph, of, resolution, m2)
            idle = 0 if q > best_q + least_gain else idle + 1
            if q > best_q:
                best, best_q = of, q
            if idle == 2:
                break
        if best_q <= reached:
            break
        gained, reached = best_q - reached, best_q
        step = best.select(F.col("id").alias("c"), F.col("c").alias("to"))
        member = kept(member.join(step, "c").select("id", F.col("to").alias("c")))
        ends = graph.join(step.select(F.col("c").alias("a"), F.col("to").alias("ca")), "a").join(step.select(F.col("c").alias("b"), F.col("to").alias("cb")), "b")
        graph = kept(ends.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        if gained < least_gain:
            break
    inside = whole.join(member.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(member.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb")
    connected = graphs.components(member, inside.select("a", "b"))
    sizes = connected.groupBy("label").agg(F.count("*").alias("size")).withColumn("_less", -F.col("size"))
    numbered = ordering.row_index(sizes, "_less", ["label"], "community").drop("_less")
    return connected.join(numbered, "label").select("id", F.col("community").cast("long").alias("community"), "size")
