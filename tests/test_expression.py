"""Variable genes and components against dense NumPy, neighbours against all pairs, communities against the best partition."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexum.operators import expression, neighbours
from plexum.operators.spatial import kept
from plexum.plans import registry

SF = "/root/testdata/sf0.001"


def dense_residuals(x, theta=100.0):
    mu = x.sum(axis=1, keepdims=True) * x.sum(axis=0, keepdims=True) / x.sum()
    clip = np.sqrt(len(x))
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(np.clip((x - mu) / np.sqrt(mu + mu * mu / theta), -clip, clip))  # of genes without counts 0


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(5)
    x = rng.poisson(rng.gamma(0.5, 2.0, 30)[None] * rng.uniform(0.5, 3, 60)[:, None])
    x[:, 3] = 0
    x[7:11, 4] = 400  # residuals beyond the clip
    return x[x.sum(axis=1) > 0]


@pytest.fixture(scope="module")
def counts(spark, matrix):
    rows = [(f"c{i}", f"g{j:02d}", int(n)) for i, r in enumerate(matrix) for j, n in enumerate(r) if n]
    return spark.createDataFrame(rows + [(None, "g01", 5), ("c1", None, 5), ("c1", "g03", 0)], "cell string, gene string, n int")


@pytest.mark.parametrize("totals", [expression.TOTALS, 7])
def test_variances_like_dense(counts, matrix, monkeypatch, totals):
    monkeypatch.setattr(expression, "TOTALS", totals)
    got = {r.gene: r for r in expression.gene_variances(counts, "cell", "gene").collect()}
    want = dense_residuals(matrix[:, matrix.sum(axis=0) > 0]).var(axis=0)
    names = [f"g{j:02d}" for j in range(30) if matrix[:, j].sum()]
    assert sorted(got) == names
    assert np.allclose([got[g].residual_variance for g in names], want, atol=1e-9)
    assert np.allclose([got[g]["mean"] for g in names], matrix.mean(axis=0)[matrix.sum(axis=0) > 0])
    top = [r.gene for r in expression.variable_genes(counts, "cell", "gene", 5).collect()]
    assert top == [names[k] for k in np.argsort(-want, kind="stable")[:5]]
    assert expression.gene_variances(counts.limit(0), "cell", "gene").count() == 0


def test_vectors_and_components_like_dense(counts, matrix):
    genes = [f"g{j:02d}" for j in (4, 0, 9, 12, 20, 21)]
    x = matrix[:, [4, 0, 9, 12, 20, 21]]
    keep = x.sum(axis=1) > 0
    x, own = x[keep], [f"c{i}" for i in np.flatnonzero(keep)]
    got = {r.cell: r for r in expression.residual_vectors(counts, "cell", "gene", genes).collect()}
    assert sorted(got) == sorted(own)
    want = dense_residuals(x)
    assert np.allclose([got[c].residuals for c in own], want) and (np.array([got[c].raw for c in own]) == x).all()
    assert np.allclose([got[c].sqrt_norm for c in own], np.sqrt(x * np.median(x.sum(axis=1)) / x.sum(axis=1, keepdims=True)))
    out = {r.cell: r.components for r in expression.principal_components(expression.residual_vectors(counts, "cell", "gene", genes), "residuals", 3).collect()}
    u, s, _ = np.linalg.svd(want - want.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs([out[c] for c in own]), np.abs(u * s)[:, :3], atol=1e-8)
    assert expression.principal_components(expression.residual_vectors(counts.limit(0), "cell", "gene", genes), "residuals", 3).count() == 0


def test_graph_recall(spark):
    """Of the exact neighbours of ids that 100 divides, against all rows, at least nine in ten are found, with planted groups and without."""
    for path in ("/root/testdata/sf0.1/embeddings.parquet",):
        df = spark.read.parquet(path)
        graph = kept(neighbours.nearest_graph(df, "vec_id", "embedding"))
        exact = neighbours.exact_nearest(df, df.where("vec_id % 100 = 0"), "vec_id", "embedding", 15)
        n = exact.count()
        assert n == 15 * df.where("vec_id % 100 = 0").count() and exact.join(graph, ["a", "b"]).count() >= 0.9 * n


def test_graph_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WINDOW", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[100:160] = x[100]  # many copies, more than a window
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in neighbours.nearest_graph(df, "id", "v", k=5, metric="euclidean", settled=0.0, rounds=8).collect():
        got.setdefault(r.a, []).append((r.distance, r.b))
    x = np.vstack([x, np.zeros(6)])
    ids = [*range(300), 901]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert sorted(got) == ids and all(len(g) == 5 for g in got.values())
    hits = sum(np.isclose(sorted(v for v, _ in got[i]), np.sort(d[k])[:5], atol=1e-6).all() for k, i in enumerate(ids))
    assert hits >= 0.95 * len(ids)
    assert neighbours.nearest_graph(df.limit(0), "id", "v").count() == 0
    few = neighbours.nearest_graph(df.where("id < 3"), "id", "v", k=5)
    assert few.count() == 6


def q_of(edges, of, resolution=1.0):
    m2 = 2 * sum(w for _, _, w in edges)
    inside, total = {}, {}
    for a, b, w in edges:
        for u, v in ((a, b), (b, a)):
            total[of[u]] = total.get(of[u], 0) + w
            inside[of[u]] = inside.get(of[u], 0) + w * (of[u] == of[v])
    return sum(inside[c] / m2 - resolution * (total[c] / m2) ** 2 for c in total)


def partitions(n):
    def grow(prefix, top):
        if len(prefix) == n:
            yield prefix
            return
        for c in range(top + 1):
            yield from grow([*prefix, c], max(top, c + 1))

    return grow([], 0)


def test_communities_against_all_partitions(spark):
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 2.0), (3, 5, 1.0), (6, 7, 1.0), (2, 3, 1.0), (5, 6, 0.5), (7, 8, 1.0), (6, 8, 1.0)]
    best = max(q_of(edges, dict(enumerate(p))) for p in partitions(9))
    df = spark.createDataFrame([*edges, (1, 0, 1.0), (4, 4, 9.0), (None, 2, 1.0), (2, 7, 0.0)], "a long, b long, w double")
    out = {r.id: r.community for r in neighbours.communities(df).collect()}
    assert sorted(out) == list(range(9)) and q_of(edges, out) >= 0.95 * best
    assert abs(neighbours.modularity(neighbours.both_ways(spark.createDataFrame(edges, "a long, b long, w double")), spark.createDataFrame(list(out.items()), "id long, c long")) - q_of(edges, out)) < 1e-9
    assert neighbours.communities(df.limit(0)).count() == 0


def test_communities_of_planted_groups(spark):
    """A ring of cliques falls into the cliques, and every community is connected."""
    edges = [(f"n{10 * g + i}", f"n{10 * g + j}", 1.0) for g in range(12) for i, j in itertools.combinations(range(10), 2)]
    edges += [(f"n{10 * g}", f"n{(10 * g + 19) % 120}", 1.0) for g in range(12)]
    out = neighbours.communities(spark.createDataFrame(edges, "a string, b string, w double")).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.community, set()).add(int(r.id[1:]) // 10)
    assert len(out) == 120 and all(len(g) == 1 for g in groups.values()) and sorted(groups) == list(range(12)) and {r["size"] for r in out} == {10}


def test_registered_communities(spark):
    out = registry.QUERIES["vector_communities"](spark, SF)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert out.count() == df.count() and out.agg(F.sum(F.when(F.col("community") == 0, 1))).first()[0] == out.where("community = 0").first()["size"]
    sizes = registry.QUERIES["cell_components"](spark, SF)
    assert sizes.groupBy("component").agg(F.sum(F.col("size") ** 2).alias("s")).orderBy("component").agg(F.collect_list("s")).first()[0] == sorted((r.s for r in sizes.groupBy("component").agg(F.sum(F.col("size") ** 2).alias("s")).collect()), reverse=True)


def test_marker_scores_like_ranks(spark):
    rng = np.random.default_rng(11)
    x = rng.poisson(0.7, (40, 12)) - (rng.random((40, 12)) < 0.1)
    x[:, 5] = 0
    groups = rng.integers(0, 3, 40)
    x[groups == 1, 2] += 4
    values = spark.createDataFrame([(i, f"g{j:02d}", int(v)) for (i, j), v in np.ndenumerate(x) if v] + [(None, "g00", 3), (1, None, 3)], "cell int, gene string, n int")
    clusters = spark.createDataFrame([(i, int(k)) for i, k in enumerate(groups)] + [(None, 1), (99, None)], "cell int, cluster int")
    got = {(r.cluster, r.gene): r.score for r in expression.marker_scores(values, clusters, "cell", "gene", "cluster").collect()}
    want = {}
    for j in range(12):
        if x[:, j].any():
            order = np.sort(x[:, j])
            ranks = (np.searchsorted(order, x[:, j], "left") + np.searchsorted(order, x[:, j], "right") + 1) / 2
            for k in range(3):
                n = (groups == k).sum()
                want[k, f"g{j:02d}"] = (ranks[groups == k].sum() - n * 41 / 2) / np.sqrt(n * (40 - n) * 41 / 12)
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    top = expression.marker_genes(values, clusters, "cell", "gene", "cluster", head=2).collect()
    assert len(top) == 6 and next(r.gene for r in top if r.cluster == 1 and r.place == 0) == "g02"
    assert expression.marker_scores(values.limit(0), clusters, "cell", "gene", "cluster").count() == 0


def test_communities_sum_the_weight_of_all_edges_once(spark, monkeypatch):
    known, modularity = [], neighbours.modularity
    monkeypatch.setattr(neighbours, "modularity", lambda g, of, r, m2=None: known.append(m2) or modularity(g, of, r, m2))
    edges = [(a, b, 1.0) for k in (0, 4) for a in range(k, k + 4) for b in range(a) if b >= k] + [(0, 4, 1.0)]
    out = {r.id: r.community for r in neighbours.communities(spark.createDataFrame(edges, "a long, b long, w double")).collect()}
    assert len({out[i] for i in range(4)}) == 1 and len(set(out.values())) == 2 and set(known) == {26.0}
