"""Centroid clustering of vectors with Yinyang bounds: Lloyd's result, with most distances never computed.

Centroids are clustered into groups once. A row keeps an upper bound of the distance to its centroid and, for each group, a lower
bound of the distance to the group's other centroids. When centroids move, bounds move with them. A row whose upper bound lies
below all lower bounds keeps its cluster unseen; else its own distance is computed and the test repeated; then groups whose
bound still lies above are passed over, and of the others only centroids that moved less than their group's old bound allows
are scanned exactly. Bounds are floats, moved outwards by more than their rounding, and a tie is never filtered: distances that
decide are exact integers, so the result is Lloyd's to the bit.

Components are taken as floor(scale * x). Sums of the rows that changed cluster update the centroids, as exact integers. Rows
and bounds are kept in the shared folder between rounds; the driver holds centroids only.

Defined cases: vectors of another length, null ones, and such with null or non-finite components are left out; a component of
2^27 or more after scaling raises ValueError, since its squared distances do not fit 64 bits; fewer vectors than centroids give
as many centroids as vectors; of equal first digests the smaller vector starts first, null ids start nowhere; rows that repeat
count as often as they occur; an empty table gives no rows. What else df holds is kept; columns of the same names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import cut, schema_with, with_columns

#: Centroids in a group, on average.
GROUP = 10
#: Rows whose distances are computed at once.
ROWS = 2_000
#: Below this, sums of 64 squared differences fit a long.
LIMIT = 1 << 27
#: How far a bound moves outwards with each step, relative to what it is made of; rounding is 2^-53.
SLACK = 1e-12

STATE = "_vector array<long>, _before int, cluster int, distance long, _upper double, _lower array<double>"


class Step(NamedTuple):
    """What a round knows: centroids, how far each has moved, and each one's group."""

    centroids: np.ndarray
    moved: np.ndarray
    group: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, pair by pair."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _less(bound: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Lower bounds after a move; infinite ones, of nothing yet known or no other member, stay."""
    known = np.where(np.isinf(bound), 0, bound)
    return np.where(np.isinf(bound), bound, known - moved - SLACK * (np.abs(known) + moved))


def groups(centroids: np.ndarray, rounds: int = 5) -> np.ndarray:
    """A group for each centroid: centroids clustered by Lloyd's rounds from evenly spaced ones."""
    n = max(1, len(centroids) // GROUP)
    x = centroids.astype(np.float64)
    at = x[np.linspace(0, len(x) - 1, n).astype(int)] if len(x) else x
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = ((x[:, None, :] - at[None]) ** 2).sum(axis=2).argmin(axis=1) if len(x) else own
        at = np.stack([x[own == g].mean(axis=0) if (own == g).any() else at[g] for g in range(n)]) if len(x) else at
    return np.unique(own, return_inverse=True)[1] if len(x) else own


def assign(x: np.ndarray, step: Step, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row, with the bounds that hold from now on, and how many distances were computed.
    own is -1 for rows not yet assigned, whose bounds say nothing."""
    c, moved, group = step
    n_groups = int(group.max()) + 1
    new = own < 0
    own, upper, old = np.where(new, 0, own), np.where(new, np.inf, upper), np.where(new[:, None], -np.inf, lower)
    shift = np.zeros(n_groups)
    np.maximum.at(shift, group, moved)
    upper = upper + moved[own] + SLACK * (upper + moved[own])
    upper[new] = np.inf
    lower = _less(old, shift)
    computed = 0
    seen = np.flatnonzero(lower.min(axis=1) <= upper)  # the others keep their cluster unseen
    if not len(seen):
        return own, upper, lower, computed
    exact = np.zeros(len(x), np.int64)
    exact[seen] = squared(x[seen], c[own[seen]])
    computed += len(seen)
    upper[seen] = np.sqrt(exact[seen].astype(np.float64)) * (1 + SLACK)
    seen = seen[lower[seen].min(axis=1) <= upper[seen]]
    if not len(seen):
        return own, upper, lower, computed
    open_ = lower[seen] <= upper[seen][:, None]  # groups that may hold a nearer centroid
    # of an open group, those centroids whose own bound, the group's old one less their own move, does not rule them out
    reach = _less(old[seen][:, group], moved)
    scan = open_[:, group] & (reach <= upper[seen][:, None])
    scan[np.arange(len(seen)), own[seen]] = False
    r, j = np.nonzero(scan)
    d = np.full(scan.shape, np.iinfo(np.int64).max)
    d[r, j] = squared(x[seen[r]], c[j])
    computed += len(r)
    d[np.arange(len(seen)), own[seen]] = exact[seen]
    best = d.argmin(axis=1)  # the first of equal ones
    found = d[np.arange(len(seen)), best]
    # bounds: scanned centroids by their distance, filtered ones by their reach; the new centroid is in no bound, the old one is
    known = np.where(scan, np.sqrt(d.astype(np.float64)) * (1 - SLACK), reach)
    at = np.arange(len(seen))
    known[at, own[seen]] = np.sqrt(exact[seen].astype(np.float64)) * (1 - SLACK)
    known[at, best] = np.inf
    tight = np.full((len(seen), n_groups), np.inf)
    for g in range(n_groups):
        tight[:, g] = known[:, group == g].min(axis=1)
    left = own[seen] != best
    keep = ~open_
    keep[at[left], group[own[seen][left]]] = False  # the group of the centroid left behind gains a member, and so may its bound
    lowered = np.minimum(lower[seen], np.where(np.arange(n_groups) == group[own[seen]][:, None], known[at, own[seen]][:, None], np.inf))
    lower[seen] = np.where(keep, lower[seen], np.where(open_, tight, lowered))
    own[seen], upper[seen] = best, np.sqrt(found.astype(np.float64)) * (1 + SLACK)
    return own, upper, lower, computed


def _matrix(column: pa.Array, n: int, kind: type) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def _round(df: DataFrame, step: Step, last: bool) -> DataFrame:
    """df after one assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                n = batch.num_rows
                x = _matrix(batch.column("_vector"), n, np.int64)
                own = batch.column("cluster").to_numpy()
                after, upper, lower, _ = assign(x, step, own, batch.column("_upper").to_numpy(), _matrix(batch.column("_lower"), n, np.float64))
                distance = squared(x, step.centroids[after]) if last else np.zeros(n, np.int64)
                yield with_columns(batch, {"_vector": batch.column("_vector"), "_before": pa.array(own), "cluster": pa.array(after.astype(np.int32)), "distance": pa.array(distance), "_upper": pa.array(upper), "_lower": _lists(lower)})

    return df.mapInArrow(run, schema_with(df, STATE))


def _sums(df: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the rows that changed cluster add to each cluster's sums and counts."""
    changed = df.where("cluster <> _before").select("_vector", F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("_before").alias("c"), F.lit(-1).alias("sign")))).alias("to"))
    parts = changed.where("to.c >= 0").groupBy("to.c").agg(F.sum("to.sign").alias("n"), *[F.sum(F.col("_vector")[i] * F.col("to.sign")).alias(f"s{i}") for i in range(dim)]).collect()  # a row for each centroid
    sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for r in parts:
        sums[r["c"]], counts[r["c"]] = r[2:], r["n"]
    return sums, counts


def fit(df: DataFrame, k: int, rounds: int, dim: int, vector: str = "embedding", id: str = "vec_id", seed: str = "", scale: int = 1) -> tuple[DataFrame, np.ndarray]:
    """df with cluster and distance (squared) after `rounds` rounds and a last assignment, and the centroids. Centroids start as
    the k vectors of least sha256 of seed and id."""
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * scale))
    sound = F.col(vector).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = df.where(F.coalesce(sound, F.lit(False)))
    far = F.exists(x, lambda v: F.abs(v) >= LIMIT)
    values = F.when(far, F.raise_error(F.lit(f"a component reaches {LIMIT}: its distances do not fit 64 bits")).cast("array<long>")).otherwise(x)
    first = whole.where(F.col(id).isNotNull()).select(F.sha2(F.concat(F.lit(seed), F.col(id).cast("string")), 256).alias("_hash"), values.alias("_vector")).orderBy("_hash", "_vector").limit(k).collect()
    centroids = np.array([r["_vector"] for r in first], np.int64).reshape(-1, dim)
    if not len(centroids):
        return df.limit(0).select(*[c for c in df.columns if c.lower() not in ("cluster", "distance")], F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    group = groups(centroids)
    none = F.array(*[F.lit(0.0)] * (int(group.max()) + 1))
    state = whole.withColumns({"_vector": values, "_before": F.lit(-1), "cluster": F.lit(-1), "distance": F.lit(0).cast("long"), "_upper": F.lit(0.0), "_lower": none})
    moved, sums, counts = np.zeros(len(centroids)), np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    for i in range(rounds + 1):
        state = cut(_round(state, Step(centroids, moved, group), last=i == rounds))
        if i < rounds:
            more = _sums(state, len(centroids), dim)
            sums, counts = sums + more[0], counts + more[1]
            after = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
            moved = np.sqrt(squared(after, centroids).astype(np.float64)) * (1 + SLACK)
            centroids = after
    return state.drop("_vector", "_before", "_upper", "_lower"), centroids
