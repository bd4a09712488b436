"""Choices in which each row depends on those taken before it, without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexum.operators.spatial import kept

#: Rows of the order that are settled on the driver at once.
BLOCK = 1_024


def first_free_pairs(pairs: DataFrame, left: str, right: str, order: str) -> DataFrame:
    """(left, right): in order, then by sides, a pair is taken if neither side is. Null sides and repeated pairs are left out.

    A pair that comes first among all that share a side with it is taken whatever the others are; so in each round all such
    pairs are taken at once, and what shares a side with them goes. A chain of pairs, each later than the one it meets, takes
    as many rounds as it is long; else they are few."""
    w = F.struct(order, left, right)
    rest = kept(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left, right).agg(F.min(order).alias(order)).withColumn("_o", w))
    taken = None
    while not rest.isEmpty():
        by_left, by_right = (rest.groupBy(side).agg(F.min("_o").alias("_o")) for side in (left, right))
        now = kept(by_left.join(by_right.select("_o"), "_o", "left_semi").select("_o", left, F.col(f"_o.{right}").alias(right)))
        taken = now if taken is None else taken.unionByName(now)
        rest = kept(rest.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti"))
    return (taken if taken is not None else rest).select(left, right)


def edits_below(texts: list[str], words: list[str], distance: int) -> np.ndarray:
    """A row for each text and a column for each word of up to 63 letters: whether they are fewer than `distance` edits apart.
    Columns of the edit table are bit vectors, one step for each letter of all texts at once."""
    out = np.zeros((len(texts), len(words)), bool)
    if not texts or not words:
        return out
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    longest = int(sizes.max())
    letters = np.zeros((len(texts), longest), np.uint32)
    for i, t in enumerate(texts):
        letters[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    known, coded = np.unique(letters, return_inverse=True)
    coded = coded.reshape(letters.shape)
    one = np.uint64(1)
    for k, word in enumerate(words):
        if len(word) > 63:
            raise ValueError("words have at most 63 letters")
        own = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        m = len(own)
        masks = ((known[:, None] == own[None]) @ (one << np.arange(m, dtype=np.uint64))).astype(np.uint64) if m else np.zeros(len(known), np.uint64)
        top = one << np.uint64(max(m - 1, 0))
        up, down = np.full(len(texts), (1 << m) - 1, np.uint64), np.zeros(len(texts), np.uint64)
        score, found = np.full(len(texts), m, np.int64), np.where(sizes == 0, m, 0)
        for j in range(longest):
            eq = masks[coded[:, j]]
            x = eq | down
            d0 = (((eq & up) + up) ^ up) | x
            rise, fall = down | ~(d0 | up), up & d0
            if m:
                score += ((rise & top) > 0).astype(np.int64) - ((fall & top) > 0)
            else:
                score += 1
            rise = rise << one | one
            up, down = (fall << one) | ~(d0 | rise), rise & d0
            found = np.where(sizes == j + 1, score, found)
        out[:, k] = found < distance
    return out


def words_apart(df: DataFrame, word: str, order: str, distance: int) -> DataFrame:
    """(word, place): in order, then by word, each word that is at least `distance` edits from all taken before it.

    The first BLOCK words are settled on the driver; the tasks then drop all words too close to those taken, and the first of
    what is left come next. So every word is compared with taken ones alone, where it lies. Null words are left out."""
    spark = df.sparkSession
    kind = df.schema[order].dataType.simpleString()
    rest = kept(df.where(F.col(word).isNotNull()).groupBy(word).agg(F.min(order).alias(order)))
    taken: list[DataFrame] = []
    place = 0
    while first := rest.orderBy(order, word).limit(BLOCK).select(word).collect():
        own = [r[0] for r in first]
        close = edits_below(own, own, distance)
        free = np.ones(len(own), bool)
        for i in range(len(own)):
            if free[i]:
                free[i + 1 :] &= ~close[i + 1 :, i]
        now = [w for w, f in zip(own, free) if f]
        taken.append(kept(spark.createDataFrame([(w, place + i) for i, w in enumerate(now)], f"`{word}` string, place long")))
        place += len(now)
        done = set(own)

        def far(batches: Iterator[pa.RecordBatch], now=now, done=done) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(word).to_pylist()
                ok = ~edits_below(texts, now, distance).any(axis=1) & np.array([t not in done for t in texts], bool)
                yield batch.filter(pa.array(ok))

        rest = kept(rest.mapInArrow(far, f"`{word}` string, `{order}` {kind}"))
    out = taken[0] if taken else rest.limit(0).select(word, F.lit(0).cast("long").alias("place"))
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def scan_states(df: DataFrame, order: list[str], states: int, moves: Callable[[pa.RecordBatch], np.ndarray], emit: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Run a machine of few states over all rows in order. moves gives, for each row, the next state from each state; emit
    gives the rows to tell, from a batch and the state in which each of its rows is met.

    Rows are dealt to ranges of the order. A range's moves combine to one move from state to state; the driver runs through
    these, a row of numbers for each range, and so knows the state in which each range begins. Rows that tie in all of
    `order` stand in an order of their own that is kept."""
    from pyspark import TaskContext

    dealt = kept(df.repartitionByRange(*order).sortWithinPartitions(*order))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.arange(states)
        for batch in batches:
            for row in moves(batch):
                total = row[total]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tolist()])], names=["part", "to"])

    state, begins = 0, {}
    for part, to in sorted(tuple(r) for r in dealt.mapInArrow(whole, "part long, to array<long>").collect()):
        begins[part], state = state, to[state]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = begins[TaskContext.get().partitionId()]
        for batch in batches:
            met = np.empty(batch.num_rows, np.int64)
            for i, row in enumerate(moves(batch)):
                met[i], now = now, row[now]
            yield emit(batch, met)

    return dealt.mapInArrow(tell, schema)
