"""Alignment of two tokenizers over the same bytes, and how often ids of one go with ids of the other.

The ends of both token sequences, counted in bytes, are united; between two neighbouring ends lies an elementary interval, in
which exactly one token of each side stands: its owners, found by binary search. Each interval is one overlap. Where both sides
end, a group closes; all tokens of one side in a group are linked with all of the other.

Links are counted by documents over the whole corpus. A task unites the id pairs of a block of documents (one row for each pair
and block), counts are summed over blocks, and a join by pair brings them back to each block, which is read beside its documents.
So the pairs that all documents share cross the network once for each block, not once for each document, and no task holds more
than a block. Pairs of ids inside a group are formed from its distinct ids, a bounded number at a time.

Defined cases: null and empty texts, and texts whose tokens do not spell the text with a space before it, have no tokens, no
groups and an empty description; repeated rows count as documents of their own; an empty table gives no rows. What else docs hold
is kept, the text is not; columns of the same names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plexum.llm.common import cut, schema_with, slices, with_columns
from plexum.llm.vocab import ByteBPE, PieceBPE, opened, spans

#: Bytes of text in a block, and id pairs formed at once.
BLOCK_BYTES, PAIRS = 4 << 20, 2 << 20

STATS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class Aligned(NamedTuple):
    """Tokens of some texts, all in one line, and their groups. at_*: where each text's tokens begin, with the end last;
    from_*: where each group's tokens begin; group_at: where each text's groups begin."""

    a: np.ndarray
    b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    from_a: np.ndarray
    from_b: np.ndarray
    group_at: np.ndarray


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals, their owners on both sides, and whether both sides end there."""
    ends = np.union1d(ends_a, ends_b)
    of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, of_a, of_b, (ends_a[of_a] == ends) & (ends_b[of_b] == ends)


def _sizes(vocabulary: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))


def align(texts: pa.Array, a: ByteBPE, b: PieceBPE) -> Aligned:
    """Tokens and groups of each text; texts that either side spells differently have none."""
    sides = []
    for t in (a, b):
        ids, at = t.encode(texts)
        text = b"".join(map(t.bytes.__getitem__, ids.tolist()))
        ends = np.concatenate([[0], np.cumsum(_sizes(t.bytes)[ids])])[at]
        sides.append((ids, at, text, ends))
    (ids_a, at_a, text_a, byte_a), (ids_b, at_b, text_b, byte_b) = sides
    own = texts.to_pylist()
    odd = np.zeros(len(own), bool)
    for i, x in enumerate(own):
        want = b" " + x.encode() if x else b""
        odd[i] = text_a[byte_a[i] : byte_a[i + 1]] != want or text_b[byte_b[i] : byte_b[i + 1]] != want
    ids_a, at_a, ids_b, at_b = *_without(ids_a, at_a, odd), *_without(ids_b, at_b, odd)
    ends_a, ends_b = np.cumsum(_sizes(a.bytes)[ids_a]), np.cumsum(_sizes(b.bytes)[ids_b])
    _, of_a, of_b, shared = intervals(ends_a, ends_b)
    first = np.concatenate([[0], np.flatnonzero(shared) + 1])[:-1]  # the interval that opens each group
    from_a, from_b = np.append(of_a[first], len(ids_a)), np.append(of_b[first], len(ids_b))
    return Aligned(ids_a, ids_b, at_a, at_b, from_a, from_b, np.searchsorted(from_a, at_a))


def _without(ids: np.ndarray, at: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.where(odd, 0, np.diff(at))
    return ids[spans(at[:-1], size)], np.concatenate([[0], np.cumsum(size)])


def describe(x: Aligned, names_a: tuple[np.ndarray, np.ndarray], names_b: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The groups of each text: a1,a2|b1;a3|b2,b3. names_*: ids with what follows inside a group and at its side's end."""
    n_a, n_b = len(x.a), len(x.b)
    size_a, size_b = np.diff(x.from_a), np.diff(x.from_b)
    group_a, group_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
    out = np.empty(n_a + n_b, object)
    place_a, place_b = np.arange(n_a) + x.from_b[group_a], np.arange(n_b) + x.from_a[group_b + 1]
    out[place_a], out[place_b] = names_a[0][x.a], names_b[0][x.b]
    out[place_a[x.from_a[1:] - 1]], out[place_b[x.from_b[1:] - 1]] = names_a[1][x.a[x.from_a[1:] - 1]], names_b[1][x.b[x.from_b[1:] - 1]]
    at = (x.at_a + x.at_b).tolist()
    parts = out.tolist()
    return ["".join(parts[i:j])[:-1] for i, j in zip(at, at[1:])]


def names(n: int, last: str) -> tuple[np.ndarray, np.ndarray]:
    return np.array([f"{i}," for i in range(n)], object), np.array([f"{i}{last}" for i in range(n)], object)


def _distinct(ids: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and how often, of the distinct ids of each group, group by group."""
    key, n = np.unique(group * size + ids, return_counts=True)
    return key // size, key % size, n


def links(x: Aligned, size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, id pair (as one number) and how many links, of the distinct linked pairs of each text."""
    texts = np.repeat(np.arange(len(x.group_at) - 1), np.diff(x.group_at))
    n_groups = len(x.from_a) - 1
    one = (np.diff(x.from_a) == 1) & (np.diff(x.from_b) == 1)  # most groups; the others are expanded
    at = np.flatnonzero(one)
    found = [_summed(texts[at], x.a[x.from_a[at]].astype(np.int64) * size_b + x.b[x.from_b[at]], np.ones(len(at), np.int64), size_a * size_b)]
    sides = []
    for ids, start, size in ((x.a, x.from_a, size_a), (x.b, x.from_b, size_b)):
        group = np.repeat(np.arange(n_groups), np.diff(start))
        many = ~one[group]
        g, i, n = _distinct(ids[many].astype(np.int64), group[many], size)
        sides.append((i, n, np.searchsorted(g, np.arange(n_groups + 1))))
    (ids_a, n_a, start_a), (ids_b, n_b, start_b) = sides
    group = np.repeat(np.arange(n_groups), np.diff(start_a))
    partners = np.diff(start_b)[group]  # of each distinct id of side A
    edges = np.concatenate([[0], np.cumsum(partners)])
    k = 0
    while k < len(group):
        stop = max(k + 1, int(np.searchsorted(edges, edges[k] + PAIRS, "right")) - 1)
        left = np.repeat(np.arange(k, stop), partners[k:stop])
        right = spans(start_b[group[k:stop]], partners[k:stop])
        found.append(_summed(texts[group[left]], ids_a[left] * size_b + ids_b[right], n_a[left] * n_b[right], size_a * size_b))
        k = stop
    return _summed(*map(np.concatenate, zip(*found)), size_a * size_b) if len(found) > 1 else found[0]


def _summed(text: np.ndarray, pair: np.ndarray, n: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's pairs once, ascending, with their sum."""
    key, at = np.unique(text * pairs + pair, return_inverse=True)
    return key // pairs, key % pairs, np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)


def _blocks(docs: DataFrame, text: str, path_a: str, path_b: str, told: Callable[[str], str]) -> DataFrame:
    """A row for each document: its numbers, its pairs as places in its block's list, and with a block's last document the list
    itself and in how many of the block's documents each pair occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = opened(ByteBPE, path_a), opened(PieceBPE, path_b)
        size_a, size_b = len(a.bytes), len(b.bytes)
        spelled_a, spelled_b = names(size_a, "|"), names(size_b, ";")
        for k, batch in enumerate(slices(batches, text, BLOCK_BYTES)):
            x = align(batch.column(text), a, b)
            owner, pair, n = links(x, size_a, size_b)
            listed, place, docs_of = np.unique(pair, return_inverse=True, return_counts=True)
            per_text = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            last = [None] * (batch.num_rows - 1)
            added = {
                "n_a": np.diff(x.at_a), "n_b": np.diff(x.at_b), "n_groups": np.diff(x.group_at),
                "n_links": np.add.reduceat(np.append(np.diff(x.from_a) * np.diff(x.from_b), 0), x.group_at[:-1]) * (np.diff(x.group_at) > 0),
            }
            columns = {c: pa.array(v.astype(np.int64)) for c, v in added.items()} | {
                "groups": pa.array([told(s) if s else "" for s in describe(x, spelled_a, spelled_b)]),
                "_block": pa.array(np.full(batch.num_rows, (TaskContext.get().partitionId() << 32) + k)),
                "_at": _binaries(place.astype(_narrow(len(listed))), per_text),
                "_n": _binaries(np.minimum(n, 255).astype(np.uint8), per_text),
                "_more": _binaries(*_large(n, owner, batch.num_rows)),
                "_pairs": pa.array([*last, listed.astype(np.int64).tobytes()], pa.binary()),
                "_docs": pa.array([*last, docs_of.astype(np.int64).tobytes()], pa.binary()),
            }
            kept = batch.select([c for c in batch.schema.names if c != text])
            yield with_columns(kept, columns)

    return docs.mapInArrow(run, schema_with(docs.drop(text), BLOCK))


BLOCK = "n_a long, n_b long, n_groups long, n_links long, groups string, _block long, _at binary, _n binary, _more binary, _pairs binary, _docs binary"


def _narrow(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def _large(n: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of links that do not fit a byte, text by text."""
    large = n >= 255
    return n[large].astype(np.int64), np.searchsorted(owner[large], np.arange(rows + 1))


def _binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column in one line, and how many each row has."""
    own = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return (np.concatenate(own) if own else np.zeros(0, kind)), np.fromiter(map(len, own), np.int64, len(own))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, docs_of in zip(batch.column("_block").to_pylist(), batch.column("_pairs"), batch.column("_docs")):
            pair = np.frombuffer(pairs.as_buffer(), np.int64)
            for k in range(0, len(pair), 50_000):
                own = pair[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(np.arange(k, k + len(own))), pa.array(own), pa.array(np.frombuffer(docs_of.as_buffer(), np.int64)[k : k + 50_000])], names=["_block", "place", "pair", "n"])


def count_links(docs: DataFrame, path_a: str, path_b: str, text: str = "text", told: Callable[[str], str] = str) -> DataFrame:
    """docs with STATS. n_best counts the links whose pair is in as many documents as any pair of the same id of A; count_sum
    adds up the documents of each link's pair; `told` makes groups from their description, which is itself by default."""
    rows = cut(_blocks(docs, text, path_a, path_b, told))
    size_b = len(opened(PieceBPE, path_b).bytes)
    listed = rows.where("_pairs is not null").select("_block", "_pairs", "_docs").mapInArrow(_listed, "_block long, place long, pair long, n long")
    counts = cut(listed.groupBy("pair").agg(F.sum("n").alias("count")))
    # one row for each id of A: no more than its vocabulary
    best = counts.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("count").alias("best"))
    judged = counts.withColumn("a", F.floor(F.col("pair") / size_b)).join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    known = listed.select("_block", "place", "pair").join(judged, "pair").select("_block", "place", "count", "is_best")
    kept = [f for f in rows.schema.fields if f.name not in ("_block", "_at", "_n", "_more", "_pairs", "_docs", "groups")]
    schema = StructType([*kept, *StructType.fromDDL("n_best long, count_sum long, groups string").fields])

    def run(own: pa.Table, facts: pa.Table) -> pa.Table:
        count, is_best = np.zeros(facts.num_rows, np.int64), np.zeros(facts.num_rows, bool)
        place = facts.column("place").to_numpy()
        count[place], is_best[place] = facts.column("count").to_numpy(), facts.column("is_best").to_numpy()
        at, sizes = _joined(own.column("_at").combine_chunks(), _narrow(facts.num_rows))
        n = _joined(own.column("_n").combine_chunks(), np.uint8)[0].astype(np.int64)
        n[n == 255] = _joined(own.column("_more").combine_chunks(), np.int64)[0]
        row = np.repeat(np.arange(own.num_rows), sizes)
        sums = [np.zeros(own.num_rows, np.int64) for _ in range(2)]
        np.add.at(sums[0], row, n * is_best[at])
        np.add.at(sums[1], row, n * count[at])
        out = own.select([f.name for f in kept])
        for name, value in (("n_best", sums[0]), ("count_sum", sums[1])):
            out = out.append_column(name, pa.array(value))
        return out.append_column("groups", own.column("groups"))

    return rows.drop("_pairs", "_docs").groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(run, schema)
