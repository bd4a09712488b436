"""Exact Jaccard self-join on word shingles, with adaptive multi-match prefixes.

A document is the set of its distinct shingles of SHINGLE words, as 64-bit hashes; texts with one set share a node. Two nodes
link from a similarity of PERCENT / 100 on. In the order of the hashes, a set of n tokens of which a partner must share t
has the prefix of its first n - t + l tokens; linked sets share at least l tokens of both prefixes. l is on a ladder whose
rungs grow by a quarter, up to REACH percent of n. So:

1. Tokens of the longest prefix go to buckets by token, where those of one node only are dropped and the others get their
   number of nodes.
2. Back at its node, a rung that every partner must have is refuted if fewer than l tokens are left in its prefix; then the
   node leaves. Else it probes at the rung whose tokens promise the fewest candidates. Where even these promise more than
   COST, its prefix is lengthened over the whole set, in the order of rarity (4).
3. Probes meet the nodes that hold their tokens. The tokens that a pair shares are counted, and pairs below the l that both
   prefixes reach are dropped: l or more, if the two sizes ask for more shared tokens than t. Sizes that can't link, given
   the tokens that no other holds, don't meet. The rest are compared exactly.
4. Nodes of step 2 that cost too much share their tokens among themselves, rare ones first; the prefix of c - t + l of the c
   tokens that others hold too must give l shared ones, l being MULTI. They stand in dense groups: so first each is
   compared with the most central node of each of its tokens, and what links becomes a component; then only pairs of
   different components are counted, and compared. No group of near copies is expanded into its pairs.

The links' components are the classes. Every pair of which one node probes is found in step 3, every other in step 4.

Buckets grow with the input, at most BUCKET bytes of entries each on average; one token's entries stay together. Two different
sets with one 64-bit fingerprint would be merged: for 10^9 documents the chance is about one in forty.

Defined cases: null, empty and wordless texts have no shingles and link with nothing; a text of fewer than SHINGLE words is
one shingle; repeated rows and copies link; texts are joined by node, so rows of one doc_id may differ in text; rows with
null doc_id take part, link others, and get the class of their text, null if no row of it has an id; clashing columns are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import cut, in_sketch, schema_with, sketch, slices, with_columns
from plexum.llm.components import components

SHINGLE = 5
PERCENT = 80
#: The highest rung asks for at most this share, in percent, of a set's tokens.
REACH = 15
#: Rungs below its highest at which a node may probe.
PROBE = 1
#: Shared tokens, summed over a prefix, from which a node is compared in the order of rarity instead.
COST = 1_024
#: Shared tokens that a prefix in the order of rarity asks for.
MULTI = 4
#: Meetings that are counted at once.
EVENTS = 4_000_000
#: Bytes of entries in a bucket, on average.
BUCKET = 32 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POSTING = (("token", "<u8"), ("node", "<i8"), ("n", "<u4"), ("rung", "u1"))
_SHARED = (*_POSTING, ("df", "<u4"))
_ENTRY = (("token", "<u8"), ("node", "<i8"), ("rung", "u1"), ("probe", "u1"), ("top", "u1"), ("n", "<u4"), ("most", "<u4"))
_WHOLE = (("token", "<u8"), ("node", "<i8"), ("n", "<u4"))
_COUNTED = (*_WHOLE, ("df", "<u4"))
_RARE = (("token", "<u8"), ("node", "<i8"), ("component", "<i8"), ("n", "<u4"), ("most", "<u4"), ("rest", "<u4"))
_PAIR = (("a", "<i8"), ("b", "<i8"), ("least", "<i4"), ("n", "<i4"))
#: Stands for a node that does not probe.
NONE = 255


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The text's set of shingles as ascending hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = len(words) - size + 1
    out = h[:k]
    for i in range(1, size):
        out = _mix(out + np.uint64(i)) + h[i : i + k]
    return np.unique(_mix(out))


def node_of(tokens: np.ndarray) -> int:
    """The fingerprint of a set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def needed(n, percent: int = PERCENT):
    """Tokens that a set of n must share with any linked one."""
    return -(-n * percent // 100)


def top_rung(n: int, percent: int = PERCENT) -> int:
    """The highest rung of a set of n tokens: the largest k with rung_size(k) at most a share REACH of n."""
    k = 0
    while rung_size(k + 1) <= min(n * REACH // 100, needed(n, percent)):
        k += 1
    return k


def rung_size(k: int) -> int:
    """Shared prefix tokens that rung k asks for: growing by a quarter, one at least."""
    size = 1
    for _ in range(k):
        size = max(size + 1, size * 5 // 4)
    return size


@lru_cache(100_000)
def rungs_of(n: int, percent: int = PERCENT) -> tuple[int, int, int, int]:
    """Of a set of n tokens: its lowest and highest rung, the lowest at which it may probe, and the highest that every
    possible partner has too.

    Partners' highest rungs lie at most n's own less `drop` apart, so the lower of two tops, or PROBE rungs below it, is
    among the rungs of both."""
    top = top_rung(n, percent)
    common = top_rung(int(needed(n, percent)), percent)
    drop = top - top_rung(int(needed(n, percent)), percent)
    return max(0, top - drop - PROBE), top, max(0, top - PROBE), common


def pack(columns, **arrays: np.ndarray) -> bytes:
    return b"".join(arrays[k].astype(kind, copy=False).tobytes() for k, kind in columns)


def unpack(columns, payloads: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in columns)
    parts: dict[str, list[np.ndarray]] = {k: [] for k, _ in columns}
    for p in payloads:
        at, n = 0, len(p) // width
        for k, kind in columns:
            parts[k].append(np.frombuffer(p, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {k: np.concatenate(v) if v else np.zeros(0, kind) for (k, kind), v in zip(columns, parts.values())}


def deal(columns, buckets: np.ndarray, arrays: dict[str, np.ndarray]) -> list[tuple[int, bytes]]:
    """Rows (bucket, payload) of arrays; each bucket's entries keep their order."""
    order = np.argsort(buckets, kind="stable")
    sorted_ = {k: v[order] for k, v in arrays.items()}
    b = buckets[order]
    edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else []
    return [(int(b[s]), pack(columns, **{k: v[s:e] for k, v in sorted_.items()})) for s, e in zip(edges[:-1], edges[1:])]


def sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_shingles and node (null for an empty set), without the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            found = [shingles(x) for x in batch.column(text).to_pylist()]
            yield with_columns(batch.drop_columns([text]), {"n_shingles": pa.array([len(x) for x in found], pa.int64()), "node": pa.array([node_of(x) if len(x) else None for x in found], pa.int64())})

    return docs.mapInArrow(run, schema_with(docs.drop(text), "n_shingles long, node long"))


def _postings(docs: DataFrame, buckets: int, percent: int, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 8 << 20):
            seen: dict[int, tuple] = {}
            for x in batch.column(text).to_pylist():
                s = shingles(x)
                n = len(s)
                if n and (node := node_of(s)) not in seen:
                    low, top, _, _ = rungs_of(n, percent)
                    free = n - needed(n, percent)
                    ends = free + np.array([rung_size(k) for k in range(low, top + 1)])
                    seen[node] = (s[: ends[-1]].copy(), n, np.searchsorted(ends, np.arange(ends[-1]), side="right") + low)
            if not seen:
                continue
            sizes = [len(v[0]) for v in seen.values()]
            tokens = np.concatenate([v[0] for v in seen.values()])
            rows = deal(_POSTING, (tokens % np.uint64(buckets)).astype(np.int64), {
                "token": tokens, "node": np.repeat(np.array(list(seen), np.int64), sizes),
                "n": np.repeat(np.array([v[1] for v in seen.values()]), sizes), "rung": np.concatenate([v[2] for v in seen.values()]),
            })
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["bucket", "payload"])

    return docs.select(text).mapInArrow(run, "bucket int, payload binary")


def _frame(rows: list[tuple[int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"bucket": np.array([b for b, _ in rows], np.int32), "payload": [p for _, p in rows]})


def shared_tokens(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Postings once for each token and node, of tokens with two nodes or more; df: their number."""
    order = np.lexsort((x["node"], x["token"]))
    x = {k: v[order] for k, v in x.items()}
    if not len(order):
        return x | {"df": np.zeros(0, np.uint32)}
    new_token = np.concatenate([[True], x["token"][1:] != x["token"][:-1]])
    first = new_token | np.concatenate([[True], x["node"][1:] != x["node"][:-1]])
    x, new_token = {k: v[first] for k, v in x.items()}, new_token[first]
    which = np.cumsum(new_token) - 1
    df = np.bincount(which)[which]
    keep = df > 1
    return {k: v[keep] for k, v in x.items()} | {"df": df[keep].astype(np.uint32)}


def probe_of(rungs: np.ndarray, df: np.ndarray, n: int, percent: int = PERCENT, cost: int = COST) -> int | None:
    """Of one node, from its shared tokens: the rung at which it probes, NONE if each promises too much, None if a rung that
    every possible partner has is refuted."""
    low, top, probe, common = rungs_of(n, percent)
    held = np.bincount(rungs - low, minlength=top - low + 1).cumsum()
    if any(held[k - low] < rung_size(k) for k in range(low, common + 1)):
        return None
    costs = np.bincount(rungs - low, df, top - low + 1).cumsum()[probe - low :]
    best = int(costs.argmin())
    return probe + best if costs[best] <= cost else NONE


def _expand(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For ranges (first, size): numbers of the ranges and of what is in them, in pieces of about EVENTS."""
    stop = np.cumsum(size)
    at = 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + EVENTS, side="right")))
        s, f = size[at:end], first[at:end]
        yield np.repeat(np.arange(at, end), s), np.arange(s.sum()) + np.repeat(f - (np.cumsum(s) - s), s)
        at = end


def _tally(a: np.ndarray, b: np.ndarray, least: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Pairs once each, with their counts added up and the least count that is asked of them."""
    order = np.lexsort((b, a))
    a, b, least, n = a[order], b[order], least[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return {"a": a[start], "b": b[start], "least": least[start], "n": np.add.reduceat(n, start) if len(start) else n}


def _tallied(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return _tally(*(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in ("a", "b", "least", "n")))


def overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that linked sets of n and m share at least."""
    return -(-percent * (n + m) // (100 + percent))


def _by_size(x: dict[str, np.ndarray], percent: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Entries by token and size; the number of each one's token; and where the partners of its token start and end whose
    size lets them link with it, considering that it can share `most` tokens at the most."""
    order = np.lexsort((x["node"], x["n"], x["token"]))
    x = {k: v[order] for k, v in x.items()}
    x |= {k: x[k].astype(np.int64) for k in ("n", "most")}
    group = np.cumsum(np.concatenate([[0], x["token"][1:] != x["token"][:-1]])[: len(order)]).astype(np.int64)
    place = group << 32 | x["n"]
    up_to = np.minimum((100 + percent) * x["most"] // percent - x["n"], x["n"] * 100 // percent)
    return x, group, np.searchsorted(place, group << 32 | needed(x["n"], percent)), np.searchsorted(place, group << 32 | np.maximum(up_to, 0), side="right")


def meetings(x: dict[str, np.ndarray], percent: int = PERCENT) -> dict[str, np.ndarray]:
    """a, b, least, n: probes and the nodes that hold their tokens, how many prefix tokens they must share and share here."""
    x, _, first, end = _by_size(x, percent)
    asks = np.flatnonzero((x["probe"] != NONE) & (x["rung"] <= x["probe"]) & (end > first))
    sizes = np.array([rung_size(k) for k in range(int(x["top"].max()) + 1)]) if len(first) else np.zeros(1, np.int64)
    parts = []
    for i, y in _expand(first[asks], (end - first)[asks]):
        p = asks[i]
        # of two that probe, the lesser does
        ok = (x["rung"][y] <= x["probe"][p]) & (x["node"][y] != x["node"][p]) & ((x["probe"][y] == NONE) | (x["node"][p] < x["node"][y]))
        p, y = p[ok], y[ok]
        both = overlap(x["n"][p], x["n"][y], percent)
        ok = both <= x["most"][y]
        p, y, both = p[ok], y[ok], both[ok]
        # what a set shares outside its prefix is what the prefix leaves of it at most
        rest = np.maximum(needed(x["n"][p], percent) - sizes[x["probe"][p]], needed(x["n"][y], percent) - sizes[np.minimum(x["probe"][p], x["top"][y])])
        parts.append(_tally(x["node"][p], x["node"][y], both - rest, np.ones(len(p), np.int64)))
    return _tallied(parts)


def leaders(x: dict[str, np.ndarray], percent: int = PERCENT) -> pd.DataFrame:
    """a, b: each node with one of each of its tokens: the one that lacks the fewest shared tokens, which is amid the others."""
    lacks = x["n"].astype(np.int64) - x["most"]
    order = np.lexsort((x["node"], lacks, x["token"]))
    token, node, n, most = (x[k][order] for k in ("token", "node", "n", "most"))
    n, most = n.astype(np.int64), most.astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    lead = np.repeat(start, np.diff(np.append(start, len(token))))
    ok = (node != node[lead]) & (overlap(n, n[lead], percent) <= np.minimum(most, most[lead]))
    pairs = np.unique(np.sort(np.stack([node[lead], node], axis=1)[ok], axis=1), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def crossings(x: dict[str, np.ndarray], percent: int = PERCENT) -> dict[str, np.ndarray]:
    """a, b, least, n: nodes of different components that share tokens. Of a token's nodes, those outside its largest
    component look for partners."""
    x, group, first, end = _by_size(x, percent)
    if not len(group):
        return _tallied([])
    runs, which, size = np.unique(np.stack([group, x["component"]], axis=1), axis=0, return_inverse=True, return_counts=True)
    order = np.lexsort((size, runs[:, 0]))
    largest = order[np.append(runs[order, 0][1:] != runs[order, 0][:-1], True)][group]
    outside = which.ravel() != largest
    asks = np.flatnonzero(outside & (end > first))
    parts = []
    for i, y in _expand(first[asks], (end - first)[asks]):
        p = asks[i]
        ok = (x["component"][p] != x["component"][y]) & (~outside[y] | (x["node"][p] < x["node"][y]))
        p, y = p[ok], y[ok]
        both = overlap(x["n"][p], x["n"][y], percent)
        ok = both <= x["most"][y]
        p, y, both = p[ok], y[ok], both[ok]
        a, b = x["node"][p], x["node"][y]
        parts.append(_tally(np.minimum(a, b), np.maximum(a, b), both - np.maximum(x["rest"][p], x["rest"][y]).astype(np.int64), np.ones(len(p), np.int64)))
    return _tallied(parts)


def _at_nodes(rows: DataFrame, columns, each, out: str) -> DataFrame:
    """Rows of buckets by node: each(arrays of one node) for every node, rows of schema out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unpack(columns, pdf["payload"].tolist())
        order = np.argsort(x["node"], kind="stable")
        x = {k: v[order] for k, v in x.items()}
        edges = np.flatnonzero(np.concatenate([[True], x["node"][1:] != x["node"][:-1], [True]])) if len(order) else []
        found = [r for s, e in zip(edges[:-1], edges[1:]) if (r := each({k: v[s:e] for k, v in x.items()}))]
        return pd.DataFrame(found, columns=[f.split()[0] for f in out.split(", ")])

    return rows.groupBy("bucket").applyInPandas(run, out)


def _share(rows: DataFrame, columns, out, buckets: int) -> DataFrame:
    """Buckets by token: tokens of two nodes or more, with their number of nodes, dealt by node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = shared_tokens(unpack(columns, pdf["payload"].tolist()))
        return _frame(deal(out, x["node"] % buckets, x))

    return rows.groupBy("bucket").applyInPandas(run, "bucket int, payload binary")


def _deal(rows: DataFrame, columns, buckets: int, more: str | None = None) -> DataFrame:
    """Rows with entries (packed) as rows of buckets by token; more: a column to put into each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "entries", 8 << 20):
            packed = batch.column("entries").to_pylist()
            x = unpack(columns, packed)
            if more:
                width = sum(np.dtype(kind).itemsize for _, kind in columns)
                x[more] = np.repeat(batch.column(more).to_numpy(zero_copy_only=False), [len(p) // width for p in packed])
            dealt = deal(columns, (x["token"] % np.uint64(buckets)).astype(np.int64), x)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in dealt], pa.int32()), pa.array([p for _, p in dealt], pa.binary())], names=["bucket", "payload"])

    return rows.mapInArrow(run, "bucket int, payload binary")


def _enough(rows: DataFrame, columns, each, buckets: int) -> DataFrame:
    """a, b: pairs that share as many prefix tokens as they must, counted by each(entries) over all buckets by token."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x = each(unpack(columns, pdf["payload"].tolist()))
        return _frame(deal(_PAIR, (x["a"] ^ x["b"]) % buckets, x))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unpack(_PAIR, pdf["payload"].tolist())
        x = _tally(*(x[k] for k, _ in _PAIR))
        ok = x["n"] >= x["least"]
        return pd.DataFrame({"a": np.minimum(x["a"], x["b"])[ok], "b": np.maximum(x["a"], x["b"])[ok]})

    return rows.groupBy("bucket").applyInPandas(count, "bucket int, payload binary").groupBy("bucket").applyInPandas(add, "a long, b long")


def probed(docs: DataFrame, buckets: int, percent: int = PERCENT, text: str = "text", cost: int = COST) -> DataFrame:
    """node, probe, entries: of each node that may have partners, the rung at which it probes and its shared prefix tokens."""

    def each(x: dict[str, np.ndarray]) -> tuple | None:
        n, node = int(x["n"][0]), int(x["node"][0])
        probe = probe_of(x["rung"], x["df"], n, percent, cost)
        if probe is None:
            return None
        m, top = len(x["token"]), rungs_of(n, percent)[1]
        most = int(needed(n, percent)) - rung_size(top) + m  # all but the tokens of its prefix that no other holds
        return node, probe, pack(_ENTRY, token=x["token"], node=x["node"], rung=x["rung"], **{k: np.full(m, v) for k, v in (("probe", probe), ("top", top), ("n", n), ("most", most))})

    return _at_nodes(_share(_postings(docs, buckets, percent, text), _POSTING, _SHARED, buckets), _SHARED, each, "node long, probe int, entries binary")


def rare_first(held: DataFrame, buckets: int, percent: int = PERCENT, multi: int = MULTI) -> DataFrame:
    """node, entries: of each set in held, its prefix in the order of rarity among the sets of held."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 2 << 20):
            tokens = [_tokens(p) for p in batch.column("packed").to_pylist()]
            size = [len(t) for t in tokens]
            flat = np.concatenate(tokens)
            dealt = deal(_WHOLE, (flat % np.uint64(buckets)).astype(np.int64), {"token": flat, "node": np.repeat(batch.column("node").to_numpy(), size), "n": np.repeat(size, size)})
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in dealt], pa.int32()), pa.array([p for _, p in dealt], pa.binary())], names=["bucket", "payload"])

    def each(x: dict[str, np.ndarray]) -> tuple | None:
        n, c = int(x["n"][0]), len(x["token"])
        t = int(needed(n, percent))
        if c < t:
            return None
        least = min(multi, t)
        prefix = np.lexsort((x["token"], x["df"]))[: c - t + least]
        own = x["node"][prefix]
        return int(own[0]), pack(_RARE, token=x["token"][prefix], node=own, component=own, **{k: np.full(len(prefix), v) for k, v in (("n", n), ("most", c), ("rest", t - least))})

    return _at_nodes(_share(held.mapInArrow(post, "bucket int, payload binary"), _WHOLE, _COUNTED, buckets), _COUNTED, each, "node long, entries binary")


def _tokens(packed: bytes) -> np.ndarray:
    return shingles(zstandard.decompress(packed).decode("utf-8", "surrogatepass"))


def compressed(docs: DataFrame, text: str, only: np.ndarray | None = None) -> DataFrame:
    """node and packed (its text as compressed UTF-8, which takes a third of the space in a shuffle), one row a node; of
    nodes that pass the sketch `only`."""
    sent = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, text, 4 << 20):
            found = {}
            texts = [x for x in batch.column(text).to_pylist() if x]
            nodes = np.array([node_of(t) if len(t := shingles(x)) else 0 for x in texts], np.int64)
            passed = nodes != 0 if sent.value is None else in_sketch(sent.value, nodes)
            for node, x in zip(nodes[passed].tolist(), (x for x, ok in zip(texts, passed) if ok)):
                if node not in found:
                    found[node] = press.compress(x.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(found.values(), pa.binary())], names=["node", "packed"])

    return docs.select(text).mapInArrow(run, "node long, packed binary").dropDuplicates(["node"])


def linked(pairs: DataFrame, held: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b), those whose sets in held link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] = (0, np.zeros(0, np.uint64))
        for batch in slices(batches, "of_b", 2 << 20):
            out = []
            for a, b, of_a, of_b in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "of_a", "of_b"))):
                if last[0] != a or not len(last[1]):
                    last = (a, _tokens(of_a))
                x, y = last[1], _tokens(of_b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    of_b = pairs.join(held.select(F.col("node").alias("b"), F.col("packed").alias("of_b")), "b")
    both = of_b.join(held.select(F.col("node").alias("a"), F.col("packed").alias("of_a")), "a")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, known: DataFrame, percent: int = PERCENT, text: str = "text", cost: int = COST) -> DataFrame:
    """node, component: the classes of nodes that link. known: sets(docs)."""
    spark = docs.sparkSession
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 21 // BUCKET)
    alive = cut(probed(docs, buckets, percent, text, cost))
    pairs = cut(_enough(_deal(alive.select("entries"), _ENTRY, buckets), _ENTRY, lambda x: meetings(x, percent), buckets))
    dense = alive.where(f"probe = {NONE}").select("node")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(dense).distinct()
    held = cut(compressed(docs, text, sketch(wanted, "node")).join(wanted, "node"))
    if dense.isEmpty():
        return components(linked(pairs, held, percent))
    rare = cut(rare_first(held.join(dense, "node"), buckets, percent))
    stars = _deal(rare, _RARE, buckets).groupBy("bucket").applyInPandas(lambda pdf: leaders(unpack(_RARE, pdf["payload"].tolist()), percent), "a long, b long").distinct()
    sure = cut(linked(pairs.union(stars).distinct(), held, percent))
    classes = cut(components(sure))
    placed = rare.join(classes, "node", "left").select("entries", F.coalesce("component", "node").alias("component"))
    more = cut(linked(_enough(_deal(placed, _RARE, buckets, "component"), _RARE, lambda x: crossings(x, percent), buckets), held, percent))
    return classes if more.isEmpty() else components(sure.union(more))


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, cost: int = COST) -> DataFrame:
    """docs without the text, with n_shingles and component_id: the least id that links lead to, its own included."""
    base = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    known = cut(sets(base, "_text"))
    classes = links(base, known, percent, "_text", cost)
    least = known.where("node is not null").groupBy("node").agg(F.min("_id").alias("_least")).join(classes, "node", "left").withColumn("_class", F.coalesce("component", "node"))
    of_class = least.groupBy("_class").agg(F.min("_least").alias("_id"))
    # A row per node, written first, so that Spark can split the rows of a popular node.
    of_node = cut(least.drop("_least").join(of_class.withColumnRenamed("_id", "_least"), "_class", "left").select("node", "_least"))
    named = known.where("node is not null").join(of_node, "node", "left").select("_id", "n_shingles", F.coalesce("_least", "_id").alias("component_id"))
    rest = known.where("node is null").select("_id", "n_shingles", F.col("_id").alias("component_id"))
    return named.unionByName(rest).withColumnRenamed("_id", id)
