"""Removal of repeated strings of LENGTH bytes, by difference-cover blockwise suffix comparison.

Only suffixes whose first LENGTH bytes occur twice matter, so a suffix's order is that of its first LENGTH bytes, and equal
ranks are what is looked for. Ranks are fingerprints of those bytes: they order as well as any other names for equality,
and need no global sort. The work goes one suffix bucket (a range of ranks) at a time.

1. Cover sample. Residues of a difference cover modulo PERIOD are sampled: of any two positions some shift below PERIOD
   brings both onto the sample. Sample suffixes are ranked by their first LENGTH - PERIOD + 1 bytes, bucket by bucket. A string
   that occurs twice has a sample whose rank occurs twice; positions without one are out.
2. Ties. What is left is compared over the whole LENGTH. Anchors, positions chosen by the bytes that follow, fall alike in
   all occurrences, so ranks at anchors settle whole stretches between anchors; where stretches differ before one anchor's
   string they are compared position by position.

3. Proof. Ranks only propose: each proposed stretch names another place that has its rank, and goes if 128-bit digests of the
   bytes at both places agree. Starts of stretches that fail are grouped by their LENGTH bytes themselves, with all proposed
   starts of equal rank. So nothing is removed because fingerprints collide.

Texts without repeats stay where they are: a Bloom filter of fixed size keeps them out of the joins.

Buckets grow with the input, one for each BUCKET bytes of text at least, and with them the bits that tell samples apart.
A bucket's entries are sorted in one task; the places of one string stay together.

Texts are UTF-8; equal texts are one key with a count. A key that occurs twice and has LENGTH bytes goes whole. Two different
texts with one 64-bit key would be taken for one: for 10^9 texts the chance is about one in forty.

Defined cases: null text counts as empty; texts of fewer than LENGTH bytes are never touched; matches do not cross rows;
rows that repeat remove each other; what is removed may split a character, so `kept` is binary; clashing columns are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import cut, in_sketch, schema_with, sketch, slices, with_columns
from plexum.llm.ngram_join import deal, pack, unpack

LENGTH = 200
PERIOD = 133
#: Bytes that choose an anchor; one position in EVERY is one. Stretches between anchors over GAP are always compared singly.
ANCHOR, EVERY, GAP = 8, 16, 64
_REF = (("key", "<i8"), ("low", "<u2"), ("high", "<u2"))
_SAMPLE = (("rank", "<u4"), *_REF)
_TIE = (("rank", "<u8"), ("whole", "<u8"), ("kind", "u1"), *_REF)
_SINGLE = (("rank", "<u8"), *_REF)
#: Another place of the same string: its text, and how far on it stands there.
_OTHER = (("other", "<i8"), ("shift", "<i4"))
_DUP = (("kind", "u1"), *_REF, *_OTHER)
_RUN = (("key", "<i8"), ("start", "<u4"), ("size", "<u4"), *_OTHER)
_CLAIM = (("start", "<u4"), ("size", "<u4"), ("shift", "<i4"))
#: Bytes of text for each bucket.
BUCKET = 16 << 20
#: Kinds of ranked strings: LENGTH bytes from an anchor, an anchor to LENGTH past the next, LENGTH - GAP from an anchor, LENGTH from any.
AT_ANCHOR, STRETCH, SHORT, SINGLE = range(4)


def difference_cover(period: int = PERIOD) -> list[int]:
    """Residues whose differences give every number modulo period: chosen greedily, each for the most new differences."""
    cover, have = [0], {0}
    while len(have) < period:
        gain = lambda r: len({d % period for c in cover for d in (r - c, c - r)} - have)
        best = max(range(1, period), key=lambda r: (gain(r), -r))
        have |= {d % period for c in cover for d in (best - c, c - best)}
        cover.append(best)
    return sorted(cover)


#: A perfect cover for 133: each difference occurs once. Fixed values; checked when loaded.
SINGER_133 = (1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110)
COVER = sorted(SINGER_133) if len({(a - b) % PERIOD for a in SINGER_133 for b in SINGER_133}) == PERIOD else difference_cover()
_letters = np.random.default_rng(7).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class Hashes:
    """Fingerprints of any substring of a text: differences of prefix sums, mixed."""

    def __init__(self, raw: bytes):
        global _powers, _inverse
        n = len(raw)
        if n >= len(_powers):
            size = max(n + 1, 1 << 17)
            for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, np.uint64(base), np.uint64)
                steps[0] = 1
                globals()[name] = np.cumprod(steps)
        self.n = n
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters[np.frombuffer(raw, np.uint8)] * _powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
        x = (self.sums[stop] - self.sums[start]) * _inverse[start] + np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
        return x ^ (x >> np.uint64(32))


def sample_positions(n: int, period: int = PERIOD, length: int = LENGTH) -> np.ndarray:
    """Sampled positions of a text of n bytes from which its first length - period + 1 bytes can be ranked."""
    last = n - (length - period + 1)
    if n < length:
        return np.zeros(0, np.int64)
    at = (np.arange(0, last + period, period)[:, None] + np.array(COVER)[None, :]).ravel()
    return at[at <= last]


def possible(n: int, matched: np.ndarray) -> np.ndarray:
    """For each start of LENGTH bytes, whether one of its samples has a rank that occurs twice."""
    m = n - LENGTH + 1
    edge = np.zeros(m + 1, np.int32)
    np.add.at(edge, np.minimum(np.maximum(matched - PERIOD + 1, 0), m), 1)
    np.add.at(edge, np.minimum(matched + 1, m), -1)
    return np.cumsum(edge[:-1]) > 0


def anchors(h: Hashes) -> np.ndarray:
    at = np.arange(max(0, h.n - ANCHOR + 1))
    return at[h.of(at, at + ANCHOR, 11) % np.uint64(EVERY) == 0]


def ties(key: int, raw: bytes, matched: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind, position and rank of the strings from anchors that have to be compared; with SHORT ones also the rank of the
    stretch that ends at the anchor, a number of its own where there is none."""
    h = Hashes(raw)
    ok = possible(h.n, matched)
    m, a = len(ok), anchors(h)
    full = a[a < m]
    full = full[ok[full]]
    x, y = a[:-1], a[1:]
    whole = _alone(key, a)
    fits = y + LENGTH <= h.n
    whole[1:][fits] = h.of(x[fits], y[fits] + LENGTH, 101 + STRETCH)
    both = y < m
    both[both] &= ok[x[both]] & ok[y[both]]
    x, y = x[both], y[both]
    upto = np.concatenate([[0], np.cumsum(ok)])
    near = (a + LENGTH - GAP <= h.n) & (upto[np.minimum(a + 1, m)] > upto[np.minimum(np.maximum(a - GAP + 1, 0), m)])
    short = a[near]
    parts = [(AT_ANCHOR, full, full + LENGTH), (STRETCH, x, y + LENGTH), (SHORT, short, short + LENGTH - GAP)]
    return (
        np.concatenate([np.full(len(s), k) for k, s, _ in parts]), np.concatenate([s for _, s, _ in parts]),
        np.concatenate([h.of(s, e, 101 + k) for k, s, e in parts]), np.concatenate([np.zeros(len(full) + len(x), np.uint64), whole[near]]),
    )


def _alone(key: int, at: np.ndarray) -> np.ndarray:
    """Numbers that stand for one place only."""
    x = (at.astype(np.uint64) + np.uint64(1)) * _M2 ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    return (x ^ (x >> np.uint64(31))) * _M1


def settle(raw: bytes, matched: np.ndarray, tied_: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """From the tied strings at anchors: runs of starts that repeat at another place by their ranks, starts to compare singly,
    and the ranks of those.

    Compared are stretches before an anchor whose SHORT string ends different stretches elsewhere, one place of each certain
    stretch among them, as it may be what another text's start repeats."""
    h = Hashes(raw)
    ok = possible(h.n, matched)
    m, a = len(ok), anchors(h)
    kinds, at = tied_["kind"], _at(tied_)
    held = (kinds == AT_ANCHOR) | (kinds == STRETCH)
    stop = at[held] + 1
    whole = kinds[held] == STRETCH
    stop[whole] = np.minimum(a[np.searchsorted(a, at[held][whole], side="right")], m) if whole.any() else stop[whole]
    sure = claims(at[held], stop - at[held], tied_["other"][held], tied_["shift"][held].astype(np.int64))
    inner = ok.copy()
    inner[a[a < m]] = False
    p = np.flatnonzero(inner)
    after = np.searchsorted(a, p)
    near = after < len(a)
    gap = np.full(len(p), GAP + 1)
    gap[near] = a[after[near]] - p[near]
    tied = np.zeros(h.n + 1, bool)
    tied[at[kinds == SHORT]] = True
    alive = gap >= GAP
    alive[~alive] = tied[a[after[~alive]]]
    p = p[alive]
    return sure, p, h.of(p, p + LENGTH, 101 + SINGLE)


def claims(start: np.ndarray, size: np.ndarray, other: np.ndarray, shift: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of starts with where they should stand again (a text, and how far on): those that go on where another ends, at
    both places, are joined."""
    order = np.lexsort((start, shift, other))
    start, stop, other, shift = start[order], (start + size)[order], other[order], shift[order]
    if not len(order):
        return {"start": start, "size": stop, "other": other, "shift": shift}
    new = np.concatenate([[True], (other[1:] != other[:-1]) | (shift[1:] != shift[:-1])])
    part = np.cumsum(new) << 34  # runs of one part only are compared
    reach = np.maximum.accumulate(stop + part)
    new[1:] |= (start + part)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return {"start": start[first], "size": np.maximum.reduceat(stop, first) - start[first], "other": other[first], "shift": shift[first]}


def covered(starts: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of bytes in strings whose starts are rows (first, past the last)."""
    out: list[list[int]] = []
    for a, b in starts[np.lexsort((starts[:, 1], starts[:, 0]))].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + LENGTH - 1)
        else:
            out.append([a, b + LENGTH - 1])
    return [(a, b) for a, b in out]


def key_of(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _refs(keys: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    return {"key": keys, "low": at & 0xFFFF, "high": at >> 16}


def _at(x: dict[str, np.ndarray]) -> np.ndarray:
    return x["low"].astype(np.int64) | x["high"].astype(np.int64) << 16


def _frame(rows: list[tuple[int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"bucket": np.array([b for b, _ in rows], np.int32), "payload": [p for _, p in rows]})


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["bucket", "payload"])


def repeated(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Entries whose rank (and kind) stands at two places or more, each place once, with another of these places."""
    kind = x.get("kind", np.zeros(len(x["rank"]), np.uint8))
    order = np.lexsort((x["high"], x["low"], x["key"], kind, x["rank"]))
    x, kind = {k: v[order] for k, v in x.items()}, kind[order]
    if not len(order):
        return x
    new = np.concatenate([[True], (x["rank"][1:] != x["rank"][:-1]) | (kind[1:] != kind[:-1])])
    first = new | np.concatenate([[True], (x["key"][1:] != x["key"][:-1]) | (x["low"][1:] != x["low"][:-1]) | (x["high"][1:] != x["high"][:-1])])
    x, new = {k: v[first] for k, v in x.items()}, new[first]
    which = np.cumsum(new) - 1
    keep = np.bincount(which)[which] > 1
    start = np.flatnonzero(new)
    other = np.where(new, np.minimum(start[which] + 1, len(new) - 1), start[which])
    x |= {"other": x["key"][other], "shift": _at(x)[other] - _at(x)}
    if "whole" in x:  # SHORT strings that all end one stretch are settled by that; else each stretch sends one of its places
        one = np.minimum.reduceat(x["whole"], start) == np.maximum.reduceat(x["whole"], start)
        by_whole = np.lexsort((np.arange(len(which)), x["whole"], which))
        lead = np.zeros(len(which), bool)
        lead[by_whole[np.concatenate([[True], (np.diff(which[by_whole]) != 0) | (np.diff(x["whole"][by_whole].astype(np.int64)) != 0)])]] = True
        keep &= (x["kind"] != SHORT) | (~one[which] & lead)
    return {k: v[keep] for k, v in x.items()}


def _own(columns):
    """The fields of an entry beside its key."""
    return tuple(c for c in columns if c[0] != "key")


def _by_key(rows: DataFrame, columns, buckets: int, name: str) -> DataFrame:
    """rows (bucket by key, payload) as one row for each key: key, and its entries' payload without the key."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unpack(columns, pdf["payload"].tolist())
        number = np.unique(x["key"], return_inverse=True)[1]
        got = deal(_own(columns), number, {k: v for k, v in x.items() if k != "key"})
        return pd.DataFrame({"key": np.unique(x["key"]), name: [p for _, p in got]})

    return rows.groupBy("bucket").applyInPandas(gather, f"key long, {name} binary")


def _ranked(rows: DataFrame, columns, out, buckets: int) -> DataFrame:
    """One suffix bucket at a time: entries of ranks that repeat, dealt by key and ordered by place."""

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        x = repeated(unpack(columns, pdf["payload"].tolist()))
        x["start"] = _at(x)
        x["size"] = np.ones(len(x["start"]), np.int64)
        order = np.lexsort((x["start"], x["key"]))
        return _frame(deal(out, x["key"][order] % buckets, {k: x[k][order] for k, _ in out}))

    return rows.groupBy("bucket").applyInPandas(rank, "bucket int, payload binary")


def _claims_of(x: dict[str, np.ndarray]) -> list[tuple[int, bytes]]:
    """Runs of one text, dealt by the text that they should equal."""
    others = np.unique(x["other"])
    return [(int(others[k]), p) for k, p in deal(_CLAIM, np.searchsorted(others, x["other"]), {n: x[n] for n, _ in _CLAIM})]


def _digest(raw: bytes, at: int, size: int) -> bytes:
    return blake2b(memoryview(raw)[at : at + size], digest_size=16).digest()


def proven(proposed: DataFrame, held: DataFrame) -> DataFrame:
    """key, sure, failed: runs of starts whose bytes equal those of the place that they name, and the others. proposed: key
    and starts (runs); held: key and packed (the text)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, own in zip(batch.column("key").to_pylist(), batch.column("starts").to_pylist()):
                runs = claims(*(v.astype(np.int64) for v in unpack(_own(_RUN), [own]).values()))
                for o, p in _claims_of(runs):
                    rows += [(o, k, o, True, p), (k, k, o, False, p)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["key", "asks", "other", "there", "claims"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 2 << 20):
            out, last = [], (None, b"")
            for k, p, there, own in zip(*(batch.column(c).to_pylist() for c in ("key", "packed", "there", "claims"))):
                if last[0] != k:
                    last = (k, zstandard.decompress(p))
                x = {n: v.astype(np.int64) for n, v in unpack(_CLAIM, [own]).items()}
                at = x["start"] + x["shift"] if there else x["start"]
                out.append(b"".join(_digest(last[1], s, n + LENGTH - 1) for s, n in zip(at.tolist(), x["size"].tolist())))
            own = [None if there else c for there, c in zip(batch.column("there").to_pylist(), batch.column("claims").to_pylist())]
            yield with_columns(batch.drop_columns(["key", "packed"]), {"claims": pa.array(own, pa.binary()), "digests": pa.array(out, pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, own, one, two in zip(*(batch.column(c).to_pylist() for c in ("asks", "claims", "one", "two"))):
                x = unpack(_CLAIM, [own])
                ok = (np.frombuffer(one, "V16") == np.frombuffer(two, "V16")) if len(one) else np.zeros(0, bool)
                rows.append((k, *(pack(_CLAIM, **{n: v[w] for n, v in x.items()}) for w in (ok, ~ok))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["key", "sure", "failed"])

    asked = proposed.mapInArrow(ask, "key long, asks long, other long, there boolean, claims binary")
    told = asked.join(held.select("key", "packed"), "key").select("key", "asks", "other", "there", "claims", "packed")
    told = told.mapInArrow(digests, "asks long, other long, there boolean, claims binary, digests binary")
    both = told.groupBy("asks", "other").agg(F.max("claims").alias("claims"), F.max(F.when(F.col("there"), F.col("digests"))).alias("one"), F.max(F.when(~F.col("there"), F.col("digests"))).alias("two"))
    return both.mapInArrow(compare, "key long, sure binary, failed binary")


def by_bytes(found: DataFrame, held: DataFrame) -> DataFrame:
    """key, sure: of the runs that failed in found, the starts whose LENGTH bytes another proposed start has."""

    def strings(column: str, with_bytes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "packed", 1 << 20):
                for k, p, own in zip(*(batch.column(c).to_pylist() for c in ("key", "packed", column))):
                    raw, x = zstandard.decompress(p), unpack(_CLAIM, own)
                    for s, n in zip(x["start"].tolist(), x["size"].tolist()):
                        for lo in range(s, s + n, 4_096):
                            at = np.arange(lo, min(s + n, lo + 4_096))
                            cols = [pa.array(Hashes(raw).of(at, at + LENGTH, 1).view(np.int64))]
                            cols += [pa.array(np.full(len(at), k)), pa.array(at), pa.array([raw[i : i + LENGTH] for i in at], pa.binary())] if with_bytes else []
                            yield pa.RecordBatch.from_arrays(cols, names=["rank", "key", "start", "string"][: len(cols)])

        return run

    whole = found.groupBy("key").agg(F.array_union(F.collect_list("sure"), F.collect_list("failed")).alias("all"), F.collect_list("failed").alias("failed")).join(held.select("key", "packed"), "key")
    wanted = whole.select("key", "packed", "failed").mapInArrow(strings("failed", False), "rank long").distinct()
    places = cut(whole.select("key", "packed", "all").mapInArrow(strings("all", True), "rank long, key long, start long, string binary").join(wanted, "rank", "left_semi").dropDuplicates(["key", "start"]))
    twice = places.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    lists = places.join(twice, "string", "left_semi").groupBy("key").agg(F.collect_list("start").alias("starts"))

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.array(x, np.int64) for x in batch.column("starts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([pack(_CLAIM, start=x, size=np.ones(len(x)), shift=np.zeros(len(x))) for x in at], pa.binary())], names=["key", "sure"])

    return lists.mapInArrow(to_runs, "key long, sure binary")


def repeats(docs: DataFrame, text: str = "text", bits: int = 64) -> DataFrame:
    """key, spans: of each text with repeats, the runs of bytes to remove (start, stop). bits: of the ranks that propose; with
    few of them more is proposed and refuted, and the result is the same."""
    known = cut(keys_of(docs, text).groupBy("key").agg(F.max("size").alias("size"), F.count("*").alias("copies"), F.min("_order").alias("_order")))
    total = known.agg(F.sum("size")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)
    mask = np.uint64((1 << bits) - 1)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 8 << 20):
            had, ranks, keys, places = set(), [], [], []
            for x in batch.column(text).to_pylist():
                raw = _bytes(x)
                key = key_of(raw)
                if len(raw) < LENGTH or key in had:
                    continue
                had.add(key)
                at = sample_positions(len(raw))
                ranks.append(Hashes(raw).of(at, at + LENGTH - PERIOD + 1))
                keys.append(np.full(len(at), key))
                places.append(at)
            if had:
                r = np.concatenate(ranks)
                yield _batch(deal(_SAMPLE, ((r >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), {"rank": r & np.uint64(0xFFFFFFFF)} | _refs(np.concatenate(keys), np.concatenate(places))))

    matched = cut(_by_key(_ranked(docs.select(text).mapInArrow(sample, "bucket int, payload binary"), _SAMPLE, _REF, buckets), _REF, buckets, "matched"))
    packed = packed_texts(docs, text, sketch(matched))
    held = cut(packed.join(known.select("key", F.col("_order").alias("_first")).join(matched, "key"), "key").where("_order = _first").select("key", "packed", "matched"))  # rows that repeat in all columns stay: they propose the same

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 2 << 20):
            got = [(k, *ties(k, zstandard.decompress(p), _at(unpack(_own(_REF), [m])))) for k, p, m in zip(*(batch.column(c).to_pylist() for c in ("key", "packed", "matched")))]
            r = np.concatenate([x[3] for x in got]) & mask
            if len(r):
                keys = np.repeat(np.array([x[0] for x in got]), [len(x[1]) for x in got])
                yield _batch(deal(_TIE, (r % np.uint64(buckets)).astype(np.int64), {"rank": r, "whole": np.concatenate([x[4] for x in got]), "kind": np.concatenate([x[1] for x in got])} | _refs(keys, np.concatenate([x[2] for x in got]))))

    tied = cut(_by_key(_ranked(held.mapInArrow(compare, "bucket int, payload binary"), _TIE, _DUP, buckets), _DUP, buckets, "tied"))
    settled = held.join(tied, "key", "left")

    def each(batch: pa.RecordBatch) -> list[tuple]:
        return [
            (k, *settle(zstandard.decompress(p), _at(unpack(_own(_REF), [m])), unpack(_own(_DUP), [t] if t else [])))
            for k, p, m, t in zip(*(batch.column(c).to_pylist() for c in ("key", "packed", "matched", "tied")))
        ]

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 2 << 20):
            got = [(k, c) for k, c, _, _ in each(batch)]
            own = {"key": np.repeat(np.array([k for k, _ in got]), [len(c["start"]) for _, c in got])} | {n: np.concatenate([c[n] for _, c in got]) for n in ("start", "size", "other", "shift")}
            if len(own["key"]):
                yield _batch(deal(_RUN, own["key"] % buckets, own))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 2 << 20):
            got = each(batch)
            r = np.concatenate([x[3] for x in got]) & mask
            if len(r):
                keys = np.repeat(np.array([x[0] for x in got]), [len(x[2]) for x in got])
                yield _batch(deal(_SINGLE, (r % np.uint64(buckets)).astype(np.int64), {"rank": r} | _refs(keys, np.concatenate([x[2] for x in got]))))

    both = settled.mapInArrow(certain, "bucket int, payload binary").unionByName(_ranked(settled.mapInArrow(single, "bucket int, payload binary"), _SINGLE, _RUN, buckets))
    proposed = cut(_by_key(both, _RUN, buckets, "starts"))
    found = cut(proven(proposed, held))
    sure = found.select("key", "sure")
    if not found.where("length(failed) > 0").isEmpty():
        sure = sure.unionByName(by_bytes(found, held))

    def to_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column("sure").to_pylist():
                x = unpack(_CLAIM, p)
                rows.append([{"start": a, "stop": b} for a, b in covered(np.stack([x["start"], x["start"] + x["size"]], axis=1).astype(np.int64))])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["key", "spans"])

    spans = sure.groupBy("key").agg(F.collect_list("sure").alias("sure")).mapInArrow(to_spans, "key long, spans array<struct<start:int,stop:int>>").where("size(spans) > 0")
    whole = known.where(f"copies > 1 and size >= {LENGTH}").select("key", F.array(F.struct(F.lit(0).alias("start"), F.col("size").cast("int").alias("stop"))).alias("spans"))
    return spans.join(whole.select("key"), "key", "left_anti").unionByName(whole)


def _order(docs: DataFrame, text: str):
    """A hash of the row's other columns, by which one of equal texts is chosen."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return F.xxhash64(*others) if others else F.lit(0).cast("long")


def keys_of(docs: DataFrame, text: str) -> DataFrame:
    """key, size and _order of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 4 << 20):
            raw = [_bytes(x) for x in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(x) for x in raw], pa.int64()), pa.array([len(x) for x in raw], pa.int64()), batch.column("_order")], names=["key", "size", "_order"])

    return docs.select(F.col(f"`{text}`").alias("t"), _order(docs, text).alias("_order")).mapInArrow(run, "key long, size long, _order long")


def packed_texts(docs: DataFrame, text: str, only: np.ndarray) -> DataFrame:
    """docs whose key passes the sketch, the text as key, size and packed (compressed), with _order."""
    sent = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, text, 4 << 20):
            raw = [_bytes(x) for x in batch.column(text).to_pylist()]
            keys = np.array([key_of(x) for x in raw], np.int64)
            kept = np.flatnonzero(in_sketch(sent.value, keys))
            raw = [raw[i] for i in kept]
            yield with_columns(batch.drop_columns([text]).take(pa.array(kept)), {"key": pa.array(keys[kept]), "size": pa.array([len(x) for x in raw], pa.int64()), "packed": pa.array([press.compress(x) for x in raw], pa.binary())})

    return docs.withColumn("_order", _order(docs, text)).mapInArrow(run, schema_with(docs.drop(text).withColumn("_order", F.lit(0).cast("long")), "key long, size long, packed binary"))


def dedup(docs: DataFrame, text: str = "text", bits: int = 64) -> DataFrame:
    """docs without the text, with n_bytes, removed (runs of bytes: start, stop), n_removed, and kept (what is left, binary)."""
    kept = [c for c in docs.columns if c != text]
    taken = {"n_bytes", "removed", "n_removed", "kept"}
    names = dict(zip(kept, (f"_c{i}" for i in count())))
    base = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{text}`").alias("_text"))
    found = cut(repeats(base, "_text", bits))
    touched = sketch(found)
    sent = docs.sparkSession.sparkContext.broadcast(touched)
    joined = packed_texts(base, "_text", touched).join(found, "key", "left").drop("key", "_order")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    added = "n_bytes long, removed array<struct<start:int,stop:int>>, n_removed long, kept binary"

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 2 << 20):
            spans, left, gone = [], [], []
            for p, own in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
                raw, at, parts = zstandard.decompress(p), 0, []
                for s in own or ():
                    parts.append(raw[at : s["start"]])
                    at = s["stop"]
                parts.append(raw[at:])
                spans.append(own or [])
                left.append(b"".join(parts))
                gone.append(len(raw) - len(left[-1]))
            yield with_columns(batch.drop_columns(["packed", "spans", "size"]), {"n_bytes": batch.column("size"), "removed": pa.array(spans, kind), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(left, pa.binary())})

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 4 << 20):
            raw = [_bytes(x) for x in batch.column("_text").to_pylist()]
            rest = np.flatnonzero(~in_sketch(sent.value, np.array([key_of(x) for x in raw], np.int64)))
            raw = [raw[i] for i in rest]
            yield with_columns(batch.drop_columns(["_text"]).take(pa.array(rest)), {"n_bytes": pa.array([len(x) for x in raw], pa.int64()), "removed": pa.array([[] for _ in raw], kind), "n_removed": pa.array([0] * len(raw), pa.int64()), "kept": pa.array(raw, pa.binary())})

    out = joined.mapInArrow(cut_out, schema_with(joined.drop("packed", "spans", "size"), added)).unionByName(base.mapInArrow(pass_on, schema_with(base.drop("_text"), added)))
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in taken], "n_bytes", "removed", "n_removed", "kept")
