"""Benchmark decontamination with one Aho-Corasick automaton.

Test items and documents are normalised alike: A-Z in lower case, words are runs of characters other than ASCII
punctuation, space and control characters. Every window of `window` consecutive words of an item (an item of fewer words is
one window) becomes a pattern over word numbers; one automaton finds all of them in one pass over a document's words. Each
hit maps back to the words, and from there to character offsets, of the original text.

The automaton is sent to the executors, so the items' size is checked: over `max_bytes` they are split into blocks of at
most that size. One block is one scan without a shuffle. Several blocks are scanned one after the other; each scan keeps only
the hits, by the text's digest, and all blocks' hits come back to the documents in one join.

Defined cases: null or wordless documents are clean; null or wordless items have no window; repeated rows give repeated
results; two items with one window both count; a null item_id marks words but names no item; clashing columns are replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import cut, schema_with, slices, with_columns

WINDOW = 10
#: Bytes of item texts in one automaton. Its states take about 500 bytes for each word of the items.
MAX_BYTES = 8 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: In UTF-8, A-Z become a-z and all other bytes that no word holds become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}
RUNS = "array<struct<start:int,stop:int>>"


def words(text: str | None) -> list[bytes]:
    """The normalised words, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Windows of a block of items, over numbers of the words that occur in them; any other word has number 0."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                found[tuple(ids[i : i + window])] |= set() if item is None else {item}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, owners in found.items():
            self.machine.add_word(key, (len(key), sorted(owners)))
        self.machine.make_automaton()
        self.empty = not found

    def hits(self, text_words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """First word, word past the last, and items of every occurrence of a window."""
        if self.empty or not text_words:
            return []
        get = self.vocabulary.get
        return [(end - size + 1, end + 1, owners) for end, (size, owners) in self.machine.iter(tuple([get(w, 0) for w in text_words]))]


def blocks(items: DataFrame, max_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of at most max_bytes of text (one item at least), one block at a time on the driver."""
    block, held = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), "text").where("text is not null").distinct().orderBy("i", "text").toLocalIterator():
        size = len(r.text.encode())
        if block and held + size > max_bytes:
            yield block
            block, held = [], 0
        block.append((r.i, r.text))
        held += size
    yield block


def join_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as disjoint runs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: The last automaton that this worker has built, by the block that it is of.
_BUILT: dict[tuple, Automaton] = {}


def automaton_of(sent, window: int) -> Automaton:
    """The automaton of a block that was sent, built once in a worker."""
    key = (sent._path if hasattr(sent, "_path") else id(sent), len(sent.value), window, hash(tuple(sent.value[:1] + sent.value[-1:])))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(sent.value, window)
    return _BUILT[key]


def char_spans(text: str | None, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as character offsets into the original text."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer((text or "").translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def _spans(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "stop": b} for a, b in r] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))


def _scan(sent, text: str, window: int, hits_only: bool):
    """What a scan for one block adds to rows: n_words, runs, items, spans; or, of rows with hits, their text's digest, runs, items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(sent, window)
        for batch in slices(batches, text, 4 << 20):
            texts = batch.column(text).to_pylist()
            own = [words(x) for x in texts]
            hits = [automaton.hits(w) for w in own]
            runs = [join_runs([(a, b) for a, b, _ in h]) for h in hits]
            owners = pa.array([sorted({i for _, _, o in h for i in o}) for h in hits], pa.list_(pa.string()))
            if hits_only:
                hit = pa.array(np.flatnonzero([bool(r) for r in runs]))
                digests = pa.array([xxhash.xxh3_128_digest(texts[i].encode("utf-8", "surrogatepass")) for i in hit.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, _spans(runs).take(hit), owners.take(hit)], names=["digest", "runs", "items"])
            else:
                yield with_columns(batch, {"n_words": pa.array([len(w) for w in own], pa.int64()), "runs": _spans(runs), "items": owners, "spans": _spans([char_spans(x, r) for x, r in zip(texts, runs)])})

    return run


def find(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs with n_words, runs (of hit words: start, stop), items (those with occurring windows, in string order) and spans
    (the runs as character offsets of the text: start, stop)."""
    send = docs.sparkSession.sparkContext.broadcast
    added = f"n_words long, runs {RUNS}, items array<string>, spans {RUNS}"
    several = blocks(items, max_bytes)
    first = next(several)
    second = next(several, None)
    if second is None:
        return docs.mapInArrow(_scan(send(first), text, window, False), schema_with(docs, added))
    hits = [cut(docs.select(text).mapInArrow(_scan(send(b), text, window, True), f"digest binary, runs {RUNS}, items array<string>").dropDuplicates(["digest"])) for b in chain([first, second], several)]
    found = reduce(DataFrame.unionByName, hits).groupBy("digest").agg(F.flatten(F.collect_list("runs")).alias("_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    keyed = docs.mapInArrow(_with_digest(text), schema_with(docs, "_digest binary"))
    joined = keyed.join(found, keyed["_digest"] == found["digest"], "left").drop("_digest", "digest")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            texts = batch.column(text).to_pylist()
            runs = [join_runs([(r["start"], r["stop"]) for r in x or ()]) for x in batch.column("_runs").to_pylist()]
            owners = pa.array([x or [] for x in batch.column("_items").to_pylist()], pa.list_(pa.string()))
            own = batch.drop_columns(["_runs", "_items"])
            yield with_columns(own, {"n_words": pa.array([len(words(x)) for x in texts], pa.int64()), "runs": _spans(runs), "items": owners, "spans": _spans([char_spans(x, r) for x, r in zip(texts, runs)])})

    return joined.mapInArrow(finish, schema_with(docs, added))


def _with_digest(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            yield with_columns(batch, {"_digest": pa.array([xxhash.xxh3_128_digest((x or "").encode("utf-8", "surrogatepass")) for x in batch.column(text).to_pylist()], pa.binary())})

    return run


def mark(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs with what find() adds, n_hit (words in runs), and contaminated: a window occurs."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return find(docs, items, text, window, max_bytes).withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)
