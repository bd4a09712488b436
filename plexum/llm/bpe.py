"""Byte-level BPE encoding with a pair occurrence index, and decoding.

Text is cut into pre-tokens by the tokenizer's pattern. The distinct pre-tokens of a part of a partition are laid out as
one sequence of byte symbols. An index maps each mergeable pair to all of its positions; active ranks are applied in
ascending order, each to all of its positions at once, and the lists of the pairs that a merge creates are extended. A
pair that holds a token always ranks after the merge that makes the token (each token has one merge), so ascending order
merges what the usual loop over the lowest rank merges.

Defined cases: null text counts as empty, which has no tokens; special tokens inside a text become their ids, as the
tokenizers library does; decoding null gives an empty text, unknown ids are skipped and bytes that are no UTF-8 become
U+FFFD; repeated rows give repeated results; clashing columns are replaced.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plexum.llm.common import schema_with, slices, with_columns

#: The split pattern of byte-level BPE, with white space as Unicode has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of text for which one index is built; bounds a worker's memory.
PART_BYTES = 4 << 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = (b for b in range(256) if b not in set(prints))
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(free)}


class Codec:
    """A tokenizer file of the tokenizers library: byte-level BPE without normaliser or prefix space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        vocab, letters = model["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        back = {c: b for b, c in letters.items()}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = self.left.astype(np.int64) * self.size + self.right
        self._order = np.argsort(key, kind="stable")
        self._keys = key[self._order]
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 where it does not merge. A negative symbol merges with nothing."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._order[at], -1)

    def pre_tokens(self, text: str) -> list[str | int]:
        """Pre-tokens in order; a special token is its id."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and where each word's begin, with the end last."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a gap of -1 after each word
        sym = np.full(starts[-1] + 1, -1, np.int32)
        inside = np.ones(starts[-1], bool)
        inside[starts[1:] - 1] = False
        sym[:-1][inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        self._merge(sym, inside)
        alive = np.flatnonzero(sym >= 0)
        return sym[alive], np.searchsorted(alive, starts)

    def _merge(self, sym: np.ndarray, inside: np.ndarray) -> None:
        """Apply all merges in place. A merged pair's token stands at its left position; its right one becomes -2."""
        n = len(sym)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        rank = self.ranks(sym[:-1], sym[1:])
        where = np.flatnonzero(rank >= 0)
        where = where[np.argsort(rank[where], kind="stable")].astype(np.int32)
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        _add(index, rank[where], where)
        del rank
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, new = self.left[r], self.right[r], self.made[r]
            after = nxt[at]
            at = at[(sym[at] == a) & (sym[after] == b)]
            if not len(at):
                continue
            if len(lists) > 1 or a == b:
                at = np.unique(at)
            if a == b:  # of positions in a chain every second one merges, from the left
                chained = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
                number = np.arange(len(at))
                at = at[(number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0]
            gone = nxt[at]
            past = nxt[gone]
            sym[at], sym[gone] = new, -2
            nxt[at], prv[past] = past, at
            before = prv[at]
            for left, right, pos in ((sym[before], sym[at], before), (sym[at], sym[past], at)):
                found = self.ranks(left, right)
                ok = found >= 0
                if ok.any():
                    found, pos = found[ok], pos[ok]
                    order = np.argsort(found, kind="stable")
                    for x in _add(index, found[order], pos[order]):
                        heapq.heappush(heap, x)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and where each text's begin, with the end last."""
        number: dict[str | int, int] = {}
        rows, sizes = [], []
        for x in texts:
            own = [number.setdefault(t, len(number)) for t in self.pre_tokens(x or "")]
            rows.append(np.array(own, np.int32))
            sizes.append(len(own))
        words = list(number)
        ids, at = self.encode_words([w.encode("utf-8", "surrogatepass") if isinstance(w, str) else b"" for w in words])
        own_ids = [i for i, w in enumerate(words) if not isinstance(w, str)]
        if own_ids:  # special tokens take one place each
            parts = [ids[at[i] : at[i + 1]] if isinstance(w, str) else np.array([w], np.int32) for i, w in enumerate(words)]
            ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        size = np.diff(at)[flat]
        ends = np.cumsum(size)
        picked = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[flat] - (ends - size), size)
        return ids[picked].astype(np.int32), np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(sizes)]]) if sizes else np.zeros(1, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        known = self.bytes
        return b"".join([known[i] for i in ids.tolist() if 0 <= i < self.size]).decode("utf-8", "replace")


def _add(index: dict[int, list[np.ndarray]], ranks: np.ndarray, positions: np.ndarray) -> list[int]:
    """Extend the lists of ranks (ascending) by positions; the ranks that had no list before."""
    if not len(ranks):
        return []
    edges = np.concatenate([[0], np.flatnonzero(np.diff(ranks)) + 1, [len(ranks)]])
    new = []
    for i, r in enumerate(ranks[edges[:-1]].tolist()):
        if r not in index:
            new.append(r)
        index[r].append(positions[edges[i] : edges[i + 1]])
    return new


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with token_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches, text, part_bytes):
            ids, at = c.encode(batch.column(text).to_pylist())
            yield with_columns(batch, {"token_ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))})

    return docs.mapInArrow(run, schema_with(docs, "token_ids array<int>"))


def decode(docs: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """docs with decoded: the text of token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = part.column(ids)
                flat, at = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
                null = rows.is_null().to_numpy(zero_copy_only=False)
                out = ["" if null[i] else c.decode(flat[at[i] : at[i + 1]]) for i in range(part.num_rows)]
                yield with_columns(part, {"decoded": pa.array(out, pa.string())})

    return docs.mapInArrow(run, schema_with(docs, "decoded string"))
