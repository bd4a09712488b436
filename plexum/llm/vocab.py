"""Token ids of many texts by the vocabulary files of public tokenizers.

BPE with word ends and sentencepiece see each distinct piece between spaces once: no token of theirs reaches over a space into
a word before it. (For sentencepiece this is checked against the vocabulary, and texts with runs of spaces go to the library
whole.) Byte-level BPE goes through a rank encoder built from the same file, whose result is the same because ids ascend with
merges; texts with very long runs without white space, in which that encoder is quadratic, go through the tokenizers library.

Defined cases: null counts as empty; an empty text has no ids.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plexum.llm.bpe import PATTERN, byte_letters

#: Pieces that one cache holds before it keeps only those of the text at hand; bounds a worker's memory.
PIECES = 500_000
#: Characters without white space from which a text does not go through the rank encoder.
RUN = 1_000
#: Signs that make one word together, behind letters; an apostrophe may go with the letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word of Latin letters and the signs behind it; not of the dotted capital I, whose lower case ends in a mark that is no letter.
WORD_SIGNS = r"^(?P<word>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+)(?P<signs>[!-/:-@\[-`{-~]*)$"
#: Pieces that the library gets as one text.
TOGETHER = 200

Ids = tuple[np.ndarray, np.ndarray]  # ids of all texts in one array; where each text's begin, with the end last


def _flat(lists: list[list[int]]) -> Ids:
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]).astype(np.int64)
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(at[-1])), at


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one span after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Pieces:
    """A tokenizer behind a cache of what stands between spaces. `encode_all` gives the ids of each of some pieces; texts with
    an empty piece go to `whole` where that is given."""

    def __init__(self, encode_all: Callable[[list[str]], Ids], whole: Callable[[list[str]], Ids] | None = None, most: int = PIECES):
        self.encode_all, self.whole, self.most = encode_all, whole, most
        self.known: dict[str, int] = {}
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _forget(self, but: list[str]) -> None:
        kept = [p for p in but if p in self.known]
        at = np.fromiter(map(self.known.__getitem__, kept), np.int64, len(kept))
        size = np.diff(self.at)[at]
        self.ids, self.at = self.ids[spans(self.at[at], size)], np.concatenate([[0], np.cumsum(size)])
        self.known = dict(zip(kept, range(len(kept))))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Where each of some distinct pieces stands in the cache, after the new ones are encoded."""
        if len(self.known) > self.most:
            self._forget(but=pieces)
        found = list(map(self.known.get, pieces))
        at = [i for i, f in enumerate(found) if f is None]
        if at:
            new = [pieces[i] for i in at]
            ids, edges = self.encode_all(new)
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new))))
            self.ids, self.at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + edges[1:]])
            for k, i in enumerate(at):
                found[i] = first + k
        return np.array(found, np.int64)

    def _distinct(self, pieces: pa.Array) -> Ids:
        """Ids of each of some distinct pieces."""
        at = self._numbers(pieces.to_pylist())
        size = np.diff(self.at)[at]
        return self.ids[spans(self.at[at], size)], np.concatenate([[0], np.cumsum(size)])

    def encode(self, texts: pa.Array) -> Ids:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(texts, " ")
        start = lists.offsets.to_numpy()
        coded = lists.values.slice(start[0], start[-1] - start[0]).dictionary_encode()
        start = start - start[0]
        number = coded.indices.to_numpy()
        pieces = coded.dictionary
        if not self.whole:
            ids, at = self._distinct(pieces)
            size = np.diff(at)[number]
            edges = np.concatenate([[0], np.cumsum(size)])[start]
            return ids[spans(at[number], size)], edges
        row = np.repeat(np.arange(len(texts)), np.diff(start))
        odd = pc.match_substring(texts, "▁").to_numpy(zero_copy_only=False).copy()
        odd[row[number == pc.index(pieces, pa.scalar("", pa.large_string())).as_py()]] = True
        number, row = number[~odd[row]], row[~odd[row]]
        used = np.unique(number)
        place = np.zeros(len(pieces), np.int64)
        place[used] = self._numbers(pieces.take(pa.array(used)).to_pylist())
        at = place[number]
        size = np.diff(self.at)[at]
        ids = self.ids[spans(self.at[at], size)]
        sizes = np.bincount(row, weights=size, minlength=len(texts)).astype(np.int64)
        if not odd.any():
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        other, other_at = self.whole(texts.filter(pa.array(odd)).to_pylist())
        own = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        sizes[odd] = np.diff(other_at)
        own[odd] = len(ids) + other_at[:-1]
        return np.concatenate([ids, other])[spans(own, sizes)], np.concatenate([[0], np.cumsum(sizes)])


def _library(path: str, plain: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    t.encode_special_tokens = plain
    return t


class WordBPE(Pieces):
    """BPE with word ends; strings of special tokens inside a text become these, as the library does. White space is dropped."""

    def __init__(self, path: str):
        super().__init__(self._encode)
        self.library = _library(path, plain=False)
        added = [t for t in self.library.get_added_tokens_decoder().items() if t[1].special]
        self.mark, self.mark_text = (added[-1][0], added[-1][1].content) if added else (None, None)
        self.size = self.library.get_vocab_size()
        own = [e.ids for e in self.library.encode_batch_fast(["aé", "!?", "Aé!?"], add_special_tokens=False)]
        self.apart = own[0] + own[1] == own[2]
        suffix = self.library.model.end_of_word_suffix
        self.ends = np.array([bool(suffix) and (self.library.id_to_token(i) or "").endswith(suffix) for i in range(self.size)])

    def encode(self, texts: pa.Array) -> Ids:
        return super().encode(pc.replace_substring(texts, "\n", " "))

    def _distinct(self, pieces: pa.Array) -> Ids:
        """The cache holds words and signs apart, and ASCII letters in lower case alone: most new pieces are known words with
        other signs behind them or a capital before. Other pieces are taken whole."""
        if not self.apart:
            return super()._distinct(pieces)
        parts = pc.extract_regex(pieces, WORD_SIGNS)
        whole = pc.is_null(parts)
        word = pc.if_else(whole, pieces, pc.ascii_lower(parts.field("word")))
        signs = pc.if_else(whole, pa.scalar("", pa.large_string()), parts.field("signs"))
        both = pa.concat_arrays([word, signs]).dictionary_encode()
        ids, at = super()._distinct(both.dictionary)
        number = both.indices.to_numpy().reshape(2, -1).T.ravel()  # a word, its signs, the next word
        size = np.diff(at)[number]
        return ids[spans(at[number], size)], np.concatenate([[0], np.cumsum(size)])[::2]

    def _encode(self, pieces: list[str]) -> Ids:
        """Many pieces in one call, since a call costs more than a piece. Pieces of letters are one word each, and two with
        signs behind them; so their ids end where words do. Between others stands a special token, which costs more."""
        kinds = [1 if p.isalpha() else 2 if p[-1:] in SIGNS and p.rstrip(SIGNS).isalpha() else 0 for p in pieces]
        found, order = [], []
        for kind in (1, 2, 0):
            own = [i for i, k in enumerate(kinds) if k == kind]
            order += own
            found += [self._together([pieces[j] for j in own[i : i + TOGETHER]], kind) for i in range(0, len(own), TOGETHER)]
        if not found:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        ids, sizes = map(np.concatenate, zip(*found))
        back = np.argsort(order)
        at = np.cumsum(sizes) - sizes
        return ids[spans(at[back], sizes[back])], np.concatenate([[0], np.cumsum(sizes[back])])

    def _together(self, pieces: list[str], words: int) -> Ids:
        """Ids and how many each piece has; words: in each, or 0 where this is not known. What does not add up is encoded alone."""
        if words or self.mark is not None:
            ids = np.array(self.library.encode_batch_fast([(" " if words else self.mark_text).join(pieces)], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(self.ends[ids] if words else ids == self.mark)
            if words and len(cuts) == words * len(pieces):
                return ids, np.diff(np.concatenate([[-1], cuts[words - 1 :: words]]))
            if not words and len(cuts) == len(pieces) - 1:
                return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        flat, at = _flat([e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)])
        return flat, np.diff(at)


class ByteBPE:
    """Byte-level BPE of a space and the text; strings of special tokens inside a text are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: bytes([b]) for b, c in byte_letters().items()}
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        vocab = {i: b"".join(back[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in pairs]
        self.bytes = [vocab.get(i) or special.get(i, b"") for i in range(max([*vocab, *special]) + 1)]
        self.library = _library(path, plain=True)
        self.ranks = None
        if made == sorted(made) and len(set(made)) == len(made):
            self.ranks = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={t: i for i, t in vocab.items()}, special_tokens={})
        self.long = re.compile(rf"\S{{{RUN}}}")

    def encode(self, texts: pa.Array) -> Ids:
        own = [" " + x if x else "" for x in texts.to_pylist()]
        far = [i for i, x in enumerate(own) if self.ranks is None or self.long.search(x)]
        skip = set(far)
        out = [[] if i in skip else self.ranks.encode_ordinary(x) for i, x in enumerate(own)]
        for i, e in zip(far, self.library.encode_batch_fast([own[i] for i in far], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return _flat(out)


class PieceBPE(Pieces):
    """Sentencepiece BPE of the text, before which the library puts a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        whole = lambda own: _flat(self.model.encode(own, num_threads=1) if own else [])
        super().__init__(whole, whole)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.local = not any("▁" in p.lstrip("▁") for p in names)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: pa.Array) -> Ids:
        return super().encode(texts) if self.local else self.whole([x or "" for x in texts.to_pylist()])


_open: dict[tuple[type, str], WordBPE | ByteBPE | PieceBPE] = {}


def opened(kind: type, path: str):
    """The tokenizer of a file, opened once in a worker."""
    if (kind, path) not in _open:
        _open[kind, path] = kind(path)
    return _open[kind, path]
