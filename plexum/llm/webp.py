"""Lossless WebP: a decoder of the whole format for pixel arrays, and writers.

`decode` reads any lossless file: prefix codes (simple and coded lengths, meta codes by block), back-references with the
short distance map, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms.

`store` keeps bytes as 8-bit samples: green channels of images of SIDE columns, a file for each part of PART bytes, files one
after the other. A part is entropy-coded; where strings repeat, so that back-references make it smaller by a share GAIN, it is
written with them. Only green holds samples, so transforms between channels and the colour cache have nothing to gain there.
`load` reads the files back: those with back-references, and any foreign file, by `decode`; files of literals alone in
lockstep, one symbol of every image at a time, as array operations.

Defined cases: null and empty texts are one row of zeros; texts of any length are whole, in several files; equal texts give
equal media, whatever rows they are in, and repeated rows repeated results; null media give null; a file that is cut off or
no lossless WebP is an error; clashing columns are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plexum.llm.common import schema_with, slices, with_columns

SIDE = 64
PART = SIDE * 256
#: Longest code that store uses; the format allows 15.
LONGEST = 11
#: Back-references are used from so many samples on, and if they make a part smaller by this share.
LEAST, GAIN = 16, 0.25
#: Parts of whose strings of eight samples a smaller share than this stands before are not searched.
SHARE = 0.2

# Fixed values of the format: order in which lengths of the code-length code are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def distance_map() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distance codes: the pixels of up to 7 rows above and 8 to the side, by closeness, of equals
    the less sideways one first, and of mirror images the one to the left."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Reader:
    def __init__(self, data: bytes):
        self.data, self.size, self.at = data, len(data) * 8, 0

    def bits(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("truncated bitstream")
        first = self.at >> 3
        out = (int.from_bytes(self.data[first : first + (n >> 3) + 2], "little") >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return out


class Writer:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def done(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code as it stands in the stream, length)."""
    out, code, last = {}, 0, 0
    for size, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= size - last
        out[s] = (int(f"{code:0{size}b}"[::-1], 2), size)
        code, last = code + 1, size
    return out


class Code:
    """A prefix code for reading. A code of one symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [n for n in lengths if n]
        self.only = None
        if len(used) < 2:
            self.only = next((s for s, n in enumerate(lengths) if n), 0)
            return
        self.width = max(used)
        if sum(1 << self.width - n for n in used) != 1 << self.width:
            raise ValueError("incomplete prefix code")
        self.table = [(0, 0)] * (1 << self.width)  # by the next bits
        for s, (c, n) in canonical(lengths).items():
            self.table[c :: 1 << n] = [(s, n)] * (1 << self.width - n)

    def read(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        first = r.at >> 3
        s, n = self.table[int.from_bytes(r.data[first : first + 3], "little") >> (r.at & 7) & (1 << self.width) - 1]
        r.at += n
        if r.at > r.size:
            raise ValueError("truncated bitstream")
        return s


def read_lengths(r: Reader, alphabet: int) -> list[int]:
    out = [0] * alphabet
    if r.bits(1):  # simple: one or two symbols
        two = r.bits(1)
        first = r.bits(8 if r.bits(1) else 1)
        out[first] = 1
        if two:
            out[r.bits(8)] = 1
        return out
    of_lengths = [0] * 19
    for i in range(4 + r.bits(4)):
        of_lengths[CODE_LENGTH_ORDER[i]] = r.bits(3)
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    code, at, last = Code(of_lengths), 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            out[at] = s
            at += 1
            last = s or last
        else:
            n = 3 + r.bits(2) if s == 16 else 3 + r.bits(3) if s == 17 else 11 + r.bits(7)
            if at + n > alphabet:
                raise ValueError("run past the alphabet")
            out[at : at + n] = [last if s == 16 else 0] * n
            at += n
    return out


def _prefixed(s: int, r: Reader) -> int:
    """The length or distance that a prefix symbol and its extra bits give."""
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + r.bits(extra) + 1


def _pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, as ARGB numbers."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("bad colour cache")
    meta, block, groups = None, 0, 1
    if main and r.bits(1):
        block = r.bits(3) + 2
        across = -(-width >> block)
        meta = (_pixels(r, across, -(-height >> block), False) >> 8 & 0xFFFF).reshape(-1, across)
        groups = int(meta.max()) + 1
    alphabets = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[Code(read_lengths(r, n)) for n in alphabets] for _ in range(groups)]
    out, at, total = [0] * (width * height), 0, width * height
    cache = [0] * (1 << cache_bits if cache_bits else 0)
    short = distance_map()

    def keep(p: int) -> None:
        if cache_bits:
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    while at < total:
        own = codes[int(meta[(at // width) >> block, (at % width) >> block]) if meta is not None else 0]
        s = own[0].read(r)
        if s < 256:
            red, blue, alpha = (own[k].read(r) for k in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            keep(out[at])
            at += 1
        elif s < 280:
            size = _prefixed(s - 256, r)
            distance = _prefixed(own[4].read(r), r)
            if distance > 120:
                distance -= 120
            else:
                dx, dy = short[distance - 1]
                distance = max(1, dx + dy * width)
            if distance > at or at + size > total:
                raise ValueError("bad back-reference")
            for _ in range(size):
                out[at] = out[at - distance]
                keep(out[at])
                at += 1
        else:
            out[at] = cache[s - 280]
            keep(out[at])
            at += 1
    return np.array(out, np.uint32)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(c) -> int:
    a, r, g, b = c
    return a << 24 | r << 16 | g << 8 | b


def _mean(p: int, q: int) -> int:
    return _join([(x + y) >> 1 for x, y in zip(_channels(p), _channels(q))])


def predict(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    """The predictor of one pixel from its neighbours."""
    clip = lambda v: min(255, max(0, v))
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return _mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _mean(_mean(left, top_left), _mean(top, top_right))
    l, t, tl = _channels(left), _channels(top), _channels(top_left)
    if mode == 11:
        to_left = sum(abs(y - z) for y, z in zip(t, tl))
        to_top = sum(abs(x - z) for x, z in zip(l, tl))
        return left if to_left < to_top else top
    if mode == 12:
        return _join([clip(x + y - z) for x, y, z in zip(l, t, tl)])
    half = _channels(_mean(left, top))
    return _join([clip(m + int((m - z) / 2)) for m, z in zip(half, tl)])


def each_prediction(width: int, height: int, modes: np.ndarray, block: int, done: list[int]) -> Iterator[tuple[int, int]]:
    """Place and predictor of every pixel in order; done holds the pixels before it."""
    across = -(-width >> block)
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not y:
                p = done[i - 1] if x else 0xFF000000
            elif not x:
                p = done[i - width]
            else:
                p = predict(int(modes[(y >> block) * across + (x >> block)] >> 8) & 15, done[i - 1], done[i - width], done[i - width + 1], done[i - width - 1])
            yield i, p


def _add_channels(p: int, q: int) -> int:
    return ((p & 0xFF00FF00) + (q & 0xFF00FF00) & 0xFF00FF00) | ((p & 0x00FF00FF) + (q & 0x00FF00FF) & 0x00FF00FF)


def cross_colour(pixels: np.ndarray, width: int, elements: np.ndarray, block: int, sign: int) -> np.ndarray:
    """Add (sign 1, inverse) or take away (sign -1) what green tells of red, and green and red of blue."""
    i = np.arange(len(pixels))
    e = elements[(i // width >> block) * -(-width >> block) + (i % width >> block)]
    signed = lambda v: (v & 255).astype(np.uint8).astype(np.int8).astype(np.int64)
    red, green, blue = pixels >> 16, pixels >> 8, pixels
    delta = lambda t, c: signed(t) * signed(c) >> 5
    new_red = red.astype(np.int64) + sign * delta(e, green)
    true_red = new_red.astype(np.uint32) if sign > 0 else red
    new_blue = blue.astype(np.int64) + sign * (delta(e >> 8, green) + delta(e >> 16, true_red))
    return (pixels & 0xFF00FF00) | ((new_red & 255) << 16).astype(np.uint32) | (new_blue & 255).astype(np.uint32)


def chunk(data: bytes) -> tuple[bytes, int]:
    """The lossless chunk of the file at the start of data, and the file's size."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    end = 8 + struct.unpack("<I", data[4:8])[0]
    at = 12
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if kind == b"VP8L":
            return data[at + 8 : at + 8 + size], end
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def decode(data: bytes) -> np.ndarray:
    """A lossless file's pixels: height x width x (alpha, red, green, blue)."""
    r = Reader(chunk(data)[0])
    if r.bits(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    todo, seen, now = [], set(), width
    while r.bits(1):
        kind = r.bits(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (0, 1):
            block = r.bits(3) + 2
            todo.append((kind, now, block, _pixels(r, -(-now >> block), -(-height >> block), False)))
        elif kind == 2:
            todo.append((kind, now, 0, None))
        else:
            n = r.bits(8) + 1
            steps = _pixels(r, n, 1, False)
            palette = np.stack([np.cumsum(steps >> k & 255) & 255 for k in (24, 16, 8, 0)]).astype(np.uint32)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, now, pack, palette[0] << 24 | palette[1] << 16 | palette[2] << 8 | palette[3]))
            now = -(-now >> pack)
    pixels = _pixels(r, now, height, True)
    for kind, w, block, data_ in reversed(todo):
        if kind == 0:
            done: list[int] = []
            rest = pixels.tolist()
            for i, p in each_prediction(w, height, data_, block, done):
                done.append(_add_channels(rest[i], p))
            pixels = np.array(done, np.uint32)
        elif kind == 1:
            pixels = cross_colour(pixels, w, data_, block, 1)
        elif kind == 2:
            green = pixels >> 8 & 255
            pixels = (pixels & 0xFF00FF00) | ((pixels >> 16) + green & 255) << 16 | (pixels + green & 255)
        else:
            index = (pixels >> 8 & 255).reshape(height, -1)
            per, bits = 1 << block, 8 >> block
            index = np.stack([index >> k * bits & (1 << bits) - 1 for k in range(per)], axis=2).reshape(height, -1)[:, :w] if block else index
            pixels = np.where(index < len(data_), np.append(data_, 0)[np.minimum(index, len(data_))], 0).astype(np.uint32).ravel()
    return np.stack([pixels >> k & 255 for k in (24, 16, 8, 0)], axis=1).astype(np.uint8).reshape(height, width, 4)


def riff(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + padded


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> list[int]:
    """Huffman lengths of at most `longest`; rare symbols count for more until the code is short enough."""
    used = np.flatnonzero(counts).tolist()
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
        return out
    own, least = counts[used].tolist(), 1
    while True:
        heap = [(max(c, least), i) for i, c in enumerate(own)]
        heapq.heapify(heap)
        up, n = [0] * (2 * len(own)), len(own)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i] = up[j] = n
            heapq.heappush(heap, (a + b, n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[: len(own)]) <= longest:
            for s, d in zip(used, depth):
                out[s] = d
            return out
        least *= 2


#: store's own code for code lengths: 0 to 11 and the two runs of zeros, two of them in 3 bits and twelve in 4.
_OF_LENGTHS = [0] * 19
for _s in (*range(12), 17, 18):
    _OF_LENGTHS[_s] = 3 if _s in (0, 18) else 4
_OF_LENGTHS_CODE = canonical(_OF_LENGTHS)


def write_lengths(w: Writer, lengths: list[int]) -> None:
    """Lengths of a prefix code of two symbols or more, none over 11."""
    w.bits(0, 1)
    order = [_OF_LENGTHS[s] for s in CODE_LENGTH_ORDER]
    n = max(i + 1 for i, x in enumerate(order) if x)
    w.bits(n - 4, 4)
    for x in order[:n]:
        w.bits(x, 3)
    w.bits(0, 1)
    at = 0
    while at < len(lengths):
        run = 0
        while at + run < len(lengths) and not lengths[at + run] and run < 138:
            run += 1
        if run >= 11:
            w.bits(*_OF_LENGTHS_CODE[18])
            w.bits(run - 11, 7)
        elif run >= 3:
            w.bits(*_OF_LENGTHS_CODE[17])
            w.bits(run - 3, 3)
        else:
            run = 1
            w.bits(*_OF_LENGTHS_CODE[lengths[at]])
        at += run


def write_single(w: Writer, symbol: int) -> None:
    """A prefix code of one symbol."""
    w.bits(1, 1)
    w.bits(0, 1)
    w.bits(1, 1)
    w.bits(symbol, 8)


def _header(height: int, green: list[int], distance: list[int]) -> Writer:
    w = Writer()
    for value, n in ((0x2F, 8), (SIDE - 1, 14), (height - 1, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        w.bits(value, n)  # no transform, no colour cache, no meta codes
    _write_code(w, green)
    for symbol in (0, 0, 255):  # red, blue, alpha
        write_single(w, symbol)
    _write_code(w, distance)
    return w


def _write_code(w: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2 and sum(used) < 256:
        write_single(w, used[0] if used else 0)
    else:
        write_lengths(w, lengths)


def prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances from 1 on as prefix symbol, extra bits and their number."""
    v = value.astype(np.int64) - 1
    top = np.frexp(np.maximum(v, 1).astype(float))[1] - 1  # place of the highest bit
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1)), np.where(v < 4, 0, v & (1 << extra) - 1), extra


def references(part: np.ndarray) -> np.ndarray:
    """Rows (start, size, distance) of strings of LEAST samples or more that stand before in the part, from the front on, each
    as long as it goes on; found at the last place of the same eight samples."""
    n = len(part) - 7
    if n < LEAST:
        return np.zeros((0, 3), np.int64)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, 8)).view("<u8").ravel()
    some = np.sort(eight[eight * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(61) == 0])  # an eighth, chosen by what they hold
    if np.count_nonzero(some[1:] == some[:-1]) < SHARE * len(some):
        return np.zeros((0, 3), np.int64)
    order = np.argsort(eight, kind="stable")
    same = np.flatnonzero(eight[order[1:]] == eight[order[:-1]])
    if not len(same):
        return np.zeros((0, 3), np.int64)
    distance = np.zeros(n, np.int64)
    distance[order[same + 1]] = order[same + 1] - order[same]
    edge = np.flatnonzero(np.diff(distance, prepend=-1) != 0)
    stop = np.append(edge[1:], n)[np.searchsorted(edge, np.arange(n), side="right") - 1]
    size = np.where(distance > 0, np.minimum(stop - np.arange(n) + 7, 4096), 0)
    good = np.flatnonzero(size >= LEAST)
    out, at, k = [], 0, 0
    while (k := int(np.searchsorted(good, at))) < len(good):
        start = int(good[k])
        out.append((start, int(size[start]), int(distance[start])))
        at = start + int(size[start])
    return np.array(out, np.int64).reshape(-1, 3)


def _tokens(part: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a part: its literals and references in order as green symbols; and at each reference, the length's extra bits and
    their number, distance symbol, extra bits and their number."""
    if not len(refs):
        return part.astype(np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros((0, 3), np.int64)
    inside = np.zeros(len(part) + 1, np.int64)
    np.add.at(inside, refs[:, 0], 1)
    np.add.at(inside, refs[:, 0] + refs[:, 1], -1)
    literal = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    ls, le, ln = prefixed(refs[:, 1])
    ds, de, dn = prefixed(refs[:, 2] + 120)
    order = np.argsort(np.concatenate([literal, refs[:, 0]]), kind="stable")
    green = np.concatenate([part[literal].astype(np.int64), 256 + ls])[order]
    at = np.argsort(order, kind="stable")[len(literal) :]
    return green, at, np.stack([le, ln], axis=1), np.stack([ds, de, dn], axis=1)


def _bits(head: Writer, value: np.ndarray, size: np.ndarray) -> bytes:
    """A writer's bits and then values of so many bits each, 14 at the most."""
    at = head.size + np.cumsum(size) - size
    shifted, first = value << (at & 7), at >> 3
    total = int(at[-1] + size[-1] + 7) // 8
    body = sum(np.bincount(first + k, shifted >> 8 * k & 255, total + 3) for k in range(3))[:total].astype(np.uint8)
    own = np.frombuffer(head.done(), np.uint8)
    body[: len(own)] |= own
    return body.tobytes()


def _table(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    value, size = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    codes = canonical(lengths)
    if len(codes) > 1:  # one symbol alone takes no bits
        for s, (c, n) in codes.items():
            value[s], size[s] = c, n
    return value, size


def _file(part: np.ndarray, refs: np.ndarray) -> bytes:
    green, at, length, distance = _tokens(part, refs)
    g = code_lengths(np.bincount(green, minlength=280))
    d = code_lengths(np.bincount(distance[:, 0], minlength=40)) if len(refs) else [0] * 40
    head = _header(len(part) // SIDE, g, d)
    (gv, gs), (dv, ds) = _table(g), _table(d)
    if not len(refs):
        value, size = gv[green], gs[green]
    else:  # four values for each reference, one for each literal
        slots = np.ones(len(green), np.int64)
        slots[at] = 4
        first = np.cumsum(slots) - slots
        value, size = np.zeros(slots.sum(), np.int64), np.zeros(slots.sum(), np.int64)
        value[first], size[first] = gv[green], gs[green]
        for k, (v, n) in enumerate(((length[:, 0], length[:, 1]), (dv[distance[:, 0]], ds[distance[:, 0]]), (distance[:, 1], distance[:, 2])), 1):
            value[first[at] + k], size[first[at] + k] = v, n
    return riff(_bits(head, value, size) if size.any() else head.done())


def store(payload: bytes) -> bytes:
    """Files that hold a payload, a positive multiple of SIDE bytes, one for each PART of it."""
    out = []
    for start in range(0, len(payload), PART):
        part = np.frombuffer(payload[start : start + PART], np.uint8)
        plain, refs = _file(part, np.zeros((0, 3), np.int64)), references(part)
        # a reference takes about four bytes
        if len(refs) and refs[:, 1].sum() * len(plain) / len(part) - 4 * len(refs) > GAIN * len(plain):
            short = _file(part, refs)
            plain = short if len(short) < (1 - GAIN) * len(plain) else plain
        out.append(plain)
    return b"".join(out)


def files(media: bytes) -> list[bytes]:
    """The single files of a row of files."""
    out, at = [], 0
    while at < len(media):
        size = chunk(media[at:])[1] if media[at : at + 4] == b"RIFF" else len(media)
        out.append(media[at : at + size])
        at += size
    return out


def _plain_header(stream: bytes) -> tuple[int, list[int], int] | None:
    """Height, green's code lengths and where the symbols begin, if the stream is of store's shape."""
    r = Reader(stream)
    if r.bits(8) != 0x2F or r.bits(14) != SIDE - 1:
        return None
    height = r.bits(14) + 1
    if r.bits(1) or r.bits(3) or r.bits(3):
        return None
    lengths = read_lengths(r, 280)
    rest = [read_lengths(r, n) for n in (256, 256, 256, 40)]
    if any(sum(map(bool, x)) != 1 for x in rest) or any(lengths[256:]) or max(lengths) > LONGEST:
        return None
    return height, lengths[:256], r.at


def load(media: list[bytes]) -> list[bytes]:
    """The payloads that store() put into each of media: the green samples of its files, one after the other."""
    out: list[list[bytes | None]] = []
    plain: list[tuple[int, int, bytes, int, list[int], int]] = []
    for i, m in enumerate(media):
        own = files(m)
        out.append([None] * len(own))
        for k, f in enumerate(own):
            stream = chunk(f)[0]
            if head := _plain_header(stream):
                plain.append((i, k, stream, *head))
            else:
                out[i][k] = decode(f)[:, :, 2].tobytes()
    plain.sort(key=lambda x: -x[3])
    for start in range(0, len(plain), 4096):
        group = plain[start : start + 4096]
        for (i, k, *_), samples in zip(group, _lockstep([x[2] for x in group], [x[3] * SIDE for x in group], [x[4] for x in group], [x[5] for x in group])):
            out[i][k] = samples
    return [b"".join(x) for x in out]


def _lockstep(streams: list[bytes], sizes: list[int], lengths: list[list[int]], starts: list[int]) -> list[bytes]:
    """The symbols of all streams, sizes descending: each round reads one symbol of every stream that has some left."""
    n = len(streams)
    data = np.frombuffer(b"".join(streams) + b"\0" * 4, np.uint8)
    wide = data[:-2].astype(np.int32)
    wide |= data[1:-1].astype(np.int32) << 8
    wide |= data[2:].astype(np.int32) << 16
    at = (np.concatenate([[0], np.cumsum([len(s) for s in streams])[:-1]]) * 8 + np.array(starts)).astype(np.int64)
    table = np.zeros((n, 1 << LONGEST), np.int32)  # by the next bits: symbol and, over it, length
    for row, own in enumerate(lengths):
        codes = canonical(own)
        if len(codes) == 1:
            table[row] = next(iter(codes))
            continue
        for s, (c, size) in codes.items():
            table[row, c :: 1 << size] = s | size << 8
    table = table.ravel()
    base = np.arange(n, dtype=np.int64) << LONGEST
    sizes_ = np.array(sizes)
    out = np.zeros((sizes_[0], n), np.uint8)
    edges = np.unique(sizes_)
    done = 0
    for edge in edges:
        live = int((sizes_ >= edge).sum())
        p, b = at[:live].copy(), base[:live]
        for t in range(done, int(edge)):
            entry = table[b + ((wide[p >> 3] >> (p & 7)) & ((1 << LONGEST) - 1))]
            out[t, :live] = entry & 255
            p += entry >> 8
        at[:live] = p
        done = int(edge)
    out = np.ascontiguousarray(out.T)
    return [out[i, :s].tobytes() for i, s in enumerate(sizes)]


def feature(pixels: np.ndarray) -> str:
    """Numbers of a pixel array: rows, mean, deviation, entropy in bits and mean step between neighbours."""
    flat = pixels.ravel()
    p = np.bincount(flat, minlength=256) / max(1, flat.size)
    p = p[p > 0]
    step = np.abs(np.diff(flat.astype(np.int16))).mean() if flat.size > 1 else 0.0
    return f"{flat.size // SIDE};{flat.mean():.6f};{flat.std():.6f};{abs(-(p * np.log2(p)).sum()):.6f};{step:.6f}"


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes and media: the text's UTF-8 (null: none), zeros up to a positive multiple of SIDE, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(text).to_pylist()]
            media = [store(x + b"\0" * (-len(x) % SIDE if x else SIDE)) for x in raw]
            yield with_columns(batch, {"n_bytes": pa.array([len(x) for x in raw], pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.mapInArrow(run, schema_with(docs, "n_bytes long, media binary"))


def from_media(rows: DataFrame, media: str = "media") -> DataFrame:
    """rows with payload (read back from the stored files), its size, digest and the checksum of its last SIDE bytes, and the
    feature of its pixels. Null media give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, media, 4 << 20):
            got = batch.column(media).to_pylist()
            read = iter(load([x for x in got if x is not None]))
            back = [None if x is None else next(read) for x in got]
            each = lambda f, kind: pa.array([None if x is None else f(x) for x in back], kind)
            yield with_columns(batch, {
                "payload": pa.array(back, pa.binary()), "payload_bytes": each(len, pa.int64()), "payload_sha256": each(lambda x: sha256(x).hexdigest(), pa.string()),
                "tail_crc32": each(lambda x: zlib.crc32(x[-SIDE:]), pa.int64()), "feature": each(lambda x: feature(np.frombuffer(x, np.uint8)), pa.string()),
            })

    return rows.mapInArrow(run, schema_with(rows, "payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"))
