"""Alignment of tokenizers, Yinyang clustering and shards of ids against the libraries and brute force, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plexum.llm import align, token_ids, vocab, yinyang
from plexum.llm.registry import queries

SF = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LETTERS = "ab AB   's'tll \n\t\x1c\x85\xa0éß漢🙂01٣!?\x00aaa▁　́Σσς İ﻿<|endoftext|> ﬁ\x0b\x0c\r½²"
ODD = [(1, None, "x"), (2, "", "x"), (None, "a null id", "x"), (None, "another one", None), (3, "repeated row here", "x"), (3, "repeated row here", "x"), (4, "x " * 20_000, "x"), (5, "y" * 30_000, "x"), (6, "a▁b", "x"), (7, "<|endoftext|> <s> </s>", "x"), (8, "  two  spaces  ", "x"), (9, " \n", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, `N_A` string")


@pytest.fixture(scope="module")
def samples(spark):
    random.seed(3)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    return texts + [t for _, t, _ in ODD] + ["".join(random.choice(LETTERS) for _ in range(random.randint(0, 40))) for _ in range(3000)]


def library(path, plain):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = plain
    return t


@pytest.mark.parametrize("most", [10**6, 50])
def test_pieces_like_libraries(samples, most):
    word, byte, piece = vocab.WordBPE(WORD), vocab.ByteBPE(BYTE), vocab.PieceBPE(PIECE)
    word.most = piece.most = most
    own = [x or "" for x in samples]
    expected = [
        [e.ids for e in library(WORD, False).encode_batch(own, add_special_tokens=False)],
        [e.ids for e in library(BYTE, True).encode_batch([" " + x if x else "" for x in own], add_special_tokens=False)],
        sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(own),
    ]
    for codec, want in zip((word, byte, piece), expected):
        for k in range(0, len(samples), 700):
            ids, at = codec.encode(pa.array(samples[k : k + 700], pa.string()))
            assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == want[k : k + 700]
        assert codec.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_words_apart_from_signs():
    """A word is encoded once, whatever signs stand behind it and whichever of its ASCII letters are capitals."""
    codec = vocab.WordBPE(WORD)
    seen, real = [], codec.encode_all
    codec.encode_all = lambda pieces: seen.extend(pieces) or real(pieces)
    texts = ["Word word, WORD!? word", "word. (word) word's Word,", None, "été Été été;"]
    want = [e.ids for e in library(WORD, False).encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for _ in range(2):
        ids, at = codec.encode(pa.array(texts))
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == want
    assert len(seen) == len(set(seen)) and set(seen) <= {"word", "(word)", "word's", "été", "Été", "", ",", "!?", ".", ";"}
    letters = [chr(c) for c in range(0x21, 0x260)]
    odd = ["".join(p) for a in letters for p in ((a,), (a, ","), ("x", a), ("X", a, "'"), (a, "\u0301"), (a, "!\u0338"), (a, "<|endoftext|>"), (a, "'s"))]
    ids, at = codec.encode(pa.array(odd))
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [e.ids for e in library(WORD, False).encode_batch(odd, add_special_tokens=False)]


def brute_align(docs):
    """The rows of op11 by loops."""
    a, b = library(BYTE, True), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    bytes_a, bytes_b = vocab.ByteBPE(BYTE).bytes, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    found, counts = [], Counter()
    for name, text in docs:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        joined = (" " + (text or "")).encode()
        if b"".join(bytes_a[i] for i in ids_a) != joined or b"".join(bytes_b[i] for i in ids_b) != joined:
            ids_a, ids_b = [], []
        ends_a, ends_b = np.cumsum([len(bytes_a[i]) for i in ids_a]).tolist(), np.cumsum([len(bytes_b[i]) for i in ids_b]).tolist()
        both, groups = set(ends_a) & set(ends_b), defaultdict(lambda: ([], []))
        for side, (ids, ends) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
            g = 0
            for i, e in zip(ids, ends):
                groups[g][side].append(i)
                g += e in both
        own = Counter((x, y) for p, q in groups.values() for x in p for y in q)
        counts.update(own.keys())
        found.append((name, len(ids_a), len(ids_b), groups, own))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for name, n_a, n_b, groups, own in found:
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups.values())
        yield name, n_a, n_b, len(groups), sum(own.values()), sum(n for k, n in own.items() if counts[k] == best[k[0]]), sum(n * counts[k] for k, n in own.items()), said


STATS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("block,pairs", [(align.BLOCK_BYTES, align.PAIRS), (3_000, 7)])
def test_align_like_brute_force(spark, odd, monkeypatch, block, pairs):
    monkeypatch.setattr(align, "BLOCK_BYTES", block)
    monkeypatch.setattr(align, "PAIRS", pairs)
    docs = odd.select("doc_id", "text", "N_A").unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("doc_id", "text", "'' as N_A"))
    got = [tuple(r) for r in align.count_links(docs, BYTE, PIECE).select(*STATS).collect()]
    assert sorted(got, key=repr) == sorted(brute_align([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    assert align.count_links(docs.limit(0), BYTE, PIECE).count() == 0


def test_op11_digests(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in brute_align(rows)]
    assert sorted(map(tuple, queries()["op11_align"](spark, SF).collect())) == sorted(want)


def lloyd(x, c, rounds):
    for i in range(rounds + 1):
        own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        yield own, c
        c = np.stack([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])


def test_bounds_hold_and_filter():
    """Assignments are Lloyd's, bounds hold in every round, and most distances are not computed where clusters stand apart."""
    rng = np.random.default_rng(0)
    for trial in range(150):
        n, dim, scale = int(rng.integers(1, 200)), int(rng.integers(1, 5)), int(rng.choice([1, 3, 50, 10**7]))
        k = int(rng.integers(1, min(n, 45) + 1))
        x = rng.integers(-scale, scale + 1, (n, dim))
        start = x[rng.permutation(n)[:k]]
        group = yinyang.groups(start)
        own, upper, lower, before = np.full(n, -1), np.zeros(n), np.zeros((n, group.max() + 1)), start
        for want, c in lloyd(x, start, 6):
            moved = np.sqrt(yinyang.squared(c, before).astype(float)) * (1 + 1e-12)
            own, upper, lower, _ = yinyang.assign(x, yinyang.Step(c, moved, group), own, upper, lower)
            d, before = np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2)), c
            assert (own == want).all() and (upper >= d[np.arange(n), own]).all()
            for g in range(group.max() + 1):
                others = np.where((group == g)[None] & (np.arange(k)[None] != own[:, None]), d, np.inf).min(axis=1)
                assert (lower[:, g] <= others).all()
    centres = rng.integers(-10**6, 10**6, (30, 8))
    x = np.repeat(centres, 50, axis=0) + rng.integers(-9, 10, (1500, 8))
    start = x[::50]
    group = yinyang.groups(start)
    own, upper, lower, computed = yinyang.assign(x, yinyang.Step(start, np.zeros(30), group), np.full(1500, -1), np.zeros(1500), np.zeros((1500, group.max() + 1)))
    assert computed == 1500 * 30
    assert yinyang.assign(x, yinyang.Step(start, np.zeros(30), group), own, upper, lower)[3] == 0


def test_cluster_frames(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=3)], i) for i in range(200)]
    odd = [(200, None, 0), (201, [1.0, 2.0], 0), (202, [1.0, None, 2.0], 0), (203, [1.0, float("nan"), 2.0], 0), (204, [float("inf"), 0.0, 2.0], 0), (None, [0.5, 0.5, 0.5], 0), (3, rows[3][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, CLUSTER int").repartition(3)
    out, centroids = yinyang.fit(df, 12, 4, 3, seed="s", scale=100)
    kept = rows + odd[-2:]
    x = np.floor(np.array([np.array(v, np.float32).astype(float) * 100 for _, v, _ in kept])).astype(int)
    order = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (hashlib.sha256(f"s{kept[k][0]}".encode()).hexdigest(), x[k].tolist()))
    *_, (own, c) = lloyd(x, x[order[:12]], 4)
    want = sorted(((r[0], int(o), int(((v - c[o]) ** 2).sum())) for r, o, v in zip(kept, own, x)), key=repr)
    assert sorted(map(tuple, out.select("vec_id", "cluster", "distance").collect()), key=repr) == want and (centroids == c).all()
    few, centroids = yinyang.fit(df.where("vec_id < 3"), 12, 4, 3)
    assert few.count() == 3 and len(centroids) == 3
    assert yinyang.fit(df.limit(0), 12, 4, 3)[0].count() == 0
    with pytest.raises(Exception, match="64 bits"):
        yinyang.fit(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"), 1, 1, 1)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 1001])
def test_pack_round_trip(n):
    values = np.random.default_rng(n).integers(0, 2 ** np.random.default_rng(n).integers(1, 33, n), dtype=np.uint64).astype(np.uint32)
    control, data = token_ids.pack(values)
    assert len(control) == -(-n // 4) and (token_ids.unpack(control, data, n) == values).all()
    assert len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)


def ids_by_library(rows):
    start = 0
    for name, text in rows:
        ids = np.array(library(WORD, False).encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        yield name, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


@pytest.mark.parametrize("range_bytes,shard_ids", [(token_ids.RANGE_BYTES, token_ids.SHARD_IDS), (20_000, 3_000)])
def test_op13_like_library(spark, monkeypatch, range_bytes, shard_ids):
    monkeypatch.setattr(token_ids, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(token_ids, "write", lambda docs, path, real=token_ids.write: real(docs, path, shard_ids=shard_ids))
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, queries()["op13_token_ids"](spark, SF).collect())) == list(ids_by_library(rows))


def test_ids_of_odd_tables(spark, odd, monkeypatch):
    monkeypatch.setattr(token_ids, "RANGE_BYTES", 10_000)
    rows = sorted(token_ids.read(spark, token_ids.write(odd, WORD, shard_ids=100)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [1, 2, 3, 3, 4, 5, 6, 7, 8, 9, None, None]
    assert all(r.start + r.n_tokens == s.start for r, s in zip(rows, rows[1:])) and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    own = Counter(tuple(library(WORD, False).encode(t or "", add_special_tokens=False).ids + [1]) for _, t, _ in ODD)
    assert own == Counter(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert token_ids.read(spark, token_ids.write(odd.limit(0), WORD)).count() == 0
    hot = spark.range(3000).selectExpr("7L as doc_id", "concat('w', id) as text")
    folder = token_ids.write(hot, WORD)
    assert spark.read.parquet(f"{folder}/shards").selectExpr("count(distinct file)").first()[0] > 1  # one name fills no task
