"""Quality by a generalised additive model with pairwise interactions.

Cyclic boosting fits the residuals of one feature after the other by shallow trees over the feature's bins; the trees of a
feature add up to its lookup table. Then the pairs that explain most of what is left get tables over two coarse bins. A
document's score is the logistic of the sum of its bins' entries.

Defined cases: null text counts as empty; empty texts fall into the lowest bins and get a score too; repeated rows get the
same score; labels without a document or with null quality are not learned from; without labels of both kinds the score is
the share of label 1 (0.5 if there is none); clashing columns are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import schema_with, slices, with_columns

#: Fitting reads at most so many labelled documents, those of least hash.
MAX_TRAIN = 20_000
#: A score from which on a document is called good.
KEEP = 0.3
BINS, COARSE, PAIRS = 32, 8, 12
ROUNDS, PAIR_ROUNDS, RATE = 150, 80, 0.15
FEATURES = ("log_words", "word_length", "distinct_words", "top_word", "repeats", "upper", "digits", "symbols", "marks", "non_ascii", "bars", "caps_words", "ragged_words", "bare_words", "log_lines", "line_words", "same_lines", "ended_lines", "distinct_pairs", "entropy")
#: Classes of bytes: 1 upper, 2 lower, 3 digit, 4 white space, 5 sentence marks, 6 the bar, 7 other symbols, 8 not ASCII.
_CLASS = np.array([8 if b >= 128 else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b in b" \t\n\r\v\f" else 5 if b in b".,;:?!'\"()-" else 6 if b == 124 else 7 for b in range(256)], np.uint8)


def features(text: str | None) -> list[float]:
    """The numbers that the model reads from a whole text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=hist, minlength=9)
    n = max(1, len(raw))
    words = raw.split()
    m = max(1, len(words))
    count = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    p = hist[hist > 0] / n
    return [
        np.log1p(len(words)), (n - kinds[4]) / m, len(count) / m, max(count.values(), default=0) / m, sum(map(bytes.__eq__, words, words[1:])) / m,
        kinds[1] / max(1, kinds[1] + kinds[2]), kinds[3] / n, kinds[7] / n, kinds[5] / n, kinds[8] / n, kinds[6] / m,
        sum(map(bytes.isupper, words)) / m, sum([w[-1] in b"%$#&*!@^~|" for w in words]) / m, sum([not w.isalnum() and w.strip(b"!-/:;?@[`{|}~.,#$%&'()*+") == b"" for w in words]) / m,
        np.log1p(len(lines)), len(words) / k, 1 - len(set(lines)) / k if lines else 0.0, sum([x.rstrip()[-1] in b".!?:" for x in lines]) / k,
        len(set(zip(words, words[1:]))) / max(1, m - 1), float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
    ]


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """One score for each row of features."""
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, least: float = 2.0) -> np.ndarray:
    """The values of a shallow tree over ordered bins with gradients g and curvatures h: the best cut again and again."""
    value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            tg, th = g[a:b].sum(), h[a:b].sum()
            gain = cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - value(a, b)
            gain[(ch < least) | (th - ch < least)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (a, a + i + 1, b))
        if best[1] is None:
            break
        a, c, b = best[1]
        parts = [x for x in parts if x != (a, b)] + [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut in each of two features: its gain and its values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    a, b = (x[:-1, :-1] for x in (cg, ch))
    ga = [a, cg[:-1, -1:] - a, cg[-1:, :-1] - a, cg[-1, -1] - cg[:-1, -1:] - cg[-1:, :-1] + a]
    ha = [b, ch[:-1, -1:] - b, ch[-1:, :-1] - b, ch[-1, -1] - ch[:-1, -1:] - ch[-1:, :-1] + b]
    gain = sum(x**2 / (y + 1) for x, y in zip(ga, ha)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [x[i, j] / (y[i, j] + 1) for x, y in zip(ga, ha)]
    out = np.zeros_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit_tables(x: np.ndarray, y: np.ndarray) -> Model:
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    model = Model(base=float(np.log(share / (1 - share))) if len(y) else 0.0)
    if len(np.unique(y)) < 2:
        return Model() if not len(y) else model
    f = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(f)]
    model.coarse = [_edges(x[:, j], COARSE) for j in range(f)]
    at = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(f)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(f):
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n))
            model.tables[j] += step
            total += step[at[j]]
    rough = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in range(f)]
    size = [len(e) + 1 for e in model.coarse]
    cell = lambda i, j: rough[i] * size[j] + rough[j]
    grid = lambda i, j, w: np.bincount(cell(i, j), w, size[i] * size[j]).reshape(size[i], size[j])
    g, h = slopes()
    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in combinations(range(f), 2)), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    model.pair_tables = [np.zeros((size[i], size[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            model.pair_tables[k] += step
            total += step[rough[i], rough[j]]
    return model


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document's label is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `features`, without the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            x = pa.array(list(map(features, batch.column(text).to_pylist())), pa.list_(pa.float64()))
            yield with_columns(batch.drop_columns([text]), {"features": x})

    return docs.mapInArrow(run, schema_with(docs.drop(text), "features array<double>"))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learn from at most max_train labelled documents that are not held out; only their features reach the driver."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    rows = with_features(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).select("quality", "features").toArrow()
    x = np.array(rows.column("features").to_pylist(), float).reshape(rows.num_rows, len(FEATURES))
    return fit_tables(x, np.array(rows.column("quality").to_pylist(), float))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1; higher: label 1 is likelier) and predicted (1 from KEEP on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            s = model.score(np.array(list(map(features, batch.column(text).to_pylist())), float))
            yield with_columns(batch, {"score": pa.array(s), "predicted": pa.array((s >= KEEP).astype(np.int32))})

    return docs.mapInArrow(run, schema_with(docs, "score double, predicted int"))
