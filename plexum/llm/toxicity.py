"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 to GRADES - 1 are ordered. One weight vector over sparse text features is shared by all thresholds:
P(grade <= k) = logistic(theta_k - eta), eta = w . x. A document's severity is its expected grade.

The labels hold one bit, so the target's upper grades are the model's own: clean documents are grade 0; toxic ones are dealt to
the grades from 1 on in equal parts, by how firmly a model of the bit alone, fitted to the other half of the sample, calls
them toxic. So grade k means that the evidence in the text is among so much of what toxic documents show, as a model that
has not seen the document judges. No list of words enters.

The features are all words and stems of the sample whose share differs between toxic and clean documents by MIN_Z standard
errors; there is no limit on their number, which the sample bounds.

Defined cases: null text counts as empty; an empty text has no words and the severity of the intercepts alone; rows that
repeat get the same score each; labels without a document, or with null doc_id or label, are not learned from; with no
usable label of either kind the model has no features and every document is grade 0. Columns of the input that clash with
the added ones are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import cut, schema_with, slices, with_columns

#: A word is a run of letters, in lower case.
WORD = re.compile(r"[^\W\d_]+")
GRADES = 4
#: Fitting reads at most so many labelled documents: those of least hash, so the choice does not depend on partitions.
MAX_TRAIN = 20_000
#: Words whose share differs less than this between toxic and clean documents, in standard errors, are noise.
MIN_Z = 5.0
#: A word also counts under its first letters, so that a stem's unseen forms are known; "*" marks such a feature.
STEMS = (4, 5)
ADDED = "severity double, grade int, p_toxic double, toxic boolean"


def features(text: str | None) -> tuple[int, Counter]:
    """The number of words, and how often each word and each stem occurs."""
    words = Counter(WORD.findall((text or "").lower()))
    found = Counter(words)
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                found[w[:k] + "*" * (k - STEMS[0] + 1)] += n
    return sum(words.values()), found


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    length_weight: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.array([30.0 + k for k in range(GRADES - 1)]))

    cut: float = 0.5

    def eta(self, text: str | None) -> float:
        """The linear predictor of one text: like the sum over features(text), without building those that have no weight."""
        words, get = Counter(WORD.findall((text or "").lower())), self.words.get
        total = 0.0
        for w, n in words.items():
            for at in (get(w), *(get(w[:k] + "*" * (k - STEMS[0] + 1)) for k in STEMS if len(w) > k)):
                if at is not None:
                    total += n * self.weights[at]
        return float(total) + self.length_weight * float(np.log1p(sum(words.values())))

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -60, 60)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, tf: np.ndarray, length: np.ndarray, grades: np.ndarray, n_features: int, steps: int = 400, l2: float = 1e-5, top: int = GRADES) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, weight of the length and thresholds by full-batch Adam on the mean log likelihood of the grades."""
    n, k = len(grades), top - 1
    w, lw, first, gaps = np.zeros(n_features), 0.0, 2.0, np.zeros(k - 1)
    m = v = np.zeros(n_features + 1 + k)
    for step in range(1, steps + 1):
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        eta = np.bincount(rows, weights=w[cols] * tf, minlength=n) + lw * length
        edge = 1 / (1 + np.exp(-np.clip(np.concatenate([[-60.0], theta, [60.0]])[None, :] - eta[:, None], -60, 60)))
        slope = edge * (1 - edge)
        at = np.arange(n)
        p = np.maximum(edge[at, grades + 1] - edge[at, grades], 1e-12)
        hi, lo = slope[at, grades + 1] / p, slope[at, grades] / p
        d_eta = (hi - lo) / n
        d_theta = np.array([(lo[grades == j + 1].sum() - hi[grades == j].sum()) / n for j in range(k)])
        grown = np.exp(gaps)
        grad = np.concatenate([np.bincount(cols, weights=d_eta[rows] * tf, minlength=n_features) + l2 * w, [(d_eta * length).sum()], [d_theta.sum()], [d_theta[j + 1 :].sum() * grown[j] for j in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, lw, first, gaps = w - move[:n_features], lw - move[n_features], first - move[n_features + 1], gaps - move[n_features + 2 :]
    return w, lw, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """doc_id, toxic and text of the sampled labelled documents; the sample's ids are few enough to be sent to every task."""
    sample = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")


def word_counts(train: DataFrame) -> DataFrame:
    """A row for each training document: its number of words and how often it holds each of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sizes, found = zip(*map(features, batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(sizes, pa.int64()), pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "n_words", "words", "tfs"],
            )

    train = train.withColumns({"doc_id": F.col("doc_id").cast("long"), "toxic": F.col("toxic").cast("int")}).select("doc_id", "toxic", "text")
    return train.mapInArrow(count, "doc_id long, toxic int, n_words long, words array<string>, tfs array<long>")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learn from at most max_train labelled documents. Only what the sample bounds reaches the driver: the chosen words, and
    for each sampled document its length and its counts of chosen words, in the order of doc_id."""
    counts = cut(word_counts(training_rows(docs, labels, max_train)))
    n = {r.toxic: r.n for r in counts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Model()
    by_word = (
        counts.select("toxic", F.explode("words").alias("word")).groupBy("word")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .withColumn("p", (F.col("a") + F.col("b")) / (pos + neg))
        .withColumn("z", F.expr(f"abs(a / {pos} - b / {neg}) / sqrt(p * (1 - p) * {1 / pos + 1 / neg} + 1e-12)"))
    )
    chosen = by_word.where(f"a + b >= 5 and z >= {MIN_Z}").orderBy(F.col("z").desc(), "word").select("word").collect()
    words = {r.word: i for i, r in enumerate(chosen)}
    if not words:
        return Model()
    rows, cols, tf, length, toxic = [], [], [], [], []
    for i, r in enumerate(_sparse(counts, words).orderBy("doc_id", "n_words", "cols", "counts").toLocalIterator(prefetchPartitions=True)):
        rows += [i] * len(r.cols)
        cols += r.cols
        tf += r.counts
        length.append(np.log1p(r.n_words))
        toxic.append(bool(r.toxic))
    rows, cols, tf, length, toxic = np.array(rows, np.int64), np.array(cols, np.int64), np.array(tf, float), np.array(length), np.array(toxic)
    grades = own_grades(rows, cols, tf, length, toxic, len(words))
    w, lw, theta = fit_ordinal(rows, cols, tf, length, grades, len(words))
    model = Model(words, w, float(lw), theta)
    eta = np.bincount(rows, weights=w[cols] * tf, minlength=len(grades)) + lw * length
    model.cut = best_cut(model.above(eta)[:, 0], toxic)
    return model


def own_grades(rows: np.ndarray, cols: np.ndarray, tf: np.ndarray, length: np.ndarray, toxic: np.ndarray, n_features: int) -> np.ndarray:
    """0 for clean documents, 1 to GRADES - 1 for toxic ones in equal parts, by the margin that a model of the bit fitted to the
    other half gives them; equal margins have one grade, the lower one."""
    half = np.arange(len(toxic)) % 2
    margin = np.zeros(len(toxic))
    for k in (0, 1):
        learn = half != k
        if not (toxic[learn].any() and (~toxic[learn]).any()):
            continue
        number = np.cumsum(learn) - 1
        own = learn[rows]
        w, lw, _ = fit_ordinal(number[rows[own]], cols[own], tf[own], length[learn], toxic[learn].astype(int), n_features, steps=200, top=2)
        eta = np.bincount(rows, weights=w[cols] * tf, minlength=len(toxic)) + lw * length
        margin[~learn] = (eta - np.median(eta[learn & toxic]))[~learn]  # the halves' models differ in scale and offset
    grades = np.zeros(len(toxic), np.int64)
    if toxic.any():
        of_toxic = np.sort(margin[toxic])
        grades[toxic] = 1 + np.searchsorted(of_toxic, margin[toxic]) * (GRADES - 1) // len(of_toxic)
    return grades


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The p_toxic from which on calling a document toxic has the best F1 on the training rows."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + toxic.sum())
    f1[:-1][np.diff(p[order]) == 0] = -1  # no cut inside a tie
    i = int(f1.argmax())
    return float((p[order][i] + p[order][min(i + 1, len(p) - 1)]) / 2)


def _sparse(counts: DataFrame, words: dict[str, int]) -> DataFrame:
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [[(words[w], t) for w, t in zip(ws, ts) if w in words] for ws, ts in zip(batch.column("words").to_pylist(), batch.column("tfs").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), batch.column("n_words"), pa.array([[c for c, _ in p] for p in pairs], pa.list_(pa.int32())), pa.array([[t for _, t in p] for p in pairs], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "n_words", "cols", "counts"],
            )

    return counts.select("doc_id", "toxic", "n_words", "words", "tfs").mapInArrow(look_up, "doc_id long, toxic int, n_words long, cols array<int>, counts array<long>")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with severity (expected grade), p_toxic (P(grade > 0)), toxic (p_toxic at or over the model's cut), and grade: 0, or
    for toxic documents the likeliest one above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            above = model.above(np.array([model.eta(x) for x in batch.column(text).to_pylist()]))
            each = -np.diff(np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))]), axis=1)
            yield with_columns(batch, {"severity": pa.array(above.sum(1)), "grade": pa.array(np.where(above[:, 0] >= model.cut, 1 + each[:, 1:].argmax(1), 0).astype(np.int32)), "p_toxic": pa.array(above[:, 0]), "toxic": pa.array(above[:, 0] >= model.cut)})

    return docs.mapInArrow(run, schema_with(docs, ADDED))
