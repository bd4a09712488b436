"""Counts of k-mers, made where the texts lie: what is shuffled are counts, not k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that are counted at once; bounds a task's memory.
PART = 2 << 20


def _counted(texts: list[str], k: int) -> tuple[list[str], np.ndarray]:
    """The k-mers of some texts and how often each occurs; none reaches over an end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(letters) - k + 1
    if n <= 0:
        return [], np.zeros(0, np.int64)
    known, coded = np.unique(letters, return_inverse=True)
    room = np.repeat(np.cumsum(sizes), sizes)[:n] - np.arange(n) >= k  # characters left in the text
    at = np.flatnonzero(room)
    if len(known) ** k < 2**62:
        code = np.zeros(n, np.int64)
        for j in range(k):
            code = code * len(known) + coded[j : j + n]
        first, count = np.unique(code[at], return_index=True, return_counts=True)[1:]
    else:  # too many letters for a number each
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(letters, k)[at])
        first, count = np.unique(windows.view(f"V{4 * k}").ravel(), return_index=True, return_counts=True)[1:]
    grams = letters[at[first][:, None] + np.arange(k)]
    return [g.tobytes().decode("utf-32-le", "surrogatepass") for g in grams], count


def counts(df: DataFrame, text: str, k: int) -> DataFrame:
    """(kmer, n): how often each substring of k characters occurs in a column; null and shorter texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).drop_null()
            ends = np.cumsum(pc.utf8_length(column).to_numpy())
            start = 0
            while start < len(column):
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + PART, "right")))
                grams, count = _counted(column.slice(start, stop - start).to_pylist(), k)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(count.astype(np.int64))], names=["kmer", "n"])
                start = stop

    return df.select(text).mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))
