"""Token ids in binary shards: ranked by frequency, byte-aligned, lengths apart from the bytes.

Documents are encoded and dealt to ranges of their order column, sorted there, and kept. One count of all ids ranks them: the
commonest is 0. A shard holds some documents in order: names and sizes, then control bytes (two bits for each id: how many
bytes its rank takes, less one), then the ranks' bytes. Reading takes a control byte's four lengths from one table, masks four
bytes of each place by length, and ranks back to ids from another table.

A task writes shards under names of its own and reports them; a report counts once its task is committed, so retries and
lost executors leave unlisted files, never doubled or missing rows. `shards` in the folder lists each file with the number of
ids before it, `ranks` the ids by rank.

Defined cases: null text counts as empty; each document ends with `end`, so none is without ids; null names come last; rows that
tie in the order column stand in the order of their ids' digest and may lie in several shards, so no value of it fills a task;
an empty table gives no shard and no rows; what else docs hold is not written. Columns of the same names do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexum.llm.common import bound_batches, cut, shared_dir, slices
from plexum.llm.vocab import WordBPE, opened

#: Bytes of text in one range of the order, and in one call of the tokenizer.
RANGE_BYTES, PART_BYTES = 32 << 20, 8 << 20
#: Ranges at most; larger ones take more shards each.
RANGES = 10_000
#: Ids after which a shard ends with its document.
SHARD_IDS = 4 << 20
#: Documents in one batch of what is read.
ROWS = 1_000
MAGIC = b"ids-by-rank 1\n\0\0"

#: For each control byte the lengths of its four ids; for each length the mask of its bytes.
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned numbers below 2^32."""
    v = ranks.astype("<u4", copy=False)
    size = np.ones(len(v), np.uint8)
    for bits in (8, 16, 24):
        if int(v.max(initial=0)) >> bits:
            size += v >> np.uint32(bits) > 0
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    data = np.empty(int(ends[-1]) if len(v) else 0, np.uint8)
    data[at] = v.astype(np.uint8)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        data[at[more] + k] = (v[more] >> np.uint32(8 * k)).astype(np.uint8)
    return control, data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    ends = np.cumsum(size, dtype=np.int64)
    if (int(ends[-1]) if n else 0) != len(data):
        raise ValueError("control bytes and data bytes do not agree")
    four = np.ndarray((len(data) + 1,), "<u4", data.tobytes() + bytes(4), 0, (1,))  # four bytes from each place on
    return four[ends - size] & MASKS[size]


def shard(names: list[int | None], sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = np.array([len(names), len(ranks), len(control), len(data)], "<u8")
    null = np.array([x is None for x in names], np.uint8)
    return b"".join([MAGIC, head.tobytes(), np.array([x or 0 for x in names], "<i8").tobytes(), null.tobytes(), sizes.astype("<u8").tobytes(), control.tobytes(), data.tobytes()])


def open_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, which of them are null, sizes and ranks of a shard."""
    if raw[:16] != MAGIC:
        raise ValueError("this is no shard of ids")
    docs, n, controls, bytes_ = np.frombuffer(raw, "<u8", 4, 16).astype(np.int64).tolist()
    at = 48 + 8 * docs
    null, sizes = np.frombuffer(raw, np.uint8, docs, at).astype(bool), np.frombuffer(raw, "<u8", docs, at + docs).astype(np.int64)
    at += 9 * docs
    return np.frombuffer(raw, "<i8", docs, 48), null, sizes, unpack(np.frombuffer(raw, np.uint8, controls, at), np.frombuffer(raw, np.uint8, bytes_, at + controls), n)


def _file(path: str):
    """File system and path of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _bounds(docs: DataFrame, order: str, text: str) -> np.ndarray:
    """Values of the order column that part it into RANGES ranges, or fewer of about RANGE_BYTES of text."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = min(int(total // RANGE_BYTES), RANGES)
    if not n:
        return np.zeros(0, np.int64)
    found = docs.agg(F.percentile_approx(F.col(order).cast("long"), [(i + 1) / (n + 1) for i in range(n)], max(10_000, 10 * n))).first()[0]
    return np.array(found or [], np.int64)


def ordered(docs: DataFrame, path: str, order: str = "doc_id", text: str = "text", end: int = 1) -> DataFrame:
    """name and ids (binary) of each document, in partitions that follow each other; kept in the shared folder."""
    bounds = _bounds(docs, order, text)
    kind = _dtype(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = opened(WordBPE, path)
        for batch in slices(batches, "text", PART_BYTES):
            ids, at = codec.encode(batch.column("text"))
            at = at + np.arange(len(at))
            out = np.full(at[-1], end, kind)
            inside = np.ones(len(out), bool)
            inside[at[1:] - 1] = False
            out[inside] = ids
            edges = pa.py_buffer((at * out.itemsize).astype(np.int32))
            found = pa.Array.from_buffers(pa.binary(), len(batch), [None, edges, pa.py_buffer(out.tobytes())])
            name, null = batch.column("name").fill_null(0).to_numpy(), batch.column("name").is_null().to_numpy(zero_copy_only=False)
            # a name that equals several bounds may stand in any range between them; null names come last
            low, high = (np.where(null, len(bounds), np.searchsorted(bounds, name, side)) for side in ("left", "right"))
            yield pa.RecordBatch.from_arrays([batch.column("name"), found, pa.array(low), pa.array(high)], names=["name", "ids", "low", "high"])

    own = docs.select(F.col(order).cast("long").alias("name"), F.col(text).alias("text"))
    bound_batches(docs.sparkSession)
    coded = own.mapInArrow(run, "name long, ids binary, low long, high long").withColumn("tie", F.xxhash64("ids"))
    dealt = coded.select("name", "ids", "tie", (F.col("low") + F.pmod("tie", F.col("high") - F.col("low") + 1)).cast("int").alias("range"))
    return cut(dealt.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions(F.col("name").asc_nulls_last(), "tie").select("name", "ids"))


def _dtype(path: str) -> type:
    return np.uint16 if opened(WordBPE, path).size <= 1 << 16 else np.uint32


def by_frequency(coded: DataFrame, size: int, kind: type) -> np.ndarray:
    """All ids of the vocabulary, the commonest first; ids that occur equally often in their own order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            ids = batch.column("ids")
            first, last = (np.frombuffer(ids.buffers()[1], np.int32)[ids.offset + k] for k in (0, len(ids)))
            seen += np.bincount(np.frombuffer(ids.buffers()[2], np.uint8)[first:last].view(kind), minlength=size) if last > first else 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["id", "n"])

    found = coded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return np.argsort(-counts, kind="stable").astype(np.uint32)


def write(docs: DataFrame, path: str, folder: str | None = None, order: str = "doc_id", text: str = "text", end: int = 1, shard_ids: int = SHARD_IDS) -> str:
    """Write all documents' ids; the folder that holds shards, their list and the ranks."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    kind, size = _dtype(path), opened(WordBPE, path).size
    if end >= size:
        raise ValueError(f"the end {end} is not in the vocabulary")
    coded = ordered(docs, path, order, text, end)
    by_rank = by_frequency(coded, size, kind)
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = _file(folder)
        part, before = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal before, total
            file = f"part-{part:05d}-{uuid.uuid4().hex}.ids"
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            with fs.open_output_stream(f"{place}/data/{file}") as out:
                out.write(shard(names, sizes, rank[np.concatenate(held)]))
            row = pa.RecordBatch.from_pylist([{"part": part, "file": file, "n_docs": len(names), "n_ids": total, "before": before}], schema)
            before += total
            total = 0
            names.clear()
            held.clear()
            return row

        fs.create_dir(f"{place}/data", recursive=True)
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("ids")):
                names.append(name)
                held.append(np.frombuffer(raw.as_buffer(), kind))
                total += len(held[-1])
                if total >= shard_ids:
                    yield flush()
        if names:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64())])
    coded.mapInArrow(run, "part int, file string, n_docs long, n_ids long, before long").write.parquet(f"{folder}/written")
    written = spark.read.parquet(f"{folder}/written")
    totals = sorted(tuple(r) for r in written.groupBy("part").agg(F.sum("n_ids")).collect())  # a number for each range
    starts = np.cumsum([0, *[n for _, n in totals]]).tolist()
    first = spark.createDataFrame([(p, s) for (p, _), s in zip(totals, starts)], "part int, first long")
    listed = written.join(F.broadcast(first), "part").select("file", "n_docs", "n_ids", (F.col("first") + F.col("before")).alias("start"))
    listed.write.parquet(f"{folder}/shards")
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary: unsigned 32-bit little-endian numbers) of every document of a written folder."""
    ranks = spark.read.parquet(f"{folder}/ranks").toArrow().sort_by("rank")
    by_rank = ranks.column("id").to_numpy().astype("<u4")
    listed = spark.read.parquet(f"{folder}/shards").select("file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = _file(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{place}/data/{row['file']}") as f:
                    names, null, sizes, found = open_shard(f.read())
                at = np.concatenate([[0], np.cumsum(sizes)])
                for k in range(0, len(names), ROWS):
                    own = at[k : k + ROWS + 1]
                    ids = by_rank[found[own[0] : own[-1]]].tobytes()
                    edges = pa.py_buffer(((own - own[0]) * 4).astype(np.int32))
                    columns = [pa.array(names[k : k + ROWS], mask=null[k : k + ROWS]), pa.array(row["start"] + own[:-1]), pa.array(np.diff(own)), pa.Array.from_buffers(pa.binary(), len(own) - 1, [None, edges, pa.py_buffer(ids)])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    shards = max(1, listed.count())
    return listed.repartition(shards).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
