"""A corpus pipeline of five stages over `documents`.

Each stage takes what its predecessor kept and, but for the last, returns the columns of documents. A stage's rows are written
to the shared folder and read again; once a stage is written, what its predecessor wrote is deleted, so that one copy of the
corpus is left, which the caller reads last.

Defined cases: null texts count as empty everywhere and are kept. The join stage tells rows apart by doc_id and text: null and
repeated doc_ids are judged by their texts, of rows that tie in both one stays, and of linked rows the one of least doc_id,
null ids last. Rows without words and a null doc_id all stay. Columns of documents keep their names, types and values, also where an
operator adds a column of that name: operators see all but doc_id, text and n_chars under other names. Only the last stage's own
token_ids and n_tokens replace columns of these names. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexum.llm import bpe, decontaminate, ngram_join, suffix_dedup, toxicity
from plexum.llm.common import cut, read, shared_dir
from plexum.llm.registry import tokenizer_path


#: Columns that stages read or write; all others are passed on.
OWN = ("doc_id", "text", "n_chars")


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stage keeps of docs, in docs' own columns: the stage sees others under names that no operator uses."""
    names = docs.columns
    apart = [c if c in OWN else f"passed_{i}_on" for i, c in enumerate(names)]
    return stage(docs.toDF(*apart)).select(apart).toDF(*names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity the ordinal model rejects go."""
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return _apart(docs, lambda own: toxicity.score(own, model).where(~F.col("toxic")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one of least doc_id stays, null ids last; of rows that repeat a doc_id and a text, one.
    Texts without words link with nothing; those with a null doc_id all stay."""
    return _apart(docs, _one_of_each_group)


def _one_of_each_group(docs: DataFrame) -> DataFrame:
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))
    apart = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"\S")
    judged = docs.where(~apart).withColumn("_key", key)
    found = ngram_join.join(judged.select("_key", "text"), "_key")
    kept = cut(found.where("_key = component_id").groupBy("_key").agg(F.count("*").alias("n")))
    out = judged.join(kept.select("_key"), "_key", "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates(["_key"])
    return out.select(docs.columns).unionByName(docs.where(apart)).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of long repeated strings go from the texts; what is left of a split character goes too."""
    return _apart(docs, lambda own: _as_text(suffix_dedup.dedup(own)))


def _as_text(found: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            kept = [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]
            columns = {f.name: c for f, c in zip(batch.schema, batch.columns) if f.name in names}
            columns |= {"text": pa.array(kept, pa.string()), "n_chars": pa.array([len(x) for x in kept], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in order], names=order)

    names = [c for c in found.columns if c not in ("n_bytes", "removed", "n_removed", "kept", "text", "n_chars")]
    order = [*names, "text", "n_chars"]
    fields = {f.name: f for f in found.schema}
    schema = ", ".join([f"`{n}` {fields[n].dataType.simpleString()}" for n in names] + ["text string", "n_chars long"])
    return found.mapInArrow(run, schema)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return _apart(docs, lambda own: decontaminate.mark(own, read(spark, sf_dir, "benchmark")).where(~F.col("contaminated")))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids and n_tokens; the ids decode to the text."""
    return bpe.encode(docs, tokenizer_path()).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("bpe", to_tokens),
]

#: A fitted model and suffix comparison are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
