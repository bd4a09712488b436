"""Readers: parquet with facts from paths, delimited and structured text formats, code books, tile lists, images."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plexum.functions import sequences as S

GTF = "seqname string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attribute string"
SAM_FIELDS = ("name", "flag", "transcript", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq")
SAM_TAGS = ("AS", "XS", "XN", "XM", "XO", "XG", "NM")


def tables(spark: SparkSession, paths: str | Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Parquet of one or more globs with column `path`; columns that some files lack are null there."""
    df = spark.read.option("mergeSchema", "true").parquet(*([paths] if isinstance(paths, str) else paths)).withColumn("path", F.col("_metadata.file_path"))
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_path_parts(df: DataFrame, parts: dict[str, str], path: str = "path") -> DataFrame:
    """Columns from the first group of a pattern over the path; null where it does not match."""
    return df.withColumns({k: F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for k, p in parts.items()})


def ident_tables(spark: SparkSession, paths: str | Sequence[str], roi: str) -> DataFrame:
    df = with_path_parts(tables(spark, paths), {"z": r"(\d+)\.parquet", "codebook": r"chunks\+([^/]+)"})
    return df.withColumns({"z": F.col("z").cast("int"), "roi": F.lit(roi), "roilabel": F.concat(F.lit(roi), F.col("label").cast("string"))})


def spots_path(spark: SparkSession, workspace: str, roi: str, codebook: str, must_exist: bool = False) -> str:
    """Where a region's spots are: the first of the tables under output, then deconv, with the code book's name sanitised or as
    it is, that exists in the workspace's file system; else the first place, or an error if one must exist."""
    clean = codebook.replace("-", "_").replace(" ", "_")
    places = [f"{workspace}/analysis/{part}/{roi}+{name}.parquet" for part in ("output", "deconv") for name in (clean, codebook)]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(places[0])
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for p in places:
        if store.exists(jvm.org.apache.hadoop.fs.Path(p)):
            return p
    if must_exist:
        raise FileNotFoundError(f"no spots of {roi}, {codebook}; looked for {', '.join(places)}")
    return places[0]


def delimited(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", header: bool = False, comment: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("sep", sep).option("header", str(header).lower())
    return (reader.option("comment", comment) if comment else reader).csv(path)


def gtf(spark: SparkSession, path: str, feature: str | None = "transcript") -> DataFrame:
    """GTF, plain or gzip, with the attributes as columns gene_id, gene_name, transcript_id, transcript_name, without versions,
    and tags as a sorted array."""
    df = delimited(spark, path, GTF, sep="\t", comment="#").withColumn("attributes", gtf_attributes(F.col("attribute")))
    one = lambda k: F.get(F.transform(F.filter("attributes", lambda a: a["key"] == k), lambda a: a["value"]), F.lit(0))
    df = df.withColumns({k: F.regexp_replace(one(k), r"\.\d+$", "") for k in ("gene_id", "transcript_id")} | {k: one(k) for k in ("gene_name", "transcript_name")})
    df = df.withColumn("tags", F.array_sort(F.transform(F.filter("attributes", lambda a: a["key"] == "tag"), lambda a: a["value"]))).drop("attributes")
    return df if feature is None else df.where(F.col("feature") == feature)


def gtf_attributes(text: Column) -> Column:
    """`key "value"; ...` as an array of key and value, repeats kept."""
    pattern = F.lit(r'(\w+) "([^"]*)"')
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("v"))
    return F.transform(pairs, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description, seq of each record; records are split by the reader, so a file need not fit a task."""
    raw = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    head = F.regexp_replace(F.split_part("value", F.lit("\n"), F.lit(1)), r"^>|\r$", "")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return raw.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), F.regexp_extract(head, r"^\S+\s+(.*)$", 1).alias("description"), body.alias("seq"))


def sam_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Alignment lines as columns, with integer tags, MD, and total and longest match; header lines go."""
    f = F.split(F.col(value), "\t")
    rows = lines.where(~F.col(value).startswith("@")).withColumn("_f", f)
    out = rows.select(*[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(SAM_FIELDS)], F.col(value).alias("_v"))
    out = out.withColumns({"flag": F.col("flag").try_cast("int"), "pos": F.col("pos").try_cast("bigint"), "mapq": F.col("mapq").try_cast("smallint")})
    out = out.withColumns({t: F.regexp_extract("_v", rf"\b{t}:i:(-?\d+)", 1).try_cast("int") for t in SAM_TAGS} | {"MD": F.nullif(F.regexp_extract("_v", r"\bMD:Z:(\S+)", 1), F.lit(""))})
    return out.withColumns({"match": F.coalesce(S.md_match(F.col("MD")), F.lit(0)), "match_consec": F.coalesce(S.md_longest(F.col("MD")), F.lit(0))}).drop("_v")


def sam(spark: SparkSession, path: str) -> DataFrame:
    return sam_lines(spark.read.text(path))


def tile_list(spark: SparkSession, path: str) -> DataFrame:
    """`[prefix-]0001.tif; ; (x, y)` lines: prefix, index, filename, x, y. Other lines than dim, comments and blanks fail."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*|dim\s*=.*)?$"))
    pattern = r"^(\w+-)?(\d+)\.tif; ; \(([+-]?\d+\.\d+), ?([+-]?\d+\.\d+)\)\s*$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    ok = F.when(F.col("value").rlike(pattern), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no tile line: "), "value")).cast("boolean"))
    return lines.where(ok).select(F.nullif(part(1), F.lit("")).alias("prefix"), part(2).cast("bigint").alias("index"), F.concat(part(1), part(2), F.lit(".tif")).alias("filename"), part(3).cast("float").alias("x"), part(4).cast("float").alias("y"))


def code_book(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of targets to bit lists: target, bits, is_blank."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.explode(F.from_json("value", "map<string, array<int>>")).alias("target", "bits")).withColumn("is_blank", F.col("target").startswith("Blank"))


def usable_codes(codes: DataFrame, available: Sequence[int]) -> DataFrame:
    """Codes all of whose bits are available."""
    listed = F.array(*[F.lit(b) for b in available])
    return codes.where(F.forall("bits", lambda b: F.array_contains(listed, b)))


def workspace(spark: SparkSession, root: str) -> DataFrame:
    """Files under a root by their folder `{round}--{roi}[+codebook]`: path, round, roi, codebook, ordered rounds by number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = with_path_parts(files, {"round": r"/([^/]+)--[^/]+/", "roi": r"/[^/]+--([^/+]+)", "codebook": r"/[^/]+--[^/+]+\+([^/]+)/"})
    return parts.where("round is not null").withColumn("round_number", F.regexp_extract("round", r"^(\d+)", 1).try_cast("int"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as bytes, with path and size."""
    return spark.read.format("binaryFile").load(path)


def tiff_fault(data: bytes) -> str | None:
    """Why a TIFF file cannot be read, or None: its header, each directory and the place of each strip or tile are followed."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        return "no TIFF header"
    big = struct.unpack_from(order + "H", data, 2)[0]
    if big not in (42, 43):
        return "no TIFF header"
    word, count, width, first = ("Q", "Q", 20, 8) if big == 43 else ("I", "H", 12, 4)
    sizes = {1: "B", 3: "H", 4: "I", 16: "Q"}
    try:
        at, seen = struct.unpack_from(order + word, data, first)[0], set()
        if not at:
            return "no directory"
        while at:
            if at in seen:
                return "directories in a circle"
            seen.add(at)
            n, tags = struct.unpack_from(order + count, data, at)[0], {}
            at += struct.calcsize(count)
            for i in range(n):
                tag, kind, many = struct.unpack_from(order + "HH" + word, data, at + i * width)
                if tag not in (273, 279, 324, 325) or kind not in sizes:
                    continue
                field = at + i * width + 4 + struct.calcsize(word)
                own = f"{many}{sizes[kind]}"
                if struct.calcsize(order + own) > struct.calcsize(word):
                    field = struct.unpack_from(order + word, data, field)[0]
                tags[tag] = struct.unpack_from(order + own, data, field)
            for where, length in ((273, 279), (324, 325)):
                if where in tags and any(a + b > len(data) for a, b in zip(tags[where], tags.get(length, ()))):
                    return "data past the end"
            if not tags.keys() & {273, 324}:
                return "no data"
            at = struct.unpack_from(order + word, data, at + n * width)[0]
    except (struct.error, OverflowError, MemoryError):
        return "cut off"
    return None


def verify_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, fault) of TIFF files, null where a file can be read. Files are checked where they are read, a few at a time."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "fault": [tiff_fault(x) for x in pdf["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, fault string")


def verify_codebook(spark: SparkSession, root: str, codebook: str, rois: Sequence[str] = ()) -> DataFrame:
    """verify_images over the folders registered--{roi}+{codebook} under a root, with roi. Named regions without files, or no
    files at all, are an error."""
    found = with_path_parts(verify_images(spark, f"{root}/registered--*+{codebook}"), {"roi": r"/registered--([^/+]+)\+"})
    if rois:
        found = found.where(F.col("roi").isin(*rois))
    held = {r["roi"] for r in found.select("roi").distinct().collect()}
    if missing := sorted(set(rois) - held):
        raise ValueError(f"no registered files of {missing} with {codebook}")
    if not held:
        raise ValueError(f"no registered files with {codebook}")
    return found
