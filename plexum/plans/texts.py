"""Text, sequence and JSON expressions over names, documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexum.functions import sequences as S
from plexum.operators import kmers
from plexum.plans.base import query


@query("part", sql="select p_partkey, reverse(translate(p_name, 'ACGTacgt', 'TGCAtgca')) as rc from part")
def reverse_complement(part):
    return part.select("p_partkey", S.reverse_complement(F.col("p_name")).alias("rc"))


@query("part", sql="select p_partkey, substr(p_name, 4) || left(p_name, 3) as rotated, p_name || substr('ACGTACGTACGTACGTACGTACGTACGTACGTACGT', 1, greatest(32 - length(p_name), 0)) as padded, lpad(p_partkey::varchar, 9, '0') as filled, right(p_name, 4) as tail from part")
def rotate_pad(part):
    name = F.col("p_name")
    return part.select("p_partkey", S.rotate(name, 3).alias("rotated"), S.pad_to(name, "ACGT" * 9, 32).alias("padded"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("filled"), F.right(name, F.lit(4)).alias("tail"))


@query("documents", sql="select doc_id, round(len(regexp_extract_all(translate(text, 'gc', 'GC'), '[GC]')) / nullif(length(text), 0), 6) as gc, len(regexp_extract_all(text, '[Aa][Aa]')) as aa, length(text)::bigint as chars, regexp_matches(text, '[Aa]{3}|[Tt]{3}|[Cc]{3}|[Gg]{3}') as homopolymer from documents")
def gc_like(documents):
    text = F.col("text")
    return documents.select("doc_id", F.round(S.gc_content(F.translate(text, "gc", "GC")), 6).alias("gc"), F.regexp_count(text, F.lit("[Aa][Aa]")).cast("long").alias("aa"), F.length(text).cast("long").alias("chars"), S.homopolymer(text, "[Aa]{3}|[Tt]{3}|[Cc]{3}|[Gg]{3}").alias("homopolymer"))


@query("documents", sql="with k as (select unnest(list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5))) as kmer from documents where length(text) >= 5) select kmer, count(*) as n from k group by 1 having count(*) >= 50")
def kmer_count(documents):
    return kmers.counts(documents, "text", 5).where("n >= 50")


@query("part", sql="select p_partkey, len(list_filter(list_transform(range(1, greatest(length(p_name) - 1, 1)), lambda i: substr(p_name, i, 3)), lambda k: k in ('ing', 'the', 'art', 'Par'))) > 0 and length(p_name) >= 3 as hit from part")
def kmer_flag(part):
    listed = F.array(*[F.lit(k) for k in ("ing", "the", "art", "Par")])
    return part.select("p_partkey", F.arrays_overlap(S.kmers(F.col("p_name"), 3), listed).alias("hit"))


@query("events", sql="select event_id, json_extract_string(props, '$.k')::bigint as k, nullif(regexp_extract(props, '(\\d+)', 1), '') as digits, len(regexp_extract_all(props, '\\d'))::bigint as n_digits from events")
def json_path(events):
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.nullif(F.regexp_extract("props", r"(\d+)", 1), F.lit("")).alias("digits"), F.regexp_count("props", F.lit(r"\d")).cast("long").alias("n_digits"))


@query("pages", sql="select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_extract(url, '/([a-z]{2})/', 1) as lang, nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '') as page, regexp_replace(url, '^https?://', '') as bare, split_part(url, '/', 3) as third from pages")
def regex_parse(pages):
    u = F.col("url")
    return pages.select("page_id", F.regexp_extract(u, r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract(u, r"/([a-z]{2})/", 1).alias("lang"), F.nullif(F.regexp_extract(u, r"[?&]page=(\d+)", 1), F.lit("")).alias("page"), F.regexp_replace(u, r"^https?://", "").alias("bare"), F.split_part(u, F.lit("/"), F.lit(3)).alias("third"))


_BASES = "translate(upper(p_name || p_type), 'BDEFHIJKLMNOPQRSUVWXYZ -', 'ACGTACGTACGTACGTACGTACGT')"
_WINDOWS = " and ".join(f"len(regexp_extract_all(substr(s, length(s) - {5 + i}, 6), 'G')) < 4" for i in range(6))


@query("part", sql=f"""with p as (select p_partkey, {_BASES} as s from part)
select p_partkey, not contains(s, 'GGGG') as ok_quad_c, not contains(s, 'TTTT') as ok_quad_a, {_WINDOWS} as ok_stack_c, len(regexp_extract_all(s, 'T')) / length(s) < 0.28 as ok_comp_a,
not regexp_matches(s, 'A{{4,}}|T{{4,}}|C{{4,}}|G{{4,}}') as ok_homopolymer, round(len(regexp_extract_all(s, 'G|C')) / length(s), 6) as gc_content from p""")
def probe_flags(part):
    """Names and types read as bases."""
    bases = F.translate(F.upper(F.concat("p_name", "p_type")), "BDEFHIJKLMNOPQRSUVWXYZ -", "ACGTACGTACGTACGTACGTACGT")
    flags = S.probe_flags(F.col("s"))
    return part.select("p_partkey", bases.alias("s")).select("p_partkey", *[(F.round(c, 6) if k == "gc_content" else c).alias(k) for k, c in flags.items()])


@query("part", sql="select p_partkey, translate(p_name, '- ', '__') as clean, levenshtein(p_name, p_type)::bigint as distance, right(md5(p_name), 6) as digest, lower(p_brand) || '/' || upper(p_type) as joined from part")
def name_tools(part):
    return part.select("p_partkey", S.sanitise(F.col("p_name")).alias("clean"), F.levenshtein("p_name", "p_type").cast("long").alias("distance"), F.right(F.md5(F.col("p_name").cast("binary")), F.lit(6)).alias("digest"), F.concat(F.lower("p_brand"), F.lit("/"), F.upper("p_type")).alias("joined"))


@query("part", sql="select p_partkey, chr(65 + ((p_partkey % 96) // 12)::int) || lpad(((p_partkey % 96) % 12 + 1)::varchar, 2, '0') as well from part")
def well_names(part):
    return part.select("p_partkey", S.well_name(F.col("p_partkey")).alias("well"))
