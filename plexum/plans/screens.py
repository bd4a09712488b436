"""Probe screening over parts, order lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexum.functions import numbers as N
from plexum.operators import probes, screening
from plexum.plans.base import query

_C6 = " and ".join(f"length(replace(substr(seq, {i + 1}, 6), 'C', '')) > 2" for i in range(4))


@query("part", sql=f"""with w as (select n, list_aggregate(list_transform(range(0, 9), lambda i: substr('ACT', ((n // pow(3, 8 - i)::bigint) % 3 + 1)::int, 1)), 'string_agg', '') as seq from range(0, 19683) t(n)),
u as (select translate(substr(md5(p_partkey::varchar), 1, 9), '0123456789abcdef', 'ACTACTACTACTACTA') as seq, count(*) as parts from part group by 1)
select n, seq, coalesce(parts, 0) as parts from w left join u using (seq) where not regexp_matches(seq, 'CCC|TTTT|AAAA') and (9 - length(replace(seq, 'C', ''))) / 9.0 between 0.4 and 0.6 and (9 - length(replace(seq, 'A', ''))) / 9.0 < 0.28 and {_C6} and levenshtein(seq, 'CATCATCAT') > 3""")
def three_letter_words(part):
    """Words of nine letters that pass the rules, and how many parts' digests spell each."""
    spelled = part.select(F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 9), "0123456789abcdef", "ACTACTACTACTACTA").alias("seq")).groupBy("seq").agg(F.count("*").alias("parts"))
    words = screening.words(part.sparkSession, 9, c_share=(0.4, 0.6), away=("CATCATCAT", 3))
    return words.join(spelled, "seq", "left").select("n", "seq", F.coalesce("parts", F.lit(0)).alias("parts"))


@query("lineitem", "part", sql="""with c as (select p_partkey as transcript, case when p_partkey % 11 = 0 then 'Gm' || p_partkey when p_partkey % 5 = 0 then 'Actb-2' || p_partkey else p_name end as transcript_name, count(*) as count from lineitem join part on l_partkey = p_partkey group by all),
r as (select *, transcript_name like 'Actb-%' or transcript in ('7', '9') as is_related from (select transcript::varchar as transcript, transcript_name, count from c)), t as (select max(count) as top from r), l as (select count as lc, transcript as lt from r where is_related order by count, transcript limit 1)
select transcript, is_related, count > 0.1 * top as significant, transcript_name like 'Gm%' and count > 0.5 * top and (count > lc or (count = lc and transcript > lt)) as maybe_acceptable from r, t, l""")
def related_transcripts(lineitem, part):
    key = F.col("p_partkey")
    name = F.when(key % 11 == 0, F.concat(F.lit("Gm"), key.cast("string"))).when(key % 5 == 0, F.concat(F.lit("Actb-2"), key.cast("string"))).otherwise(F.col("p_name"))
    counts = lineitem.groupBy("l_partkey").agg(F.count("*").alias("count")).join(part, F.col("l_partkey") == key).select(key.cast("string").alias("transcript"), name.alias("transcript_name"), "count")
    return screening.related_transcripts(counts, ["Actb", "7", "9"]).select("transcript", "is_related", "significant", "maybe_acceptable")


@query("part", sql=r"select p_name, n, case when not regexp_full_match(p_name, '[\x00-\x7F]*') then 'not ASCII' else 'repeated' end as fault from (select p_name, count(*) as n from part where p_name <> '' group by 1) where n > 1 or not regexp_full_match(p_name, '[\x00-\x7F]*')")
def name_faults(part):
    return screening.name_faults(part, "p_name")


_CODES = probes.spread_codes(8, 3, 2)


@query("part", sql=f"""with c as (select code, row_number() over (order by md5('7:' || code), code) as i from (select unnest([{", ".join(map(str, _CODES))}])::bigint as code)), g as (select p_brand as name, row_number() over (order by p_brand) as i from (select distinct p_brand from part)), k as (select count(*) as k from g)
select coalesce(name, 'Blank-' || (c.i - k)) as name, array_to_string(list_filter(range(1, 9), lambda b: (code >> (b - 1)) & 1 = 1), ',') as bits from c left join g using (i), k""")
def codebook_export(part):
    out = screening.export_codes(part.select("p_brand").distinct(), "p_brand", _CODES, 8, 7)
    return out.select("name", F.array_join(F.col("code_bits").cast("array<string>"), ",").alias("bits"))


@query("events", sql="""with l(event_type, pc1, pc2) as (values ('click', 0.2, -0.1), ('error', -0.4, 0.3), ('view', 0.1, 0.5), ('signup', -0.6, -0.2)), c as (select user_id, event_type, count(*) as n from events group by all),
p as (select user_id, sum(n * pc1)::double as p1, sum(n * pc2)::double as p2 from c join l using (event_type) group by 1), t as (select *, atan2(p2, p1 + 1) + pi() / 2 as t from p) select user_id, round(p1, 6) as p1, round(p2, 6) as p2, round(t - 2 * pi() * floor(t / (2 * pi())) - pi(), 6) as angle from t""")
def cycle_projection(events):
    loadings = events.sparkSession.createDataFrame([("click", 0.2, -0.1), ("error", -0.4, 0.3), ("view", 0.1, 0.5), ("signup", -0.6, -0.2)], "event_type string, pc1 double, pc2 double")
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return screening.project(counts, F.broadcast(loadings), "user_id", "event_type", "n").select("user_id", *[F.round(c, 6).alias(c) for c in ("p1", "p2", "angle")])


@query("part")
def probe_windows(part):
    """Windows over a sequence of 128 bases that each part's key decides."""
    seq = F.concat(*[N.random_bases(F.concat(F.col("p_partkey").cast("string"), F.lit(f":{i}"))) for i in range(4)])
    return screening.crawl(part.select(F.col("p_partkey").cast("string").alias("name"), seq.alias("seq")))


@query("part")
def tiered_selection(part):
    rows = part.select("p_brand", F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 % 1000).alias("start"), (F.col("p_partkey") * 37 % 1000 + F.col("p_size")).alias("stop"), (F.col("p_partkey") % 3 + 1).alias("priority"))
    return screening.tiered_selection(rows, "p_brand", 3, 0, 12)


@query("lineitem")
def blank_classifier(lineitem):
    rows = lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_discount", (F.col("l_returnflag") == "R").alias("blank"))
    return screening.blank_classifier(rows, ["l_quantity", "l_discount"], "blank").withColumn("p_blank", F.round("p_blank", 6))
