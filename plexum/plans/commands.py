"""Whole commands over parts, order lines and events."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from plexum.functions import numbers as N
from plexum.operators import assembly, commands, fields, folding, ordering, screening
from plexum.operators.thermo import GAS, MODELS, SODIUM, STRAND, melting_temperature
from plexum.plans.base import query


def _tm_sql(seq: str, model: str, formamide: float = 0.0) -> str:
    """SQL of thermo.melting_temperature for texts of two bases and more."""
    own = MODELS[model]
    table = lambda k: "map {" + ", ".join(f"'{p}': {v[k]}::double" for p, v in own.neighbours().items()) + "}"
    total = lambda k: f"(list_sum(list_transform(range(1, length({seq})), lambda i: {table(k)}[substr({seq}, i::int, 2)])) + {own.start[k]} + {end(f'left({seq}, 1)', k)} + {end(f'right({seq}, 1)', k)})"
    end = lambda at, k: f"(case when {at} in ('A', 'T') then {own.weak[k]} else {own.strong[k]} end)"
    gc = f"(length(regexp_replace({seq}, '[^GC]', '', 'g')) / length({seq}))"
    salt = f" + 0.368 * ln({SODIUM}) * (length({seq}) - 1)" if own.salt_in_entropy else ""
    out = f"(1000.0 * {total(0)} / ({total(1)}{salt} + {GAS} * ln({STRAND}::double)) - 273.15 + (0.453 * ({gc} / 100.0) - 2.88) * ({formamide} * 10 * 1.13 / 45.04)"
    return out + ("" if own.salt_in_entropy else f" + (-1.842 * {gc} + 2.675) * ln({SODIUM}) - 0.7348 * ln({SODIUM}) * ln({SODIUM})") + ")"


_BASES = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query("part", sql=f"with s as (select p_partkey, {_BASES.format('p_partkey::varchar')} as seq from part) select p_partkey, round({_tm_sql('seq', 'dna', 10.0)}, 4) as dna, round({_tm_sql('seq', 'rna', 10.0)}, 4) as rna, round({_tm_sql('seq', 'hybrid', 10.0)}, 4) as hybrid from s")
def melting_temperatures(part):
    seq = N.random_bases(F.col("p_partkey").cast("string"))
    return part.select("p_partkey", *[F.round(melting_temperature(seq, m, 10.0), 4).alias(m) for m in ("dna", "rna", "hybrid")])


_SPOTS = """select l_returnflag as roi, l_orderkey * 8 + l_linenumber as id, l_quantity * 4.0 as area, l_extendedprice / 1e5 as norm, l_discount as distance, case when l_suppkey % 3 = 0 then 'Blank-' || l_linenumber else 'Gene-' || l_linenumber end as target, l_suppkey % 3 = 0 as is_blank from lineitem"""


def _spots(lineitem):
    blank = F.col("l_suppkey") % 3 == 0
    return lineitem.select(
        F.col("l_returnflag").alias("roi"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") * 4.0).alias("area"), (F.col("l_extendedprice") / 1e5).alias("norm"),
        F.col("l_discount").alias("distance"), F.concat(F.when(blank, "Blank-").otherwise("Gene-"), F.col("l_linenumber").cast("string")).alias("target"), blank.alias("is_blank"),
    )


_THRESHOLD = commands.Threshold(grid=20, sigma=2.0, least_spots=5, levels=20)
_SURFACE = f"""s as ({_SPOTS}), f as (select *, row_number() over () as line, cbrt(area::double) + (('0x' || substr(md5(id::varchar), 1, 6))::int / 16777216.0 - 0.5) * 1.5 as x, log10((norm * (1 - distance))::double) as y from s where area between 10 and 200 and norm > 0.007 and distance < 0.3),
b as (select roi, min(x) as x0, (max(x) - min(x)) / 19 as dx, min(y) as y0, (max(y) - min(y)) / 19 as dy from f group by 1), e as (select roi, (x0 > 1)::int as first from b),
c as (select roi, least(floor((x - x0) / dx), 20)::int as i, least(floor((y - y0) / dy), 20)::int as j, count(*) filter (is_blank) as blanks, count(*) as n from f join b using (roi) group by all),
r as (select roi, i, j, blanks / (n + 1e-9) as v from c where n >= 5 and i < 20 and j < 20), g0 as (select roi, first, g.i::int as i, h.j::int as j from e, range(0, 21) g(i), range(0, 20) h(j) where g.i < 20 + first),
g as (select g0.roi, first, g0.i, g0.j, coalesce(v, 0) as v from g0 left join r on r.roi = g0.roi and r.j = g0.j and r.i = greatest(g0.i - first, 0)),
k as (select d, exp(-0.5 * (d / 2.0) * (d / 2.0)) / (select sum(exp(-0.5 * (t.d / 2.0) * (t.d / 2.0))) from range(-8, 9) t(d)) as w from range(-8, 9) u(d)),
sx as (select a.roi, a.first, a.i, b2.j, sum(b2.v * w) as v from (select roi, first, g.i from e, range(0, 21) g(i) where g.i < 20 + first) a, k, g b2 where b2.roi = a.roi and b2.i = case when a.i + d < 0 then -1 - a.i - d when a.i + d > 19 + a.first then 2 * (20 + a.first) - 1 - a.i - d else a.i + d end group by all),
sm as (select a.roi, a.first, a.i, t.j, sum(a.v * w) as v from range(0, 20) t(j), k, sx a where a.j = case when t.j + d < 0 then -1 - t.j - d when t.j + d > 19 then 39 - t.j - d else t.j + d end group by all),
l as (select roi, min(v) as lo, max(v) as hi from sm group by 1),
p as (select f.*, first, least(greatest((x - x0) / dx + first, 0), 19 + first) as px, least(greatest((y - y0) / dy, 0), 19) as py from f join b using (roi) join e using (roi)),
q as (select *, least(floor(px), 18 + first)::int as pi, least(floor(py), 18)::int as pj from p),
d as (select q.roi, q.line, any_value(is_blank) as is_blank, any_value(target) as target, sum(v * (case when sm.i = pi then 1 - (px - pi) else px - pi end) * (case when sm.j = pj then 1 - (py - pj) else py - pj end)) as density from q join sm on sm.roi = q.roi and sm.i between pi and pi + 1 and sm.j between pj and pj + 1 group by 1, 2)"""


@query("lineitem", sql=f"with {_SURFACE} select roi, target, count(*) as count, bool_or(is_blank) as is_blank from d join l using (roi) where density < lo + (hi - lo) * case roi when 'A' then 7 when 'N' then 9 else 11 end / 19.0 group by 1, 2")
def density_threshold(lineitem):
    kept = commands.density_threshold(_spots(lineitem), "roi", F.col("id"), {"A": 7, "N": 9, "R": 11}, _THRESHOLD)
    return kept.groupBy("roi", "target").agg(F.count("*").alias("count"), F.bool_or("is_blank").alias("is_blank"))


@query("lineitem", sql=f"with {_SURFACE} select roi, k::int as level, count(*) filter (density < lo + (hi - lo) * k / 19.0) as spots, round(count(*) filter (is_blank and density < lo + (hi - lo) * k / 19.0) / greatest(count(*) filter (density < lo + (hi - lo) * k / 19.0), 1), 6) as blank_share from d join l using (roi), range(1, 15, 2) t(k) group by roi, k")
def density_curves(lineitem):
    return commands.threshold_curves(_spots(lineitem), "roi", F.col("id"), _THRESHOLD).withColumn("blank_share", F.round("blank_share", 6))


_ALIGNED = f"""a as (select 'P' || l_partkey as name, l_suppkey as transcript, case when l_linenumber = 1 then '20A11' else '32' end as md, l_linenumber, {_BASES.format('l_partkey::varchar')} as seq,
case when l_linenumber = 1 then 31 when l_linenumber < 4 then 24 else 18 end as match, case when l_linenumber = 1 then 20 when l_linenumber < 4 then 24 else 17 end as match_consec, 32 as length from lineitem)"""


@query("lineitem", "supplier", sql=f"""with {_ALIGNED}, ok as (select s_suppkey as transcript from supplier where s_nationkey < 23), k as (select name, seq, transcript, md, match_consec, transcript in (select transcript from ok) as good from a where name not in (select name from a where (match > 25.6 or match_consec > 25.6) and transcript not in (select transcript from ok))),
w as (select name, max({_tm_sql("(case when md = '32' then seq else substr(seq, 1, 20) end)", "hybrid", 40.0)}) as tm_off, max(match_consec) as consec from k where not good and match_consec > 16 group by 1),
g as (select name, any_value(seq) as seq, min(transcript) as transcript from k where good group by 1)
select name, seq, transcript, round(coalesce(tm_off, 0), 3) as max_tm_offtarget, coalesce(consec, 0)::int as match_consec_all, round({_tm_sql("seq", "hybrid", 40.0)}, 3) as tm,
(not contains(seq, 'GGGG'))::int + (not contains(seq, 'TTTT'))::int + (length(regexp_replace(seq, '[^T]', '', 'g')) / 32 < 0.28)::int + (not regexp_matches(seq, 'A{{4}}|T{{4}}|C{{4}}|G{{4}}'))::int + (length(regexp_replace(seq, '[^GC]', '', 'g')) / 32 between 0.35 and 0.65)::int
+ ({" and ".join(f"length(regexp_replace(substr(seq, {32 - 6 - i + 1}, 6), '[^G]', '', 'g')) < 4" for i in range(6))})::int as oks
from g left join w using (name) where not contains(seq, 'ACGTAC')""")
def probe_candidates(lineitem, supplier):
    n = F.col("l_linenumber")
    rows = lineitem.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_suppkey").alias("transcript"), N.random_bases(F.col("l_partkey").cast("string")).alias("seq"), F.lit("32M").alias("cigar"), F.when(n == 1, "20A11").otherwise("32").alias("md"),
        F.when(n == 1, 31).when(n < 4, 24).otherwise(18).alias("match"), F.when(n == 1, 20).when(n < 4, 24).otherwise(17).alias("match_consec"), F.lit(32).alias("length"),
    )
    good = supplier.where("s_nationkey < 23").select(F.col("s_suppkey").alias("transcript"))
    bad = lineitem.sparkSession.createDataFrame([("ACGTAC",)], "kmer string")
    out = commands.candidates(rows, good, bad_kmers=bad, k=6)
    return out.select("name", "seq", "transcript", F.round("max_tm_offtarget", 3).alias("max_tm_offtarget"), F.col("match_consec_all").cast("int").alias("match_consec_all"), F.round("tm", 3).alias("tm"), "oks")


@query("lineitem", "part", sql="""with recursive p as (select l_suppkey as gene, l_orderkey * 8 + l_linenumber as name, l_extendedprice::int as pos, l_quantity as hairpin from lineitem join part on l_partkey = p_partkey where l_extendedprice::int > 50 and length(p_name || p_type) > 17 and length(p_brand) < 24),
o as (select *, row_number() over (partition by gene order by hairpin, name::varchar) as q from p), t as (select *, row_number() over (partition by gene order by pos desc, name::varchar desc) as r from o where q <= 18),
f as (select gene, r, name, pos as last, true as kept from t where r = 1 union all select t.gene, t.r, t.name, case when f.last - t.pos < 50 then f.last else t.pos end, f.last - t.pos >= 50 from f join t on t.gene = f.gene and t.r = f.r + 1),
d as (select gene, name, row_number() over (partition by gene order by md5('4:' || name), name::varchar) as z from f where kept) select gene, name::varchar as name from d where z <= 16""")
def spaced_table(lineitem, part):
    rows = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("gene"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("name"), F.rint("l_extendedprice").cast("int").alias("pos_start"), F.col("l_quantity").alias("hairpin"), F.concat("p_name", "p_type").alias("splint"), F.col("p_brand").alias("padlock"))
    return commands.spaced_table(rows, "gene").select("gene", "name")


@query("part", "supplier", sql="""with f as (select s_nationkey % 5 as roi, s_suppkey as fid, (s_suppkey * 7919 % 1009)::double as x, (s_suppkey * 104729 % 997)::double as y from supplier), m as (select p_partkey % 5 as roi, p_partkey as id, (p_partkey * 31 % 1013)::double as x, (p_partkey * 57 % 991)::double as y from part),
n as (select m.roi, id, arg_min(struct_pack(fid := fid, dx := f.x - m.x, dy := f.y - m.y), (sqrt((f.x - m.x) * (f.x - m.x) + (f.y - m.y) * (f.y - m.y)), fid)) as t, min(sqrt((f.x - m.x) * (f.x - m.x) + (f.y - m.y) * (f.y - m.y))) as distance from m join f using (roi) group by 1, 2),
o as (select *, row_number() over (partition by roi, t.fid order by distance, id) as r from n) select roi, id, t.fid as fixed_id, t.dx as dx, t.dy as dy, round(distance, 6) as distance from o where r = 1""")
def fixed_points(part, supplier):
    f, m = F.col("s_suppkey"), F.col("p_partkey")
    fixed = supplier.select((F.col("s_nationkey") % 5).alias("roi"), f.alias("id"), (f * 7919 % 1009).cast("double").alias("x"), (f * 104729 % 997).cast("double").alias("y"))
    moving = part.select((m % 5).alias("roi"), m.alias("id"), (m * 31 % 1013).cast("double").alias("x"), (m * 57 % 991).cast("double").alias("y"))
    return commands.match_fixed(moving, fixed, "roi", 16.0).withColumn("distance", F.round("distance", 6))


@query("part")
def split_probes(part):
    """Arms of probes of 96 bases that each part's key decides; the target is what such short probes reach."""
    seq = F.concat(*[N.random_bases(F.concat(F.col("p_partkey").cast("string"), F.lit(f":{i}"))) for i in range(3)])
    return screening.split_arms(part.select("p_partkey", seq.alias("seq")), 60.0)


@query("part")
def hairpin_temperatures(part):
    """Hairpins of 32 bases that each part's key decides; tests compare them with a slow recursion."""
    seq = N.random_bases(F.col("p_partkey").cast("string"))
    return ordering.spread(part.select("p_partkey", seq.alias("seq"))).withColumn("hairpin", F.round(folding.hairpin_temperature(F.col("seq"), 40.0), 4))


@query("part")
def orthogonal_barcodes(part):
    """Barcodes of three letters, C as likely as both others, from words that each part's key decides; none folds when repeated."""
    letters = F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 20), "0123456789abcdef", "AAAATTTTCCCCCCCC")
    return commands.orthogonal_words(part.select("p_partkey", letters.alias("word")), "word", "p_partkey", ["TTTTTTTTTTTTTTTTTTTT"], accept=commands.without_hairpin)


@query("lineitem", "supplier", sql="""with f as (select s_suppkey as x, s_nationkey * 1.0 as low, s_nationkey * 1.0 + 3 + s_acctbal::double / 1000 as high from supplier), v as (select *, 1 / least(greatest((greatest(high, low + 0.001) - low) / 8.0, 1.0 / 3), 3.0) as inv from f),
m as (select avg(inv) as mean from v) select l_orderkey, l_linenumber, round(greatest(l_quantity::double - low, 0) * least(greatest(inv / mean, 1.0 / 3), 3.0), 6) as value from lineitem join v on l_suppkey = x, m""")
def field_correction(lineitem, supplier):
    low = F.col("s_nationkey") * 1.0
    field = supplier.select(F.col("s_suppkey").alias("x"), F.lit(0).alias("y"), low.alias("low"), (low + 3 + F.col("s_acctbal").cast("double") / 1000).alias("high"))
    pixels = lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("x"), F.lit(0).alias("y"), F.col("l_quantity").cast("double").alias("value"))
    return fields.correct(pixels, fields.range_gain(field, 8.0)).select("l_orderkey", "l_linenumber", F.round("value", 6).alias("value"))


_READOUTS = {1: "CATACATTCATTCACATTCC", 2: "CCAATTAATCCTCAAATTCC", 3: "TCCTACATTTTCCAAACCTC"}
_RC = {k: v[::-1].translate(str.maketrans("ACGT", "TGCA")).lower() for k, v in _READOUTS.items()}
_TURNS = list(permutations(_READOUTS))


def _encoded_sql() -> str:
    """One row for each place of the cycle and separator; a walk over the probes in order carries the place."""
    heads = ", ".join(f"({at}, {k}, '{sep.join(_RC[c] for c in _TURNS[(at + k) % 6])}', {', '.join(map(str, _TURNS[(at + k) % 6]))})" for at in range(6) for k, sep in enumerate(("AA", "TA", "AT", "TT")))
    return f"""with recursive p as (select p_partkey, translate(substr(md5(p_partkey::varchar), 1, 24), '0123456789abcdef', 'AAAACCCCGGGGTTTT') as pad from part),
h(spot, k, head, code1, code2, code3) as (values {heads}),
t as (select p_partkey, spot, k, head || pad as seq, code1, code2, code3 from p, h where not regexp_matches(head || pad, 'AAAAAA|TTTTTT|CCCCC|GGGGG') and not contains(upper(head || pad), 'GGATCC')),
m as (select p_partkey, spot, min(k) as k from t group by all), n as (select p_partkey, row_number() over (order by p_partkey) as r from p),
a as (select r, p_partkey, list(coalesce(k + 1, 4) order by s.spot) as used from n cross join (select unnest(range(6)) as spot) s left join m using (p_partkey, spot) group by all),
w(r, p_partkey, spot, next) as (select r, p_partkey, 0, used[1]::bigint % 6 from a where r = 1 union all select a.r, a.p_partkey, w.next, (w.next + a.used[w.next + 1]) % 6 from w join a on a.r = w.r + 1)
select p_partkey::varchar as name, seq, code1::bigint as code1, code2::bigint as code2, code3::bigint as code3 from w join m using (p_partkey, spot) join t using (p_partkey, spot, k)"""


@query("part", sql=_encoded_sql())
def encoded_probes(part):
    """Padlocks that each part's key decides, behind three readouts in the orders of a cycle that goes through all parts."""
    pad = F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 24), "0123456789abcdef", "AAAACCCCGGGGTTTT")
    return assembly.encode_probes(part.select(F.col("p_partkey").cast("string").alias("name"), "p_partkey", pad.alias("padlock")), _READOUTS, list(_READOUTS), ["p_partkey"])


@query("part", sql="""with recursive p as (select p_partkey * 7919 % 997 as i, p_partkey * 104729 % 991 as j, md5(p_partkey::varchar) as k from part), n as (select *, row_number() over (order by k, i, j) as r from p),
w(r, i, j, ok, a, b) as (select r, i, j, true, [i], [j] from n where r = 1 union all select n.r, n.i, n.j, not (list_contains(w.a, n.i) or list_contains(w.b, n.j)), case when list_contains(w.a, n.i) or list_contains(w.b, n.j) then w.a else list_append(w.a, n.i) end, case when list_contains(w.a, n.i) or list_contains(w.b, n.j) then w.b else list_append(w.b, n.j) end from w join n on n.r = w.r + 1)
select i, j from w where ok""")
def paired_amplifiers(part):
    """Pairs of two sets of amplifiers, taken in the order of a digest as long as neither side is."""
    key = F.col("p_partkey")
    return assembly.pair_first_free(part.select((key * 7919 % 997).alias("i"), (key * 104729 % 991).alias("j"), F.md5(key.cast("string")).alias("k")))
