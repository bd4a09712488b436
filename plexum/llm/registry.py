"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexum.llm import align, bpe, chat, decontaminate, html_extract, ngram_join, quality, suffix_dedup, token_ids, toxicity, url_filter, webp, yinyang
from plexum.llm.common import read

#: Both turns of the conversation that op1 adds.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"select -1L as conv_id, t as turn, r as role, '{PROBE}' as text from values (0L, 'user'), (1L, 'assistant') as v(t, r)")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    messages = rows.unionByName(probe).select(F.col("conv_id").alias("tree"), number.cast("long").alias("node"), "role", "text")
    out = chat.format_trees(messages.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)}))
    turns = F.transform(chat.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'),
e as (
  select *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '\[(/?(?:INST|ANS|ROLE|SAYS)\])', '[\\\1', 'g'), '<(/?s>)', '<\\\1', 'g') as body,
    regexp_replace(regexp_replace(replace(role, '\', '\\'), '\[(/?(?:INST|ANS|ROLE|SAYS)\])', '[\\\1', 'g'), '<(/?s>)', '<\\\1', 'g') as who
  from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (7 + sum(length(body) + case role when 'user' then 15 when 'assistant' then 13 else 23 + length(who) end))::bigint as formatted_chars
from e group by conv_id
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.mark(docs, read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["stop"])), ",").alias("hit_spans"))


OP2_SQL = r"""
with bw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as s from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from bw where len(w) > 0)),
sizes as (select distinct n from win),
dw as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
gaps as (select row_number() over () as r, list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda g: length(g)) as g from documents),
grams as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as s from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
found as (select g.r, g.i, g.n, item_id from grams g join win using (n, s)),
hits as (select distinct r, unnest(range(i, i + n)) as j from found),
hit as (select r, count(*) as n_hit from hits group by r),
runs as (select r, min(j) as a, max(j) as b from (select r, j, j - row_number() over (partition by r order by j) as k from hits) group by r, k),
offs as (select r, (list_sum(g[1:a]) + coalesce(list_sum(list_transform(w[1:a - 1], lambda x: length(x))), 0))::bigint as s, (list_sum(g[1:b]) + list_sum(list_transform(w[1:b], lambda x: length(x))))::bigint as e from runs join dw using (r) join gaps using (r)),
spans as (select r, string_agg(s || ':' || e, ',' order by s) as hit_spans from offs group by r),
items as (select r, count(*) as n_items, string_agg(k, ',' order by k) as list from (select distinct r, item_id::varchar as k from found) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(hit_spans, '') as hit_spans
from dw left join hit using (r) left join items using (r) left join spans using (r)
"""


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    out = bpe.decode(bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), F.col("score"), F.col("predicted"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Entries of op7 beside those of the pages' own hosts: list, kind, key, event, day.
LISTED = (
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-02-01"),
    ("spam", "word", "casino", "add", "2024-01-15"),
    ("spam", "word", "pills", "add", "2024-03-01"),
    ("spam", "word", "pills", "drop", "2024-09-01"),
    ("optout", "domain", "example.org", "add", "2024-06-01"),
    ("optout", "domain", "example.org", "drop", "2024-07-01"),
    ("optout", "domain", "example.org", "add", "2024-11-01"),
    ("login", "word", "login", "add", "2024-01-01"),
)


def _day(what: str, span: int) -> F.Column:
    """A number below span from a string, in any engine."""
    return (F.conv(F.substring(F.md5(what), 1, 6), 16, 10).cast("long") % span).cast("int")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold neither fetch times nor lists. A page counts as fetched on a day of 2024 that its URL's digest gives;
    every host was put on a list on one day and taken off later, beside the entries of LISTED."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    start = F.lit("2024-01-01").cast("date")
    captures = pages.withColumn("fetched_at", F.date_add(start, _day(F.coalesce("url", F.lit("")), 366)))
    hosts = captures.select(url_filter.host(F.col("url")).alias("key")).where("key <> ''").distinct()
    added = _day(F.col("key"), 366)
    own = hosts.select(F.lit("hosts").alias("list"), F.lit("host").alias("kind"), "key", F.explode(F.array(F.struct(F.lit("add").alias("event"), F.date_add(start, added).alias("at")), F.struct(F.lit("drop").alias("event"), F.date_add(start, added + 30 + _day(F.reverse("key"), 120)).alias("at")))).alias("e")).select("list", "kind", "key", "e.*")
    fixed = spark.createDataFrame(LISTED, "list string, kind string, key string, event string, at string").withColumn("at", F.col("at").cast("date"))
    out = url_filter.apply(captures, own.unionByName(fixed))
    hits = F.transform("hits", lambda h: F.concat_ws(":", h["list"], h["kind"], h["key"]))
    return out.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "blocked", F.size("hits").cast("long").alias("n_hits"), F.array_join(F.array_sort(hits), ",").alias("hit_keys"))


OP7_SQL = rf"""
with p as (select page_id, url, date '2024-01-01' + (('0x' || substr(md5(coalesce(url, '')), 1, 6))::int % 366) as day,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as h from pages),
hosts as (select distinct h as key, date '2024-01-01' + (('0x' || substr(md5(h), 1, 6))::int % 366) as since, ('0x' || substr(md5(reverse(h)), 1, 6))::int % 120 as more from p where h <> ''),
iv as (select 'hosts' as list, 'host' as kind, key, since, (since + 30 + more)::date as until from hosts
  union all select * from (values ('spam', 'domain', 'cheap-pills.example.com', date '2024-02-01', null), ('spam', 'word', 'casino', date '2024-01-15', null),
    ('spam', 'word', 'pills', date '2024-03-01', date '2024-09-01'), ('optout', 'domain', 'example.org', date '2024-06-01', date '2024-07-01'),
    ('optout', 'domain', 'example.org', date '2024-11-01', null), ('login', 'word', 'login', date '2024-01-01', null))),
u as (select distinct url, day, h from p where h <> ''),
k as (select url, day, 'host' as kind, h as key from u
  union all select url, day, 'domain', array_to_string(l[i:len(l)], '.') from (select url, day, string_split(h, '.') as l, unnest(range(1, len(string_split(h, '.')) + 1)) as i from u)
  union all select url, day, 'word', unnest(list_distinct(list_filter(regexp_split_to_array(h || '/' || lower(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)), '[^a-z0-9]+'), lambda w: w <> ''))) from u),
m as (select distinct k.url, k.day, list || ':' || kind || ':' || key as hit from k join iv using (kind, key) where k.day >= iv.since and (iv.until is null or k.day < iv.until)),
g as (select url, day, count(*) as n, string_agg(hit, ',' order by hit) as hits from m group by url, day)
select page_id, p.url, strftime(p.day, '%Y-%m-%d') as fetched_on, g.n is not null as blocked, coalesce(g.n, 0)::bigint as n_hits, coalesce(g.hits, '') as hit_keys
from p left join g on p.url = g.url and p.day = g.day
"""


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = webp.to_media(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return webp.from_media(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.round("severity", 9).alias("severity"), "grade", F.round("p_toxic", 9).alias("p_toxic"), "toxic")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda groups: hashlib.sha256(groups.encode()).hexdigest()  # noqa: E731  the description itself is three times its text
    out = align.count_links(docs, tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"), told=digest)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


#: Centroids and rounds of op12.
CENTROIDS, ROUNDS = 40, 5


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out, centroids = yinyang.fit(vectors, CENTROIDS, ROUNDS, 64, seed="2:", scale=256)
    out = out.select("vec_id", "cluster", "distance")
    sums = dict(tuple(r) for r in out.groupBy("cluster").agg(F.sum("distance")).collect())  # one for each centroid
    facts = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql() -> str:
    near = "select r, v, min({'d': list_dot_product(v, v) - 2 * list_dot_product(v, w) + list_dot_product(w, w), 'c': c}) as b from x, %s group by r, v"
    parts = [
        """x as (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor(e::double * 256)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64)""",
        f"c0 as (select row_number() over (order by sha256('2:' || vec_id), v) - 1 as c, v as w from x where vec_id is not null qualify c < {CENTROIDS})",
    ]
    for i in range(ROUNDS):
        parts += [
            f"a{i} as materialized ({near % f'c{i}'})",
            f"m{i} as (select c, list(m order by i) as w from (select c, i, floor(sum(e) / count(*)) as m from (select b.c as c, unnest(v) as e, unnest(range(1, 65)) as i from a{i}) group by c, i) group by c)",
            f"c{i + 1} as materialized (select c, coalesce(m{i}.w, c{i}.w) as w from c{i} left join m{i} using (c))",
        ]
    last = f"c{ROUNDS}"
    chain = ", ".join([*parts, f"z as materialized ({near % last})"])
    return f"""with {chain}
select vec_id, b.c::int as cluster, b.d::bigint as distance, (sum(b.d) over (partition by b.c))::bigint as cluster_inertia, (sum(b.d) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(w, lambda e: e::bigint), ',')) as centroid_sha256
from z join x using (r) join {last} on b.c = c"""


OP12_SQL = _op12_sql()


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_ids.write(docs, public_tokenizers.path("word_bpe_49k.json"))
    return token_ids.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries():
    return {
        "op1_chat_format": op1_chat_format,
        "op2_decontaminate": op2_decontaminate,
        "op3_bpe": op3_bpe,
        "op4_quality": op4_quality,
        "op5_ngram_join": op5_ngram_join,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_html_extract": op8_html_extract,
        "op9_webp": op9_webp,
        "op10_toxicity": op10_toxicity,
        "op11_align": op11_align,
        "op12_centroids": op12_centroids,
        "op13_token_ids": op13_token_ids,
    }


def oracle_sql():
    return {"op1_chat_format": OP1_SQL, "op2_decontaminate": OP2_SQL, "op7_url_filter": OP7_SQL, "op12_centroids": OP12_SQL}
