"""URL filters with dated lists, in DataFrame operations only.

Lists change: each event adds a key to a list or drops it. Events become validity intervals, and a capture is held against
the entries that were active when it was fetched: an as-of join on the key and the fetch time.

Keys have a kind: `host` is the whole host, `domain` the host or one of its parents, `word` a word of host or path.

Defined cases: a null or malformed URL has no key and passes; a null fetch time meets no interval; events of a null key or
time are ignored; of events at one time a drop comes after an add; adding what is listed or dropping what is not changes
nothing; repeated captures get the same verdict each; clashing columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lists of at most so many intervals are sent to every task; longer ones are joined by key, salted.
MAX_SENT = 20_000
SALTS = 16


def host(url: Column) -> Column:
    """The host in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def keys(url: Column) -> Column:
    """All kinds and keys of a URL, once each."""
    h = host(url)
    labels = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.lower(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1))
    words = F.filter(F.split(F.concat_ws("/", h, path), r"[^a-z0-9]+"), lambda w: w != "")

    def as_keys(kind: str, found: Column) -> Column:
        return F.transform(found, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    return F.when(h != "", F.array_distinct(F.concat(as_keys("host", F.array(h)), as_keys("domain", domains), as_keys("word", words))))


def intervals(events: DataFrame) -> DataFrame:
    """events: list, kind, key, event (add or drop), at. list, kind, key, since and until (null: still active), disjoint."""
    w = Window.partitionBy("list", "kind", "key").orderBy("at", "event")
    changes = (
        events.where("key is not null and at is not null and event in ('add', 'drop')")
        .withColumn("was", F.lag("event").over(w)).where("event <> coalesce(was, 'drop')")
        .withColumn("until", F.lead("at").over(w))
    )
    return changes.where("event = 'add' and (until is null or until > at)").select("list", "kind", "key", F.col("at").alias("since"), "until")


def matches(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at", max_sent: int = MAX_SENT) -> DataFrame:
    """url, fetched, and hits (list, kind, key; sorted) of each distinct capture that an active entry meets."""
    listed = intervals(events)
    held = (
        captures.select(F.col(url).alias("url"), F.col(fetched).alias("at")).where("url is not null and at is not null").distinct()
        .withColumn("k", F.explode(keys(F.col("url")))).select("url", "at", "k.kind", "k.key")
    )
    on = ["kind", "key"]
    if listed.limit(max_sent + 1).count() <= max_sent:
        listed = F.broadcast(listed)
    else:
        held = held.withColumn("salt", F.pmod(F.xxhash64("url", "at"), F.lit(SALTS)))
        listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        on = [*on, "salt"]
    active = held.join(listed, on).where("at >= since and (until is null or at < until)")
    return active.groupBy("url", "at").agg(F.array_sort(F.collect_set(F.struct("list", "kind", "key"))).alias("hits"))


def apply(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at", max_sent: int = MAX_SENT) -> DataFrame:
    """captures with hits (empty where none) and blocked: an entry was active when the capture was fetched."""
    found = matches(captures, events, url, fetched, max_sent).select(F.col("url").alias("_u"), F.col("at").alias("_t"), F.col("hits").alias("_h"))
    kept = [c for c in captures.columns if c.lower() not in ("hits", "blocked")]
    left = captures.select(*[captures[c] for c in kept])
    out = left.join(found, (left[url] == F.col("_u")) & (left[fetched] == F.col("_t")), "left")
    return out.select(*[left[c] for c in kept], F.coalesce("_h", F.array().cast("array<struct<list:string,kind:string,key:string>>")).alias("hits"), F.col("_h").isNotNull().alias("blocked"))
