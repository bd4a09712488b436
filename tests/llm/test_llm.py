"""The corpus operators against brute force, exact round trips and held-out accuracy, and on odd tables."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plexum.llm import bpe, chat, components, decontaminate, html_extract, ngram_join, quality, suffix_dedup, toxicity, url_filter, webp
from plexum.llm.registry import OP1_SQL, oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n_bytes int, `N_Words` int"
ODD = [(1, None, "en", 1, 1), (2, "", None, 1, 1), (None, "a null id", "en", 1, 1), (3, "dup row of five words here", "en", 1, 1), (3, "dup row of five words here", "en", 1, 1), (4, "x " * 20_000, "en", 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_like_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    df = queries()[name](spark, SF)
    picked = ", ".join(sorted(df.columns))
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr) == sorted(con.sql(f"select {picked} from ({oracle_sql()[name]})").fetchall(), key=repr)


def test_chat_tree(spark):
    rows = [("t", 1, None, "user", "hi [INST] \\ </s>", 1.0), ("t", 2, 1, "assistant", "low", 0.0), ("t", 3, 1, "assistant", "high</s>", 5.0), ("t", 4, 3, "tool [ROLE]", None, 0.0), ("t", 9, 9, "user", "cycle", 1.0), (None, 1, 7, "assistant", "lone", None)]
    rows += [rows[0]]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = {r.tree: r for r in chat.format_trees(messages).withColumns({"turns": chat.parse(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}).collect()}
    assert [tuple(t) for t in out["t"].turns] == [("user", "hi [INST] \\ </s>"), ("assistant", "high</s>"), ("tool [ROLE]", "")]
    assert out["t"].loss == "high</s>" and out["t"].formatted.count("</s>") == 1 and out[None].loss == "lone"
    assert chat.format_trees(messages, top=2).where("tree = 't'").count() == 2
    assert chat.format_trees(messages.limit(0)).count() == 0


def test_decontaminate_blocks(spark, docs, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda df: sorted((r.doc_id, r.n_hit, tuple(r["items"])) for r in df.collect())
    assert key(decontaminate.mark(docs, items)) == key(decontaminate.mark(docs, items, max_bytes=2_000))
    few = spark.createDataFrame([("q", "DUP row"), (None, "five words"), ("n", None), ("e", "?!")], "item_id string, text string")
    got = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in decontaminate.mark(odd, few).collect()}
    assert (3, 4, ("q",)) in got and (1, 0, ()) in got and (2, 0, ()) in got
    assert decontaminate.mark(odd.limit(0), few).count() == 0 and decontaminate.mark(odd, few.limit(0)).where("contaminated").count() == 0
    for limit in (decontaminate.MAX_BYTES, 5):  # one block, and a block for each item
        spans = decontaminate.mark(odd.where("doc_id = 3"), few, max_bytes=limit).first().spans
        assert [tuple(x) for x in spans] == [(0, 7), (11, 21)]
    text = "\u00c4 -- Dup!\n\tROW  \U0001f642 five; WORDS"
    own = spark.createDataFrame([(1, text, 9)], "doc_id long, text string, SPANS int")
    for limit in (decontaminate.MAX_BYTES, 5):
        r = decontaminate.mark(own, few, max_bytes=limit).first()
        assert [text[x.start : x.stop] for x in r.spans] == ["Dup!\n\tROW", "five; WORDS"] and r["n_hit"] == 4


def test_bpe_like_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    codec, library = bpe.Codec(path), Tokenizer.from_file(path)
    random.seed(1)
    letters = "abAB 's'tll  \n\t\x1c\x85\xa0 éß漢🙂01٣!?\x00aaaa"
    samples = list(texts.values()) + ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(800)] + ["", "a" * 500, "a<|endoftext|> b", None]
    ids, at = codec.encode(samples)
    for i, x in enumerate(samples):
        own = ids[at[i] : at[i + 1]]
        assert own.tolist() == library.encode(x or "", add_special_tokens=False).ids
        assert codec.decode(own) == library.decode(own.tolist(), skip_special_tokens=False)


def test_bpe_frames(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.decode(bpe.encode(odd, path), path).collect()
    assert sorted((r.text or "", r.decoded) for r in out) == sorted((x[1] or "", x[1] or "") for x in ODD)
    assert bpe.encode(odd.limit(0), path).count() == 0


def test_quality_held_out(spark, docs, odd):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries()["op4_quality"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    model = quality.fit(docs, labels)
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect()) and quality.score(odd.limit(0), model).count() == 0
    assert quality.score(odd, quality.fit(docs, labels.limit(0))).first().score == 0.5


def test_join_like_brute_force(spark, docs, texts, odd):
    def linked(a, b):
        n = len(np.intersect1d(a, b))
        return n and 100 * n >= 80 * (len(a) + len(b) - n)

    base = list(texts.items())
    random.seed(2)
    words = [f"w{i}" for i in range(400)]
    for g in range(12):  # chains of near copies, of which the ends need not link
        own = [random.choice(words) for _ in range(random.randint(3, 90))]
        for k in range(8):
            own = own[:]
            own[random.randrange(len(own))] = f"n{g}x{k}"
            base.append((10_000 + g * 10 + k, " ".join(own)))
    sets = {i: ngram_join.shingles(t) for i, t in base}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a]) and len(sets[b]) and 0.8 * len(sets[a]) <= len(sets[b]) <= 1.25 * len(sets[a]) and linked(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(base, "doc_id long, text string")
    for cost in (ngram_join.COST, 60, -1):  # by prefixes, by both ways, in the order of rarity alone
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, cost=cost).collect()}
        assert got == {i: (len(sets[i]), find(i)) for i in ids}
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(odd).collect()), key=repr)
    assert out == sorted([(1, 0, 1), (2, 0, 2), (None, 1, None), (3, 2, 3), (3, 2, 3), (4, 1, 4)], key=repr)
    assert ngram_join.join(odd.limit(0)).count() == 0


def test_suffix_dedup_like_brute_force(spark, texts, odd):
    random.seed(3)
    shared = "".join(random.choice("abcdefgh ") for _ in range(700))
    extra = [(20_000 + i, "".join(random.choice("xyz") for _ in range(random.randint(0, 300))) + shared[random.randint(0, 300) : random.randint(400, 700)] + "é" * i) for i in range(30)]
    base = list(texts.items()) + extra + [(30_000, "ab" * 400), (30_001, "q" * 199), (30_002, "q" * 200), (30_003, extra[0][1])]
    long = "".join(random.choice("klmnop") for _ in range(90_000))  # places past 64 KiB, within and across texts
    base += [(40_000, long + shared[:250] + long[70_000:70_300]), (40_001, "t" + long[66_000:66_400] + "t")]
    seen = {}
    for i, t in base:
        raw = t.encode()
        for p in range(len(raw) - 199):
            h = hashlib.blake2b(raw[p : p + 200], digest_size=12).digest()
            seen[h] = seen.get(h, 0) + 1
    want = {}
    for i, t in base:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 199):
            if seen[hashlib.blake2b(raw[p : p + 200], digest_size=12).digest()] > 1:
                gone[p : p + 200] = True
        want[i] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    df = spark.createDataFrame(base, "doc_id long, text string")
    twice = [base[0], extra[1], extra[1]]  # rows that repeat in all columns
    again = suffix_dedup.dedup(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, len(r.kept)) for r in again) == sorted((i, len(t.encode()) if i == base[0][0] or len(t.encode()) < 200 else 0) for i, t in twice)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(df).collect()}
    assert got == want
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(df, bits=9).collect()}  # ranks that collide all over
    assert got == want
    out = suffix_dedup.dedup(odd).collect()
    assert len(out) == len(ODD) and {(r.doc_id, r.n_removed) for r in out} == {(1, 0), (2, 0), (None, 0), (3, 0), (4, 40_000)}
    assert suffix_dedup.dedup(odd.limit(0)).count() == 0


def test_url_filter(spark):
    events = spark.createDataFrame([("l", "domain", "bad.org", "add", 10), ("l", "domain", "bad.org", "drop", 20), ("l", "domain", "bad.org", "drop", 25), ("l", "word", "casino", "add", 5), ("l", "host", None, "add", 1)], "list string, kind string, key string, event string, at int")
    captures = spark.createDataFrame([("https://a.bad.org/x", 9), ("https://a.bad.org/x", 10), ("https://a.bad.org/x", 19), ("https://a.bad.org/x", 20), ("http://u@ok.com:8/casino?x", 6), (None, 6), ("no url", 6), ("https://a.bad.org/x", 10), ("https://bad.org", None)], "url string, fetched_at int")
    for sent in (100, 0):  # the list sent to all tasks, or joined by salted keys
        got = [(r.url, r.fetched_at, r.blocked) for r in url_filter.apply(captures, events, max_sent=sent).collect()]
        assert sorted((x for x in got if x[2]), key=repr) == [("http://u@ok.com:8/casino?x", 6, True)] + [("https://a.bad.org/x", 10, True)] * 2 + [("https://a.bad.org/x", 19, True)] and len(got) == 9
    assert url_filter.apply(captures, events.limit(0)).where("blocked").count() == 0 and url_filter.apply(captures.limit(0), events).count() == 0


def test_html(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use</div><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>five<aside>side</aside><div class='comments'><p>me too</p></div></article><footer>&copy;</footer>"
    assert html_extract.main_text(page, {}, set())[0] == "A & B one two three four five"
    assert html_extract.main_text(None, {}, set())[0] == "" and html_extract.main_text("<p", {}, set())[0] == ""
    plain = [(i, f"http://h.org/{i}", f"<body><div>Welcome to us</div><div class=x><p>Text {i} of a page.</p></div></body>") for i in range(6)]
    pages = spark.createDataFrame(plain + [(9, None, None), (9, None, None)], "page_id long, url string, html string")
    for sent in (1_000, 0):  # templates sent to all tasks, or joined by host
        got = sorted((r.page_id, r.text) for r in html_extract.extract(pages, max_sent=sent).collect())
        assert got == [(i, f"Text {i} of a page.") for i in range(6)] + [(9, ""), (9, "")]
    assert html_extract.extract(pages.limit(0)).count() == 0
    template = html_extract.templates(html_extract.seen(pages)).where("_host = 'h.org'").first()
    assert len({t["vector"] for t in template["_slots"]}) == 1 and all(t.once for t in template["_slots"]) and len(template["_constant"]) == 1


def test_html_keeps_what_authors_write(spark):
    """Names of boxes that only one author uses, figures and formulas are parts of an article; long pages are whole."""
    inner = "<figure><figcaption>a plot</figcaption></figure><section class='warning'>take care</section><div class='related-work'>others did</div><blockquote class='reply'>said she</blockquote><p>so <math><mi>x</mi></math></p><div class='post login-required'><p>deep</p></div>"
    rows = [(i, f"http://k.org/{i}", f"<body><nav><a href=/>Home</a></nav><article><p>Page {i} has its own words.</p>{inner if i == 3 else ''}<div class=comments><p>Reader {i} says hm</p></div></article></body>") for i in range(12)]
    rows.append((50, "http://k.org/50", "<body><article>" + "<p>words of a long page</p>" * 30_000 + "</article></body>"))
    df = spark.createDataFrame([(*r, "old", 7) for r in rows], "page_id long, url string, html string, TEXT string, slots int")
    out = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert out[3] == "Page 3 has its own words. a plot take care others did said she so x deep" and out[5] == "Page 5 has its own words."
    assert len(out[50]) == 30_000 * len("words of a long page ") - 1


def _by_brute_force(pages):
    """Slots of each host from whole occurrence vectors, kept as tuples over all distinct pages."""
    out = {}
    for h in {html_extract.host(u) for _, u, _ in pages}:
        own = sorted({x or "" for _, u, x in pages if html_extract.host(u) == h})
        rows = [{(t, w): (n, c, k) for t, w, n, c, k in html_extract.tokens(x)} for x in own]
        vectors = {key: tuple(r.get(key, (0, 0, 0))[0] for r in rows) for key in set().union(*rows)}
        held = {key: sum(n > 0 for n in v) for key, v in vectors.items()}
        classes = {}
        for key, v in vectors.items():
            classes.setdefault(v, []).append(key)
        valid = {k for v, keys in classes.items() if sum(n > 0 for n in v) >= 3 and len(keys) >= 2 and max(v) == 1 and any(k[1] is None for k in keys) for k in keys}
        around = lambda path: [path.rsplit(">", i)[0] for i in range(1, path.count(">") + 1)]
        frame = {k[0] for k in valid if k[1] is None and all((p, None) in valid or not p for p in around(k[0]))} | {""}
        boxes = {k for k in vectors if k[1] is None and held[k] >= 3 and (k[0] in frame or k[0].rsplit(">", 1)[0] in frame)}
        fixed = {k for k in valid if k[1] is not None and (k[1], None) in boxes}
        total = lambda key, i: sum(r[key][i] for r in rows if key in r)
        slots = {key[0]: (max(vectors[key]) == 1, *(round((total(key, i) - sum(total(f, i) for f in fixed if f[1] == key[0])) / held[key], 6) for i in (1, 2)), vectors[key]) for key in boxes}
        out[h] = slots, {f[0] for f in fixed}
    return out


def test_html_templates_like_brute_force(spark):
    """Hosts with neutral markup alone: the template decides, and is what whole occurrence vectors give."""
    random.seed(12)
    say = lambda n: " ".join(random.choice("red blue tall wide old new far near".split()) + str(random.randint(0, 999)) for _ in range(n))
    want, rows = {}, []
    for i in range(30):  # a menu, an article in boxes, a note of the site inside it, a short notice that differs, each a bare div
        body = [say(random.randint(8, 40)) for _ in range(random.randint(1, 4))] if i % 3 else [say(2)]
        menu = "".join(f"<a href=/{k}>{say(1)}</a> " for k in range(9))
        rows.append((i, f"http://n.org/{i}", f"<body><div>{menu}</div><div><div><div>{''.join(f'<p>{x}</p>' for x in body)}<p>Join our circle of readers</p></div></div></div><div>{say(9)}</div></body>"))
        want[i] = " ".join(body)
    for i in range(30, 42):  # another layout of that host
        body = say(25)
        rows.append((i, f"http://n.org/{i}", f"<body><table><tr><td>{say(2)}</td><td>{body}</td></tr></table></body>"))
        want[i] = body
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want
    assert sum(html_extract.main_text(h, {}, set())[0] != want[i] for i, _, h in rows) >= 30  # without a template, other text
    rows += [(99, "http://one.org/", "<body><article>alone</article></body>"), (100, None, None)]
    for r in html_extract.templates(html_extract.seen(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect():
        slots, fixed = _by_brute_force(rows)[r["_host"]]
        assert {x.path: (x.once, round(x.chars, 6), round(x.links, 6)) for x in r["_slots"]} == {k: v[:3] for k, v in slots.items()} and set(r["_constant"] or ()) == fixed
        classes = {}
        for x in r["_slots"]:
            classes.setdefault(x["vector"], set()).add(slots[x.path][3])
        assert all(len(v) == 1 for v in classes.values()) and len(classes) == len({v[3] for v in slots.values()})


def test_html_classes_decide(spark):
    """With vectors that tell nothing apart, or everything, no class is valid and other text comes out."""
    story = {i: f"Story {i} is told here at some length" for i in range(9)}
    page = lambda i, own: (i, f"http://n.org/{i}", f"<body><div>{'<a href=/>many words of a menu</a> ' * 3}</div><div><div><p>{own}</p><p>Join our circle</p></div></div><div>Note {i}</div></body>")
    rows = [page(i, own) for i, own in story.items()]
    read = lambda own: {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(own, "page_id long, url string, html string")).collect()}
    assert read(rows) == story
    found = html_extract.seen(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for vector in (F.lit(1).cast("long"), F.xxhash64("token", "within")):
        made = html_extract.templates(found.withColumn("vector", vector)).first()
        assert not made["_constant"]
        slots = {x.path: html_extract.Slot(x.once, x.chars, x.links) for x in made["_slots"]}
        assert all(html_extract.main_text(h, slots, set())[0] != story[i] for i, _, h in rows)
    # a story that some pages print alike, in paragraphs of its own, is no template
    alike = story | {i: "The same story here</p><p>in two parts" for i in range(4)}
    assert read([page(i, own) for i, own in alike.items()]) == story | {i: "The same story here in two parts" for i in range(4)}


def test_html_names_and_hidden(spark):
    names = "comments-area comment-list comment-respond user-reviews ad-slot google-ad-container cookie-bar sidebar-left share-buttons nav-links".split()
    other = "".join(f"<div class='{n}'><p>part of {n}</p></div>" for n in names)
    rows = [(i, f"http://k.org/{i}", f"<body><article><p>Page {i} speaks</p>{other}<div hidden>not seen</div><div HIDDEN=''>nor this</div><div class=hidden>{i} is seen</div><div data-x='hidden'>this {i} too</div></article></body>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Page {i} speaks {i} is seen this {i} too" for i in range(5)}
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want
    assert {i: html_extract.main_text(h, {}, set())[0] for i, _, h in rows} == want


def test_join_of_many_short_texts(spark):
    """40 000 sets of five shingles that share them across: the work must not grow with the square of the sets."""
    random.seed(8)
    rows = [(i, " ".join(random.choice("abcdefghijkl") for _ in range(9))) for i in range(40_000)]
    rows += [(50_000 + i, rows[i][1].upper()) for i in range(500)]
    began = time.perf_counter()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 60  # a few seconds of it are work; the rest is Spark's jobs
    least = {}
    for i, x in rows:
        least.setdefault(tuple(ngram_join.shingles(x).tolist()), i)
    # sets of five link when four are shared of six at most: never, but for equal sets, and chance sets of fewer shingles
    assert all(got[i] == (len(s), least[s]) for i, x in rows if len(s := tuple(ngram_join.shingles(x).tolist())) == 5)


def test_join_of_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(300)]
    near = [" ".join([*words[: 300 - k], *(f"x{i}" for i in range(300 - k, 300))]) for k in (0, 25, 50)]  # 0 links with 25, 25 with 50
    other = " ".join(f"o{i}" for i in range(100))
    rows = [(1, near[0]), (None, near[1]), (3, near[2])] + [(7, other), (7, other + " end"), (7, "quite unlike the texts above it"), (9, other + " end here")]
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "doc_id long, text string").coalesce(1)
        got = sorted(((r.doc_id, r.component_id) for r in ngram_join.join(df).collect()), key=repr)
        assert got == sorted([(1, 1), (None, 1), (3, 1), (7, 7), (7, 7), (7, 7), (9, 7)], key=repr)


def test_html_templates_by_layout(spark):
    note = "<div>Join our circle of readers</div>"
    inside = [(i, f"http://a.org/{i}", f"<body><article><p>Story {i} of the day</p>{note}</article></body>") for i in range(40)]
    rare = [(100 + i, f"http://a.org/r{i}", f"<body><div class=q><div>Sold by us</div><p>Item {i} on sale</p></div></body>") for i in range(3)]
    copies = [(200 + i, f"http://b.org/{i}", "<body><article><p>One story</p><p>in two parts</p></article></body>") for i in range(5)]
    alone = [(300 + i, f"http://c.org/{i}", f"<body><article><p>All the same</p></article><i>{i}</i></body>") for i in range(4)]
    pages = spark.createDataFrame(inside + rare + copies + alone, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == {i: f"Story {i} of the day" for i in range(40)} | {100 + i: f"Item {i} on sale" for i in range(3)} | {200 + i: "One story in two parts" for i in range(5)} | {300 + i: "All the same" for i in range(4)}


def test_webp_round_trip(spark, texts, odd):
    payloads = [x.encode() + b"\0" * (-len(x.encode()) % 64 if x else 64) for x in [*texts.values(), "", "a", "xyz" * 40_000]]
    media = [webp.store(p) for p in payloads]
    assert webp.load(media) == payloads
    for p, m in list(zip(payloads, media))[:6]:
        assert b"".join(webp.decode(f)[:, :, 2].tobytes() for f in webp.files(m)) == p
    repeats = [p for p in payloads if len(webp.references(np.frombuffer(p[: webp.PART], np.uint8)))]
    assert repeats and any(not webp._plain_header(webp.chunk(f)[0]) for m in media for f in webp.files(m))  # some are read back by decode
    assert len(webp.store(b"say it once more, " * 64)) < 150 and webp.load([webp.store(b"ab" * 320)]) == [b"ab" * 320]
    rows = {r.doc_id: r for r in queries()["op9_webp"](spark, SF).collect()}
    for i, x in list(texts.items()):
        raw = x.encode()
        whole = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        m = webp.store(whole)
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
        seen = np.frombuffer(whole, np.uint8).astype(float)
        assert float(r.feature.split(";")[1]) == pytest.approx(seen.mean(), abs=1e-6) and float(r.feature.split(";")[2]) == pytest.approx(seen.std(), abs=1e-6)
    out = webp.from_media(webp.to_media(odd)).collect()
    assert sorted(bytes(r.payload).rstrip(b"\0").decode() for r in out) == sorted(x[1] or "" for x in ODD)
    assert webp.to_media(odd.limit(0)).count() == 0


def _literal(w, pixels):
    """Pixels as literals under codes of two symbols or more."""
    lengths = []
    for k in (8, 16, 0, 24):
        counts = np.bincount(pixels >> k & 255, minlength=280 if k == 8 else 256)
        own = webp.code_lengths(counts)
        lengths.append(webp.canonical(own) if np.count_nonzero(counts) > 1 else {})
        webp.write_lengths(w, own) if lengths[-1] else webp.write_single(w, int(np.flatnonzero(counts)[0]))
    webp.write_single(w, 0)
    for p in pixels.tolist():
        for codes, k in zip(lengths, (8, 16, 0, 24)):
            if codes:
                w.bits(*codes[p >> k & 255])


def test_webp_transforms():
    rng = np.random.default_rng(5)
    width, height, block = 13, 9, 2
    image = rng.integers(0, 2**32, width * height, dtype=np.uint32)
    cells = -(-width >> block) * -(-height >> block)

    def file(kind, extra, body):
        w = webp.Writer()
        for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), (1, 1), (kind, 2)):
            w.bits(v, n)
        extra(w)
        for v in (0, 0, 0):  # no more transforms, no cache, no meta codes
            w.bits(v, 1)
        _literal(w, body)
        return webp.riff(w.done())

    def sub_image(data):
        def write(w):
            w.bits(block - 2, 3)
            w.bits(0, 1)
            _literal(w, data)

        return write

    pixels = lambda m: (lambda a: a[:, 0] << 24 | a[:, 1] << 16 | a[:, 2] << 8 | a[:, 3])(webp.decode(m).reshape(-1, 4).astype(np.uint32))
    modes = (np.arange(cells, dtype=np.uint32) % 14) << 8
    full = image.tolist()
    left = []
    for i, p in webp.each_prediction(width, height, modes, block, full):
        left.append(sum(((full[i] >> k) - (p >> k) & 255) << k for k in (0, 8, 16, 24)))
    assert (pixels(file(0, sub_image(modes), np.array(left, np.uint32))) == image).all()
    elements = rng.integers(0, 2**24, cells, dtype=np.uint32)
    assert (pixels(file(1, sub_image(elements), webp.cross_colour(image, width, elements, block, -1))) == image).all()
    green = image >> 8 & 255
    assert (pixels(file(2, lambda w: None, (image & 0xFF00FF00) | ((image >> 16) - green & 255) << 16 | (image - green & 255))) == image).all()


def test_webp_references_cache_and_palette():
    w = webp.Writer()  # 8 x 2: a palette of two colours packs eight pixels into one
    for v, n in ((0x2F, 8), (7, 14), (1, 14), (0, 1), (0, 3), (1, 1), (3, 2), (1, 8), (0, 1)):
        w.bits(v, n)
    _literal(w, np.array([0xFF000010, 0x00000005], np.uint32))
    for v in (0, 0, 0):
        w.bits(v, 1)
    _literal(w, np.array([0xFF00A500, 0xFF000F00], np.uint32))
    blue = webp.decode(webp.riff(w.done()))[:, :, 3]
    assert blue.tolist() == [[0x15 if 0xA5 >> i & 1 else 0x10 for i in range(8)], [0x15] * 4 + [0x10] * 4]
    w = webp.Writer()  # 6 x 1: two literals, one from the cache, three by a reference one pixel back
    for v, n in ((0x2F, 8), (5, 14), (0, 14), (0, 1), (0, 3), (0, 1), (1, 1), (1, 4), (0, 1)):
        w.bits(v, n)
    first, second = 0xFF000700, 0xFF000900
    slot = (0x1E35A7BD * first & 0xFFFFFFFF) >> 31
    counts = np.zeros(282, int)
    counts[[7, 9, 258, 280 + slot]] = 1
    lengths = webp.code_lengths(counts)
    webp.write_lengths(w, lengths)
    for s in (0, 0, 255, 1):  # distance symbol 1: the pixel to the left
        webp.write_single(w, s)
    codes = webp.canonical(lengths)
    other = (0x1E35A7BD * second & 0xFFFFFFFF) >> 31
    for s in (7, 9, 280 + slot, 258):
        w.bits(*codes[s])
    got = webp.decode(webp.riff(w.done()))[0, :, 2].tolist()
    assert got == [7, 9, *([9] if other == slot else [7]) * 4]


def test_distance_map():
    known = [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3)]
    assert webp.distance_map()[:16] == known and webp.distance_map()[-3:] == [(-7, 7), (8, 6), (8, 7)] and len(webp.distance_map()) == 120


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs.where("doc_id % 4 <> 0"), labels)
    got = toxicity.score(docs.where("doc_id % 4 = 0").drop("toxic"), model).withColumnRenamed("toxic", "called").join(labels, "doc_id").collect()
    base = sum(not r.toxic for r in got) / len(got)  # of documents that the model has not seen
    right = sum(r.called == bool(r.toxic) for r in got) / len(got)
    assert len(got) > 50 and right >= 0.93 > base
    mean = lambda kind: np.mean([r.severity for r in got if bool(r.toxic) == kind])
    assert mean(True) > mean(False) + 0.8 and all(0 <= r.severity <= 3 for r in got)
    for r in got[:40]:  # the score by the formula alone
        eta = model.length_weight * np.log1p(toxicity.features(r.text)[0]) + sum(n * model.weights[model.words[w]] for w, n in toxicity.features(r.text)[1].items() if w in model.words)
        p = [1 / (1 + np.exp(t - eta)) for t in model.thresholds]
        assert abs(r.severity - sum(p)) < 1e-6 and abs(r.p_toxic - p[0]) < 1e-6
    again = toxicity.fit(docs.where("doc_id % 4 <> 0").repartition(5, "text"), labels)
    assert again.words == model.words and np.allclose(again.weights, model.weights)
    empty = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(odd, empty).where("toxic or grade > 0").count() == 0 and toxicity.score(odd.limit(0), model).count() == 0
    clash = spark.createDataFrame([(1, "some text", True, "x")], "doc_id long, text string, TOXIC boolean, severity string")
    assert toxicity.score(clash, model).columns == ["doc_id", "text", "severity", "grade", "p_toxic", "toxic"]


def test_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, 600)
    w, _, theta = toxicity.fit_ordinal(np.arange(600), np.zeros(600, int), x.astype(float), np.zeros(600), np.minimum(x // 2, 3), 1)
    assert w[0] > 0 and (np.diff(theta) > 0).all()


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (1, 1), (5, 4)], "a long, b long")
    assert {(r.node, r.component) for r in components.components(edges).collect()} == {(3, 3), (4, 3), (5, 3), (9, 3), (7, 7), (8, 7)}
    assert components.components(edges.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), docs.schema)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in kept.collect()) and all(r.n_tokens == len(r.token_ids) for r in rows)
    rows_ = [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    odd = spark.createDataFrame(rows_, docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = spark.createDataFrame(stage(spark, odd, SF).collect(), docs.schema)
    assert sorted((r.doc_id for r in odd.collect()), key=repr) == [1, 2, None]


def test_pipeline_of_empty_and_wider_tables(spark):
    import corpus_pipeline

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    empty = spark.createDataFrame([], schema)
    clashes = "toxic string, runs string, Severity string, grade string, component_id string, kept string, removed string, n_bytes string, items string, contaminated string, n_words string, token_ids string, _key string"
    values = [f"v{i}" for i in range(clashes.count(",") + 1)]
    long = "word " * 30_000
    rows = [(1, "one two three", "en", "s", 13, *values), (2, None, "en", "s", 0, *values), (2, None, "en", "s", 0, *values), (3, long, "en", None, len(long), *values)]
    wide = spark.createDataFrame(rows, schema.simpleString()[7:-1].replace(":", " ") + ", " + clashes)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        got = out.collect()
        assert out.schema.simpleString() == wide.schema.simpleString() and all(list(r)[5:] == values for r in got), name
        assert {r.doc_id for r in got} == {1, 2, 3}, name
    out = corpus_pipeline.to_tokens(spark, wide, SF)
    assert dict(out.dtypes)["token_ids"] == "array<int>" and out.where("kept = 'v5' and toxic = 'v0'").count() == 4


def test_pipeline_join_by_text(spark):
    import corpus_pipeline

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    texts = ["one text of seven words in all", "quite another text under the same id", "a third that has an id in one row"]
    rows = [(None, texts[0])] * 3 + [(5, texts[1]), (5, texts[2]), (5, texts[2]), (None, texts[2]), (8, texts[2]), (None, None), (None, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted([(None, texts[0]), (5, texts[1]), (5, texts[2]), (None, None), (None, ""), (6, "")], key=repr)


def test_sql_escapes():
    assert r"'\', '\\'" in OP1_SQL
