"""Main-text extraction with templates deduced from equivalence classes.

Pages of a host share templates. The tokens of a page are its container elements, each with its place in the nesting, its
class and id and, for boxes, its number among its like; and its texts. Tokens with the same occurrence vector over the
host's distinct pages form an equivalence class; here a vector is a sum (exclusive or) of hashes of page and count, so that
it is aggregated before and after a shuffle and no task ever holds the pages of a host. A class is valid if it has two tokens at
least, a container among them, on PAGES pages or more, and each token once on each of these, so that they have one order. It is
nested if every container around its own stands in a valid class too. The containers of valid nested classes are the frame of
the host's template; what stands directly in a frame's container, once or often, is a slot. The template decides on each page:

- A text of a valid class, inside a slot, is the template's own and goes. Texts that repeat without a container, as copies of an
  article do, are in no valid class. The template knows how much other text each slot holds on average, and how much is links.
- The slots of the main text are those inside the innermost box of the template that holds half of all slot text. An article
  or main element of the template goes before, from a tenth on, or if all of its text is the template's.
- Of these, boxes that the template makes and that hold mostly links go, as do those that it makes and names for what is no
  part of an article (OTHER_NAMES). A box that is not of the template is its author's, whatever its name, and stays.

Markup that says what it is (menus, headers, footers, asides, forms, scripts; hidden elements) is left out everywhere. Pages
with tokens that are not in the template, and pages of hosts with fewer than PAGES pages, are judged by their own tokens.

Defined cases: null html has no text; markup that is cut off ends with the page; a null or malformed URL has the empty
host, whose pages share a template; a repeated row counts once for the template and gives a repeated result; clashing columns
are replaced; an article of template text alone is kept; an empty table gives an empty table; texts of any length are whole.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexum.llm.common import cut, schema_with, slices, with_columns

#: A class belongs to a template from so many pages on.
PAGES = 3
#: Shares of the slot text from which a box, and an article element, holds the main text; of links from which it is a menu.
HALF, TENTH, MENU = 0.5, 0.1, 0.5
#: Templates of at most so many tokens in all are sent to every task; else they are joined by host.
MAX_SENT = 50_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|object|textarea|title|select|audio|video|canvas)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: The attribute hidden, with or without a value, in what is left of attributes without their values.
VALUE, HIDDEN = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""), re.compile(r"(?<![^\s/])hidden(?![^\s/>])", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORDS = re.compile(r"[a-z]+")
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the first kind ends an open one of the second, if no element of the third stands between.
CLOSES = {"p": ({"p"}, set()), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
MAIN_TAGS = {"article", "main"}
#: Elements that are numbered among their like, and that may hold the main text beside MAIN_TAGS.
BOXES = set("div section table tr td center".split())
OTHER_TAGS = set("nav header footer aside form button select menu dialog head script style noscript template fieldset".split())
#: Names (a class or id, or any part of it) of boxes that hold no part of an article, if the template makes them.
OTHER_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header login menu modal nav navbar"
    " navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion promotions related replies respond review reviews share sharing sidebar signup social sponsor"
    " sponsored subscribe subscription toolbar widget widgets".split()
)


class Element(NamedTuple):
    tag: str
    path: str
    parent: Element | None
    other: bool
    named: bool


class Block(NamedTuple):
    within: Element
    text: str
    linked: int


class Slot(NamedTuple):
    """What a template knows of a container: whether it stands once on a page, and its own slot text and links on average."""

    once: bool
    chars: float
    links: float


PAGE = Element("", "", None, False, False)


def _element(parent: Element, tag: str, attrs: str, number: Counter) -> Element:
    named = hidden = False
    label = tag
    if "=" in attrs:
        for name, a, b, c in ATTRIBUTE.findall(attrs):
            value = (a or b or c).lower()
            if name.lower() == "aria-hidden":
                hidden |= value == "true"
                continue
            words = WORDS.findall(value)
            label += "." + "-".join(words)
            named |= not OTHER_NAMES.isdisjoint(words)
    if "hidden" in attrs.lower():
        hidden |= bool(HIDDEN.search(VALUE.sub(" ", attrs)))
    path = f"{parent.path}>{label}"
    if tag in BOXES:
        number[path] += 1
        if number[path] > 1:
            path += f"[{number[path]}]"
    return Element(tag, path, parent, hidden or tag in OTHER_TAGS or parent.other, named and tag not in MAIN_TAGS and tag not in ("html", "body"))


def blocks(page: str | None) -> tuple[list[Block], list[Element]]:
    """The texts of a page's blocks in page order, and its container elements."""
    stack: list[Element] = [PAGE]
    numbers: list[Counter] = [Counter()]
    out: list[Block] = []
    elements: list[Element] = []
    text: list[str] = []
    linked = in_link = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(references.unescape("".join(text)).split())
            if joined:
                out.append(Block(stack[-1], joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def close(to: int) -> None:
        del stack[to:], numbers[to:]

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            linked += m.start() - at if in_link else 0
        at = m.end()
        tag = (m["tag"] or m["raw"] or "").lower()
        if not tag or m["raw"]:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m["end"] else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        ends, within = CLOSES.get(tag, ({"p"}, set()))
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                close(i)
                break
            if stack[i].tag in within or not within:
                break
        stack.append(_element(stack[-1], tag, m["attrs"] or "", numbers[-1]))
        numbers.append(Counter())
        elements.append(stack[-1])
    if at < len(page):
        text.append(page[at:])
    flush()
    return out, elements


def host(url: str | None) -> str:
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def text_token(b: Block) -> str:
    return f"{b.within.path}#{xxhash.xxh3_64_hexdigest(b.text)}"


def tokens(page: str | None) -> list[tuple[str, str | None, int, int, int]]:
    """A page's tokens in order, each once: paths of containers and, by hash, texts; with the path that a text stands in, how
    often the token stands on the page, the text that it holds itself, and that text's links."""
    found, elements = blocks(page)
    own: dict[tuple[str, str | None], list[int]] = {("", None): [1, 0, 0]}
    for e in elements:
        own.setdefault((e.path, None), [0, 0, 0])[0] += 1
    for b in found:
        inside = own[b.within.path, None]
        one = own.setdefault((text_token(b), b.within.path), [0, 0, 0])
        one[0] += 1
        for x in (inside, one):
            x[1] += len(b.text)
            x[2] += b.linked
    return [(*k, *v) for k, v in own.items()]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def seen(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, token, within, vector, pages (distinct by html) and on each page: most (how often at most), and in sum chars,
    links. Token '' is the page itself. Texts on fewer than three pages are left out."""
    kind = pa.list_(pa.struct([("token", pa.string()), ("within", pa.string()), ("vector", pa.int64()), ("n", pa.int32()), ("chars", pa.int64()), ("links", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "h", 4 << 20):
            rows: list[tuple] = []
            for u, h in zip(batch.column("u").to_pylist(), batch.column("h").to_pylist()):
                page = xxhash.xxh3_64_intdigest(h or "")
                rows.append((host(u), _signed(page), [
                    {"token": t, "within": w, "vector": _signed(xxhash.xxh3_64_intdigest(f"{n}", seed=page)), "n": n, "chars": c, "links": k}
                    for t, w, n, c, k in tokens(h)
                ]))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], kind)], names=["host", "page", "tokens"])

    each = "array<struct<token string, within string, vector long, n int, chars long, links long>>"
    return (
        pages.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInArrow(run, f"host string, page long, tokens {each}")
        .groupBy("host", "page").agg(F.first("tokens").alias("tokens")).select("host", F.inline("tokens"))
        .groupBy("host", "token", "within").agg(
            F.bit_xor("vector").alias("vector"), F.count("*").alias("pages"), F.max("n").alias("most"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
        .where("within is null or pages >= 3")
    )


def templates(found: DataFrame) -> DataFrame:
    """From seen(): _host, _slots (path, once, chars, links, vector: its class) and _constant (text tokens of the template)."""
    often = found.where(f"pages >= {PAGES}")
    alike = often.groupBy("host", "vector", "pages").agg(F.count("*").alias("size"), F.count_if(F.col("within").isNull()).alias("boxes"), F.max("most").alias("most"))
    valid = often.drop("most").join(alike.where("size >= 2 and boxes >= 1 and most = 1"), ["host", "vector", "pages"])
    boxes = valid.where("within is null and token <> ''").select("host", "token").unionByName(often.where("token = '' and within is null").select("host", "token"))
    parts = F.split("token", ">")
    around = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), ">"))
    outer = boxes.where("token <> ''").select("host", "token", F.size(around).alias("depth"), F.explode(around).alias("outer"))
    known = outer.join(boxes.select("host", F.col("token").alias("outer")), ["host", "outer"]).groupBy("host", "token", "depth").agg(F.count("*").alias("n"))
    frame = known.where("n = depth").select("host", "token").unionByName(boxes.where("token = ''"))
    parent = F.when(F.col("token") != "", F.regexp_replace("token", ">[^>]*$", ""))
    boxed = often.where("within is null").withColumn("parent", parent)
    inside = boxed.join(frame.select("host", F.col("token").alias("parent")), ["host", "parent"], "left_semi").select("host", "token")
    slots = boxed.join(inside.unionByName(frame).distinct(), ["host", "token"], "left_semi")
    fixed = valid.where("within is not null").join(slots.select("host", F.col("token").alias("within")), ["host", "within"], "left_semi")
    less = fixed.groupBy("host", F.col("within").alias("token")).agg(F.sum("chars").alias("fixed"), F.sum("links").alias("fixed_links"))
    per_page = lambda whole, part: (F.col(whole) - F.coalesce(part, F.lit(0))) / F.col("pages")
    slot = F.struct(F.col("token").alias("path"), (F.col("most") == 1).alias("once"), per_page("chars", "fixed").alias("chars"), per_page("links", "fixed_links").alias("links"), "vector")
    known_slots = slots.join(less, ["host", "token"], "left").groupBy("host").agg(F.collect_list(slot).alias("_slots"))
    constant = fixed.groupBy("host").agg(F.collect_list("token").alias("_constant"))
    return known_slots.join(constant, "host", "full").withColumnRenamed("host", "_host")


def region(found: list[Block], elements: list[Element], slots: dict[str, Slot], constant: set[str]) -> str:
    """The path of the box that holds the main text."""
    times = Counter(e.path for e in elements)
    own: dict[str, float] = {}
    inside: dict[str, Element] = {}
    for b in found:
        if b.within.other:
            continue
        inside[b.within.path] = b.within
        if b.within.path in slots:
            own[b.within.path] = max(0.0, slots[b.within.path].chars - slots[b.within.path].links)
        else:
            own[b.within.path] = own.get(b.within.path, 0.0) + (0 if text_token(b) in constant else len(b.text) - b.linked)
    mass: dict[str, float] = {}
    for path, chars in own.items():
        e: Element | None = inside[path]
        while e:
            mass[e.path] = mass.get(e.path, 0.0) + chars
            e = e.parent
    total = mass.get("", 0.0)
    boxes = [e for e in elements if not e.other and (slots[e.path].once if e.path in slots else times[e.path] == 1)]
    least = TENTH * total if slots else 0.0
    for kind, share in ((MAIN_TAGS, least), (BOXES | {"body"}, HALF * total)):
        held = [e for e in boxes if e.tag in kind and e.path in mass and (mass[e.path] >= share or kind is MAIN_TAGS and not mass[e.path])]
        if held:
            return max(held, key=lambda e: (e.path.count(">"), mass[e.path])).path
    return ""


def main_text(page: str | None, slots: dict[str, Slot], constant: set[str]) -> tuple[str, list[str]]:
    """The main text, and the paths of the slots that gave it."""
    found, elements = blocks(page)
    top = region(found, elements, slots, constant)

    def dropped(e: Element | None) -> bool:
        while e and e.path != top:
            slot = slots.get(e.path)
            if e.named and (slot or not slots) or slot and slot.once and e.tag in BOXES and slot.links > MENU * slot.chars > 0:
                return True
            e = e.parent
        return e is None

    gone: dict[str, bool] = {}
    kept = []
    for b in found:
        path = b.within.path
        if path not in gone:
            gone[path] = b.within.other or dropped(b.within)
        if not gone[path]:
            kept.append(b)
    kept = [b for b in kept if text_token(b) not in constant] or kept
    return " ".join(b.text for b in kept), list(dict.fromkeys(b.within.path for b in kept))


def extract(pages: DataFrame, url: str = "url", html: str = "html", max_sent: int = MAX_SENT) -> DataFrame:
    """pages with text (main text) and slots (the paths it stood in)."""
    of_host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    made = cut(templates(cut(seen(pages, url, html))))
    small = (made.agg(F.sum(F.size("_slots") + F.coalesce(F.size("_constant"), F.lit(0)))).first()[0] or 0) <= max_sent
    joined = pages.withColumn("_host", of_host).join(F.broadcast(made) if small else made, "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[dict[str, Slot], set[str]]] = {}
        for batch in slices(batches, html, 4 << 20):
            hosts = batch.column("_host").to_pylist()
            got = []
            for i, (name, page) in enumerate(zip(hosts, batch.column(html).to_pylist())):
                if name not in known:
                    if len(known) > 1_000:
                        known.clear()
                    known[name] = ({x["path"]: Slot(x["once"], x["chars"], x["links"]) for x in batch.column("_slots")[i].as_py() or ()}, set(batch.column("_constant")[i].as_py() or ()))
                got.append(main_text(page, *known[name]))
            yield with_columns(batch.drop_columns(["_host", "_slots", "_constant"]), {"text": pa.array([t for t, _ in got], pa.string()), "slots": pa.array([s for _, s in got], pa.list_(pa.string()))})

    return joined.mapInArrow(run, schema_with(pages, "text string, slots array<string>"))
