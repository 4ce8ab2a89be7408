"""HTML extraction by equivalence classes of template tokens.

A page is a sequence of tokens: element starts and blocks of text, each under its path of elements. A token's occurrence
vector over the distinct pages of a host is kept as an exclusive-or of page marks and counts, so that equal vectors have
equal digests and any number of pages of a host is summed up in parts. Tokens of a host with the same vector and enough
support form an equivalence class; a class is valid if it is large enough and its counts are the same on every page.

Valid classes nest into the host's template: an element start belongs to it on a page if all elements around it do, down to
``DEPTH`` levels, and if it stands in the template's order there. The deepest template element around a block is the block's
slot. Constant texts of the classes are boilerplate. Over the host's pages each slot has a mass of text and of text in links;
slots that are mostly links are menus, whatever their names. The rest is extracted: all slots of the host, or, where slots
inside article and main elements hold at least half of that mass, those. Elements that by name or class hold menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or reader comments are no slots.

A host's template is a few hundred tokens whatever its number of pages. Pages are joined with their host's template; Spark
broadcasts the templates if they are small, else deals both by host, and splits a host of very many pages.

Defined results: null html gives an empty text; a null or odd url counts as host ""; pages of equal html count once for
the template; a page whose host shows no template (fewer than ``LEAST_PAGES`` distinct pages) is judged by its own slots, which are
its containers; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialise, release

SUPPORT, LEAST_PAGES, LEAST_CLASS, CONSTANT_PAGES, LINKS = 0.5, 3, 3, 5, 0.5
DEPTH = 64
TOKENS = "host string, kind int, token long, count long, rank double, mark long, linked long, path string"
TEXTS = "page_id long, url string, text string"
TAG, TEXT, SLOT, PAGE = range(4)

PATTERN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|title|object)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<attributes>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>""", re.DOTALL | re.IGNORECASE)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption ul ol dl table tbody thead tfoot figure".split())
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "tr": frozenset({"tr", "td", "th"}), "option": frozenset({"option"})}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BOUNDS = frozenset("ul ol dl table div section article main body aside nav td th".split())
ASIDE = frozenset("nav header footer aside form button menu dialog head fieldset".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription sidebar side rail "
    "widget nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot comment comments reply replies discussion disqus respond share sharing social related recommended recommendations pagination "
    "pager login signin signup search toolbar alert disclaimer complementary contentinfo".split()
)
CONTENT = frozenset({"article", "main"})


def key(*parts: str) -> int:
    return int.from_bytes(blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Node:
    """An open element: a digest of its path, and what its place says about text in it."""

    __slots__ = ("aside", "article", "container", "digest", "name", "path")

    def __init__(self, parent: Node | None, name: str, label: str, aside: bool):
        self.name = name
        self.digest = key(str(parent.digest) if parent else "", label)
        self.aside = aside or (parent is not None and parent.aside)
        self.article = name in CONTENT or (parent is not None and parent.article)
        self.container = parent.container if parent and name in PARTS else self  # without paragraphs, lists and tables at the end
        above = parent.path if parent else ()
        self.path = (*above, self.digest) if parent and len(above) < DEPTH else above


class Page:
    """Elements and blocks (node, text, letters in links) of a page, in page order."""

    def __init__(self, html: str):
        self.elements: list[Node] = []
        self.blocks: list[tuple[Node, str, int]] = []
        self.stack = [Node(None, "", "", False)]
        self.names: Counter[str] = Counter()
        self.open: list[str] = []
        self.links = self.linked = 0
        at = 0
        for m in PATTERN.finditer(html):
            if m.start() > at:
                self.open.append(html[at : m.start()])
                self.linked += len(self.open[-1]) if self.links else 0
            at = m.end()
            if m["name"]:
                self.tag(m["name"].lower(), bool(m["end"]), m["attributes"])
        self.open.append(html[at:])
        self.flush()

    def flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.open)).split())
        if text:
            self.blocks.append((self.stack[-1], text, min(self.linked, len(text))))
        self.open, self.linked = [], 0

    def close(self, depth: int) -> None:
        self.flush()
        self.names.subtract(x.name for x in self.stack[depth:])
        del self.stack[depth:]

    def tag(self, name: str, end: bool, attributes: str) -> None:
        if name in INLINE:
            self.links = (0 if end else 1) if name == "a" else self.links
            return
        if name in VOID:
            self.flush()
            return
        if end:
            if self.names[name] > 0:
                self.close(next(depth for depth in range(len(self.stack) - 1, 0, -1) if self.stack[depth].name == name))
            self.flush()
            return
        ends = CLOSES.get(name, frozenset()) | (frozenset({"p"}) if name in CLOSES_P else frozenset())
        if any(self.names[x] > 0 for x in ends):
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth].name in ends:
                    self.close(depth)
                    break
                if self.stack[depth].name in BOUNDS:
                    break
        self.flush()
        if name == "body" and self.stack[-1].name == "head":
            self.close(len(self.stack) - 1)
        words = sorted({w for m in NAMED.finditer(attributes) for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()) if w})
        aside = name in ASIDE or (name not in CONTENT and name not in ("body", "html") and not ASIDE_NAMES.isdisjoint(words))
        self.stack.append(Node(self.stack[-1], name, ".".join((name, *words)), aside))
        self.names[name] += 1
        self.elements.append(self.stack[-1])


def text_key(node: Node, text: str) -> int:
    return key("T", str(node.digest), text)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def page_tokens(page: Page) -> Iterator[tuple[int, int, int, float, int, str | None]]:
    """(kind, token, count, rank, letters in links, path) of the distinct tokens of a page; a slot's count is its letters."""
    found: dict[tuple[int, int], list[float]] = {}
    paths: dict[int, str] = {}
    order = 0
    for node in page.elements:
        order += 1
        found.setdefault((TAG, node.digest), [0, order, 0])[0] += 1
    for node, text, _ in page.blocks:
        order += 1
        found.setdefault((TEXT, text_key(node, text)), [0, order, 0])[0] += 1
    for node, text, linked in page.blocks:
        if not node.aside:
            own = found.setdefault((SLOT, node.container.digest), [0, order, 0])
            own[0] += len(text)
            own[2] += linked
            paths[node.container.digest] = ("article," if node.article else ",") + ",".join(map(str, node.container.path))
    found[PAGE, 0] = [1, 0, 0]
    for (kind, token), (count, rank, linked) in found.items():
        yield kind, token, int(count), rank, int(linked), paths[token] if kind == SLOT else None


def tokens(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host = host_of(url)
                mark = key("P", html or "")
                rows += [(host, kind, token, count, rank, key("M", str(mark), str(count)), linked, path) for kind, token, count, rank, linked, path in page_tokens(Page(html or ""))]
                if len(rows) > 20_000:
                    yield to_batch(rows)
                    rows = []
            if rows:
                yield to_batch(rows)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "kind", "token", "count", "rank", "mark", "linked", "path"])

    return pages.mapInArrow(run, TOKENS)


def templates(pages: DataFrame) -> DataFrame:
    """(host, tags, texts, menus, article): each host's template elements in their order and constant texts, the slots that are
    mostly links, and whether article and main elements hold the text."""
    found = tokens(pages.select("url", "html").filter("html is not null"))
    # a mark stands for a page's content and the token's count, so that equal pages of a host count once
    once = found.groupBy("host", "kind", "token", "path", "mark").agg(F.max("count").alias("count"), F.max("rank").alias("rank"), F.max("linked").alias("linked"))
    token = once.groupBy("host", "kind", "token", "path").agg(
        F.count("*").alias("pages"), F.bit_xor("mark").alias("vector"), F.min("count").alias("least"), F.max("count").alias("most"), F.sum("count").alias("total"), F.avg("rank").alias("rank"), F.sum("linked").alias("linked")
    )
    token = materialise(token.filter("pages > 1 or kind > 1"), "tokens")
    size = materialise(token.filter(f"kind = {PAGE}").select("host", F.col("pages").alias("n")), "hosts")
    common = token.filter(f"kind < {SLOT}").join(size, "host").filter((F.col("pages") >= SUPPORT * F.col("n")) & (F.col("n") >= LEAST_PAGES))
    classes = common.groupBy("host", "vector").agg(F.count("*").alias("m"), F.min(F.col("least") == F.col("most")).alias("steady"))
    valid = common.join(classes.filter((F.col("m") >= LEAST_CLASS) & F.col("steady")), ["host", "vector"])
    lists = valid.groupBy("host").agg(
        F.transform(F.sort_array(F.collect_set(F.when(F.col("kind") == TAG, F.struct("rank", "token")))), lambda x: x["token"]).alias("tags"),
        F.sort_array(F.collect_set(F.when((F.col("kind") == TEXT) & (F.col("n") >= CONSTANT_PAGES) & (F.col("pages") >= 0.9 * F.col("n")), F.col("token")))).alias("texts"),
    )
    lists = materialise(lists, "classes")
    parts = F.split("path", ",")
    around = F.filter(F.slice(parts, 2, F.size(parts)).try_cast("array<bigint>"), lambda x: F.array_contains("tags", x))
    places = token.filter(f"kind = {SLOT}").join(lists.select("host", "tags"), "host").withColumn("slot", F.coalesce(F.try_element_at(around, F.lit(-1)), F.lit(0)))
    slots = places.groupBy("host", "slot", (parts[0] == "article").alias("article")).agg(F.sum("total").alias("mass"), F.sum("linked").alias("linked"))
    menu = F.col("linked") > LINKS * F.col("mass")
    whole, inside = F.sum(F.when(~menu, F.col("mass"))), F.sum(F.when(~menu & F.col("article"), F.col("mass")))
    menus = slots.groupBy("host").agg(F.collect_set(F.when(menu, F.col("slot"))).alias("menus"), F.coalesce(2 * inside >= whole, F.lit(False)).alias("article"))
    out = materialise(lists.join(menus, "host", "left"), "templates")
    release(token, size, lists)
    return out


def page_template(page: Page, tags: list[int]) -> set[int]:
    """The template elements of a page: those that stand in the order of ``tags`` on it."""
    order = {digest: k for k, digest in enumerate(tags)}
    furthest, seen, out = -1, set(), set()
    for node in page.elements:
        if (place := order.get(node.digest)) is not None and node.digest not in seen:
            seen.add(node.digest)
            if place > furthest:
                furthest = place
                out.add(node.digest)
    return out


def slot_of(node: Node, template: set[int]) -> int:
    """The deepest of the elements around a block that with all around it belong to the template; 0 if none does."""
    slot = 0
    for digest in node.container.path:
        if digest not in template:
            break
        slot = digest
    return slot


def main_text(page: Page, tags: list[int] | None = None, texts: frozenset[int] = frozenset(), menus: frozenset[int] = frozenset(), article: bool = False) -> str:
    """The blocks of the main slots, joined by a space. Without ``tags`` the page's own containers are its slots."""
    blocks = [x for x in page.blocks if not x[0].aside]
    if tags is None:
        slots = [node.container.digest for node, *_ in blocks]
        mass: dict[int, list[int]] = {}
        for slot, (_, text, linked) in zip(slots, blocks):
            own = mass.setdefault(slot, [0, 0])
            own[0] += len(text)
            own[1] += linked
        menus = frozenset(slot for slot, (total, linked) in mass.items() if linked > LINKS * total)
        whole = [(len(text), node.article) for slot, (node, text, _) in zip(slots, blocks) if slot not in menus]
        article = 2 * sum(size for size, inside in whole if inside) >= sum(size for size, _ in whole)
    else:
        template = page_template(page, tags)
        slots = [slot_of(node, template) for node, *_ in blocks]
    kept = [(node, text) for slot, (node, text, _) in zip(slots, blocks) if slot not in menus and not (texts and text_key(node, text) in texts)]
    if article and any(node.article for node, *_ in blocks):
        kept = [x for x in kept if x[0].article]
    return " ".join(text for _, text in kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    template = templates(pages)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    columns = ("tags", "texts", "menus", "article")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for html, tags, texts, menus, article in zip(*(batch.column(c).to_pylist() for c in ("html", *columns))):
                out.append(main_text(Page(html), tags or None, frozenset(texts or ()), frozenset(menus or ()), bool(article)) if html else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    joined = pages.withColumn("host", host).join(template, "host", "left")
    return joined.select("page_id", "url", "html", *columns).mapInArrow(run, TEXTS)
