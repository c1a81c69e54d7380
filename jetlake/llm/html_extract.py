"""Main text of web pages by wrappers inferred per host.

Pages of a host share a template.  A wrapper describes it as a union-free
expression over nested elements: an element stands once, is optional (?), or
repeats (+), and texts are constant or slots.  Wrappers are inferred by
alignment: two child lists are matched by their longest common subsequence;
equal neighbours fold into a repeated element, elements without partner become
optional, differing texts become slots.  Alignment starts on the pages of a
piece of the input and goes on over the partial wrappers of a host, so that a
host with any share of the pages sends a few small trees.

The wrapper says where the main text of every page of its host is: in the lowest
common element of all text that differs between the pages and of all article
and main elements, whose markup is one more sign.  Each page is matched with the
wrapper child by child along that path.  Within the region everything stays but
constant containers before the first or after the last differing part and, where
the region is the whole body, constant text there (a heading right before it
stays); article and main elements lose nothing.  Only if such elements hold
at least half of a page's region is it narrowed to them.  Equal pages say nothing
about the template, so a host with one distinct text has no constants.  Elements
that are known by name or by class for menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments are left out; an article
or main element so only while it holds less than half of the region.

Defined results: null and empty pages, and pages without main text, give the
empty text; a null or odd url belongs to the host ''; a tag that is cut off at
the end of a page is dropped; unclosed elements end with their parent; nesting
deeper than ``DEPTH`` continues in the element at that depth; repeated rows are
extracted like any other; only page_id, url and html are read.
"""

from __future__ import annotations

import html as references
import json
import re
import zlib
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetlake.llm.common import slices, small, staged

DEPTH = 100

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?=[a-zA-Z/][^<]*\Z)[^<]*\Z", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSED_BY_BLOCK = {"p"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXT = INLINE | HEADINGS | {"p", "ul", "ol", "dl", "li", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "hgroup", "address"}
FRAME, MARKED = {"", "html", "body"}, {"article", "main"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ASIDE = {"nav", "footer", "aside", "form", "head", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video"} | RAW
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie",
               "cookies", "disclaimer", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice",
               "popup", "promo", "promotion", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe",
               "widget", "complementary", "contentinfo"}


@dataclass(slots=True)
class Element:
    tag: str
    words: tuple[str, ...] = ()
    items: list = field(default_factory=list)  # texts and elements in order

    @property
    def key(self) -> str:
        return ".".join((self.tag, *self.words))

    def left_out(self, in_article: bool) -> bool:
        return (self.tag in ASIDE or self.tag == "header" and not in_article
                or self.tag not in ("article", "main", "body", "html") and self.aside)

    @property
    def aside(self) -> bool:
        return not ASIDE_WORDS.isdisjoint(self.words)


def parse(page: str) -> Element:
    """The page's elements; character references are decoded."""
    root = Element("")
    stack, place = [root], 0

    def add_text(text):
        if text:
            stack[-1].items.append(references.unescape(text))

    while place < len(page):
        token = _TOKEN.search(page, place)
        if token is None:
            break
        add_text(page[place:token.start()])
        place = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if token[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == name:
                    del stack[depth:]
                    break
            continue
        if name in SIBLINGS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SIBLINGS[name]:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        elif name not in INLINE:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in CLOSED_BY_BLOCK:
                    del stack[depth:]
                    break
                if stack[depth].tag not in INLINE:
                    break
        words = tuple(w for groups in _NAMED.findall(token[3] or "") for w in _WORD.findall("".join(groups).lower()))
        element = Element(name, words)
        if name in RAW:
            ending = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, place)
            place = ending.end() if ending else len(page)
        stack[-1].items.append(element)
        if name not in VOID and name not in RAW and not (token[3] or "").endswith("/") and len(stack) < DEPTH:
            stack.append(element)
    add_text(page[place:]) if place < len(page) else None
    return root


# Wrappers: [key, mark, text, whole, children]; mark is "", "?" or "+", text is the hash of the element's own text, whole that of all
# text below it that is not left out (of all elements of a "+"); 0 without text, -1 where pages differ.

def _sum(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) + 1 if text else 0


def wrapper_of(element: Element, in_article: bool = False) -> list:
    inside = in_article or element.tag in MARKED
    children = [wrapper_of(item, inside) for item in element.items if isinstance(item, Element)]
    text = _sum(" ".join(" ".join(item for item in element.items if isinstance(item, str)).split()))
    folded = []
    for child in children:
        if folded and folded[-1][0] == child[0]:
            whole = _sum(f"{folded[-1][3]},{child[3]}") if folded[-1][3] or child[3] else 0
            folded[-1] = aligned(folded[-1], child)
            folded[-1][1], folded[-1][3] = "+", whole
        else:
            folded.append(child)
    parts = [] if element.left_out(in_article) else [text, *(child[3] for child in folded)]
    return [element.key, "", text, _sum(",".join(map(str, parts))) if any(parts) else 0, folded]


def common_keys(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of the children's keys."""
    left, right = [x[0] for x in a], [x[0] for x in b]
    if left == right:
        return [(k, k) for k in range(len(left))]
    rows = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            rows[i][j] = rows[i + 1][j + 1] + 1 if left[i] == right[j] else max(rows[i + 1][j], rows[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def aligned(a: list, b: list) -> list:
    """The wrapper of all pages of both; elements must have the same key."""
    children, i, j = [], 0, 0
    optional = lambda node: [node[0], node[1] or "?", node[2], -1 if node[3] else 0, node[4]]
    for m, n in [*common_keys(a[4], b[4]), (len(a[4]), len(b[4]))]:
        children += [optional(x) for x in a[4][i:m]] + [optional(x) for x in b[4][j:n]]
        if m < len(a[4]) and n < len(b[4]):
            children.append(aligned(a[4][m], b[4][n]))
        i, j = m + 1, n + 1
    folded = []
    for child in children:  # neighbours of one kind are one repeated element
        if folded and folded[-1][0] == child[0]:
            whole = -1 if folded[-1][3] or child[3] else 0
            folded[-1] = aligned(folded[-1], child)
            folded[-1][1], folded[-1][3] = "+", whole
        else:
            folded.append(child)
    mark = "+" if "+" in (a[1], b[1]) else a[1] or b[1]
    return [a[0], mark, a[2] if a[2] == b[2] else -1, a[3] if a[3] == b[3] else -1, folded]


def expression(wrapper: list) -> str:
    """The wrapper as a union-free expression."""
    text = "#" if wrapper[2] == -1 else "text" if wrapper[2] else ""
    inner = " ".join([*([text] if text else []), *map(expression, wrapper[4])])
    return f"{wrapper[0]}({inner}){wrapper[1]}"


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _partial(batches):
    """(host, wrapper): one wrapper per host and piece of the input."""
    for batch in slices(batches, 1024):
        found = {}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            one = wrapper_of(parse(page or ""))
            known = found.get(host)
            found[host] = aligned(known, one) if known else one
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(map(json.dumps, found.values())), pa.string())],
                                         names=["host", "wrapper"])


def _merged(table: pa.Table) -> pa.Table:
    order = sorted(table.column("wrapper").to_pylist())
    wrapper = json.loads(order[0])
    for other in order[1:]:
        wrapper = aligned(wrapper, json.loads(other))
    return pa.table({"host": table.column("host").slice(0, 1), "wrapper": [json.dumps(wrapper)]})


def wrappers(pages: DataFrame, fan_in: int = 64) -> DataFrame:
    """(host, wrapper) of every host; partial wrappers meet in two steps so that no host fills a task."""
    schema = "host string, wrapper string"
    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    partial = rows.mapInArrow(_partial, schema)
    groups = partial.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(fan_in)))
    once = groups.groupBy("host", "part").applyInArrow(lambda table: _merged(table), schema)
    return once.groupBy("host").applyInArrow(_merged, schema)


def _split(key: str) -> Element:
    tag, *words = key.split(".")
    return Element(tag, tuple(words))


def _marked(node: list) -> bool:
    """Whether article or main elements with text are there."""
    element = _split(node[0])
    return bool(node[3]) and (element.tag in MARKED and not element.aside or any(map(_marked, node[4])))


def region(wrapper: list) -> tuple[list[list], set[int]]:
    """Nodes from the root to the lowest common element of differing text and marked elements, and places of its children that are template."""
    known = wrapper[3] == -1  # pages with different text have been seen
    differs = lambda node: node[3] == -1 if known else bool(node[3])
    path = [wrapper]
    while True:
        node = path[-1]
        telling = [k for k, c in enumerate(node[4]) if differs(c) or _marked(c)]
        own = node[2] == -1 if known else bool(node[2])
        tag = _split(node[0]).tag
        if tag in MARKED or own or len(telling) != 1:
            break
        below = node[4][telling[0]]
        if below[1] == "+" or _split(below[0]).tag in TEXT:
            break
        path.append(below)
    if tag in MARKED or not known or not telling:
        return path, set()
    outside = [k for k in range(len(node[4])) if not telling[0] <= k <= telling[-1]]
    tags = [_split(c[0]).tag for c in node[4]]
    before = telling[0]
    while before and tags[before - 1] in HEADINGS:
        before -= 1
    return path, {k for k in outside if tags[k] not in TEXT or tag in FRAME and not before <= k < telling[0]}


def _matched(element: Element, node: list) -> dict[int, list[Element]]:
    """The element's children by their place among those of its wrapper."""
    runs = [(key, list(run)) for key, run in groupby((i for i in element.items if isinstance(i, Element)), key=lambda i: i.key)]
    return {place: runs[k][1] for k, place in common_keys(runs, node[4])}


def _along(element: Element, path: list[list]) -> Element | None:
    for node, below in zip(path, path[1:]):
        place = next(k for k, c in enumerate(node[4]) if c is below)
        hit = _matched(element, node).get(place)
        if hit is None:
            return None
        element = hit[0]
    return element


def _outermost(element: Element, taken) -> list[Element]:
    """Outermost marked elements that ``taken`` accepts, in page order."""
    if element.tag in MARKED and taken(element):
        return [element]
    return [hit for item in element.items if isinstance(item, Element) and not item.left_out(True) and not (item.tag in MARKED and item.aside)
            for hit in _outermost(item, taken)]


def _blocks(element: Element, in_article: bool, out: list[list[str]], asides: bool = False):
    """Texts of blocks in order; marked elements that are known by class for something else stay only with ``asides``."""
    for item in element.items:
        if isinstance(item, str):
            out[-1].append(item)
        elif item.tag == "br":
            out[-1].append(" ")
        elif not item.left_out(in_article) and (asides or not (item.tag in MARKED and item.aside)):
            block = item.tag not in INLINE
            if block:
                out.append([])
            _blocks(item, in_article or item.tag in MARKED, out, asides)
            if block:
                out.append([])


def _texts(elements: list[Element], in_article: bool, asides: bool = False) -> list[str]:
    blocks: list[list[str]] = [[]]
    for element in elements:
        _blocks(element, in_article or element.tag in MARKED, blocks, asides)
        blocks.append([])
    return [text for block in blocks if (text := " ".join("".join(block).split()))]


def _size(texts: list[str]) -> int:
    return sum(map(len, texts))


def main_text(page: str, chosen: tuple[list[list], set[int]] | None) -> str:
    root = parse(page)
    path, template = chosen or ([], set())
    element = _along(root, path)
    if element is None:  # a page without the host's region
        element, template = root, set()
    if template:
        gone = {id(i) for place, run in _matched(element, path[-1]).items() if place in template for i in run}
        element = Element(element.tag, element.words, [i for i in element.items if id(i) not in gone])
    inside = any(_split(node[0]).tag in MARKED for node in path)
    whole = _texts([element], inside, True)
    plain = _texts([element], inside)
    if 2 * _size(plain) <= _size(whole):  # most of it stands in such elements: their class says nothing here
        return "\n".join(whole)
    for tag in ("article", "main"):
        marked = _texts(_outermost(element, lambda e: e.tag == tag and (e is element or not e.aside)), inside)
        if 2 * _size(marked) >= _size(plain):
            return "\n".join(marked)
    return "\n".join(plain)


def _extracted(batches):
    known: dict[str, tuple | None] = {}
    for batch in slices(batches, 256):
        texts = []
        for host, page, wrapper in zip(*(batch.column(n).to_pylist() for n in ("host", "html", "wrapper"))):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = region(json.loads(wrapper)) if wrapper else None
            texts.append(main_text(page or "", known[host]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = staged(wrappers(pages), "wrappers")
    rows = pages.withColumn("host", host_of(F.col("url"))).join(small(found, 100_000), "host", "left")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
