"""Main text of web pages by template deduction from equivalence classes of tokens.

A page is a row of tokens: tags with their place (the tags around them) and class,
and texts. Tokens with the same occurrence vector over the pages of a host (as
often on every page) form an equivalence class; a class of many tokens on many
pages is template. Vectors are never gathered: a sum of hashes of (page, count)
names a vector, so one aggregation over all pages finds all classes, and the
largest host costs no more than its share.

1. Per page: each open token with its number, its place among the others and the tag
   around it. Pages of a host with equal text in the main region count once.
2. Per host and token: pages, and the name of its vector.
3. Per host: classes with wording on enough pages. A class with tags of its own needs
   few pages (a layout, an optional notice); its wording must lie inside such a tag.
   Without one it must stand on most pages of the host.
4. Per page and class: order and nesting of its tokens, and the text in slots. A class
   is valid if the form is the same on all of its pages and they differ enough.
5. Per page: closed regions are navigation, headers, footers, asides, forms, notices,
   adverts and reader comments (by tag, role or class). Of the page's main region
   (``article``, else ``main``, whichever holds most of the text, else the body) all is
   text that is neither closed nor wording of a valid class.

Rows: null html gives an empty text, a null url the host ''. Null ids are kept.
Equal rows stay rows of their own. Unclosed and crossed tags are tolerated. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, batch, ship

MIN_PAGES = 8        # distinct pages of a host below which it has no template of its whole
MIN_SHARE = 0.9      # share of a host's distinct pages on which that must stand
MIN_SUPPORT = 4      # distinct pages on which a class with tags of its own must stand,
SUPPORT = 0.05       # and their share of the host's
MIN_SLOT = 0.2       # share of the text on a class's pages that must vary: with less, they are near copies of one another

# Elements of HTML and the words by which sites name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object select option textarea button canvas video audio datalist".split())
CLOSED = frozenset("nav header footer aside menu dialog".split())  # and form, unless it holds most of the page
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
CLOSED_NAMES = re.compile(
    r"ads?|adverts?|advert\w*|advertisement|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|"
    r"aside|widgets?|footer|foot|header|masthead|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|subscription|signup|login|"
    r"share|sharing|social|related|recommend\w*|comments?|commentlist|discussion|replies|reply|disqus|responses|pagination|pager|toolbar|"
    r"skip|hidden|copyright|legal|disclaimer", re.I)
# Words that may stand beside those in a name of the same meaning (site-footer, comments-list); any other word ("no-sidebar") makes it another name.
NAME_PARTS = re.compile(
    r"site|main|page|global|primary|secondary|top|bottom|left|right|wrap|wrapper|container|inner|outer|box|block|area|bar|section|list|links?|"
    r"items?|icons?|buttons?|slot|unit|form|policy|message|alert|posts?|articles?|stories|user|reader|search|sticky|fixed|[0-9]*", re.I)
_PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe")


def _attributes(text: str) -> dict[str, str]:
    return {n.lower(): html.unescape(v.strip("\"'")) for n, v in _ATTRIBUTE.findall(text)}


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """('open' | 'close' | 'text', name or text, attributes) in page order; comments and what is no markup for readers drop out."""
    at = 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], {}
            return
        if lt > at:
            yield "text", page[at:lt], {}
        m = _TOKEN.match(page, lt)
        if m is None:  # a lone "<" is text
            yield "text", "<", {}
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, {}
            continue
        yield "open", name, _attributes(m[3]) if m[3].strip() else {}
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "close", name, {}


def _is_closed(name: str, attributes: dict[str, str]) -> bool:
    if name in CLOSED or name in SILENT:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in CLOSED_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if name in ("html", "body", "article", "main"):
        return False
    return any(map(_is_closed_name, f"{attributes.get('class', '')} {attributes.get('id', '')}".split()))


def _is_closed_name(name: str) -> bool:
    """A whole name whose words say that it is no article text."""
    parts = re.split("[-_]+", name)
    closing = [p for p in parts if CLOSED_NAMES.fullmatch(p)]
    return bool(closing) and all(p in closing or NAME_PARTS.fullmatch(p) for p in parts)


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


class Open:
    """An open element: whether it is closed to readers, its region (2 article, 1 main, 0 else), its place in the page and that of the
    element around it. ``form`` is the outermost form around it, which closes it unless it holds most of the page's text.
    """

    __slots__ = ("name", "shut", "region", "place", "around", "form", "holds_page")

    def __init__(self, name: str, shut: bool, region: int, place: int, around: int, form: Open | None = None):
        self.name, self.shut, self.region, self.place, self.around = name, shut, region, place, around
        self.form = self if form is None and name == "form" else form
        self.holds_page = False

    @property
    def closed(self) -> bool:
        return self.shut or (self.form is not None and not self.form.holds_page)


class Page:
    """Walks a page once. ``blocks``: (element, text) in page order; ``seen``: the same with (element, None) for every tag."""

    def __init__(self, page: str):
        self.stack = [Open("", False, 0, 0, 0)]
        self.depth: Counter = Counter()
        self.blocks: list[tuple[Open, str]] = []
        self.seen: list[tuple[Open, str | None]] = []
        self.now: list[str] = []
        for kind, name, attributes in tokens(page):
            if kind == "text":
                self.now.append(name)
            elif kind == "open":
                self._open(name, attributes)
            else:
                self._close(name)
        self._flush()
        in_form: dict[Open | None, int] = {}
        for element, text in self.blocks:
            if not element.shut:
                in_form[element.form] = in_form.get(element.form, 0) + len(text)
        for form, size in in_form.items():
            if form is not None:
                form.holds_page = 2 * size > sum(in_form.values())

    def _flush(self) -> None:
        if self.now:
            text = _clean("".join(self.now))
            self.now = []
            if text:
                self.blocks.append((self.stack[-1], text))
                self.seen.append(self.blocks[-1])

    def _open(self, name: str, attributes: dict[str, str]) -> None:
        closes = _is_closed(name, attributes)
        if name in BLOCK or closes:
            self._flush()
        if name in VOID:
            return
        if name in _PARAGRAPH_ENDS:
            self._end_implied("p", _PARAGRAPH_ENDS | {"li", "td", "th", "body"})
        elif name == "li":
            self._end_implied("li", {"ul", "ol", "menu"})
        top = self.stack[-1]
        region = max(top.region, 2 if name == "article" else 1 if name == "main" or attributes.get("role") == "main" else 0)
        place = _digest(f"{top.place}/{name}.{attributes.get('class', '')}")
        self.stack.append(Open(name, top.shut or closes, region, place, top.place, top.form))
        self.seen.append((self.stack[-1], None))
        self.depth[name] += 1

    def _end_implied(self, name: str, within: frozenset[str] | set[str]) -> None:
        if self.depth[name]:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].name == name:
                    self._cut(i)
                    return
                if self.stack[i].name in within:
                    return

    def _cut(self, i: int) -> None:
        for element in self.stack[i:]:
            self.depth[element.name] -= 1
        del self.stack[i:]

    def _close(self, name: str) -> None:
        if name in BLOCK or name in SILENT:
            self._flush()
        if not self.depth[name]:
            return
        i = next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].name == name)
        if self.stack[i].closed != self.stack[i - 1].closed:
            self._flush()
        if name in BLOCK or not any(e.name in BLOCK for e in self.stack[i + 1 :]):
            self._cut(i)
        else:  # an inline element that ends inside a block begun later: the block goes on
            self.depth[name] -= 1
            del self.stack[i]


def wording(element: Open, text: str) -> int:
    return _digest(f"{element.place}\0{text}")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_TOKENS = "array<struct<token:bigint,tag:boolean,n:int,up:int,size:int>>"


def page_tokens(page: str) -> tuple[int, list[tuple[int, bool, int, int, int]]]:
    """The hash of the main region's text, and the page's open tokens in the order of their first occurrence:
    (token, whether a tag, occurrences, index of the tag around it or -1, characters in the main region).
    """
    walked = Page(page)
    inside = main_region(walked.blocks)
    size = Counter(wording(element, text) for element, text in inside)
    at: dict[int, int] = {}
    out: list[list] = []
    for element, text in walked.seen:
        if element.closed:
            continue
        token = element.place if text is None else wording(element, text)
        if token in at:
            out[at[token]][2] += 1
            continue
        at[token] = len(out)
        around = element.around if text is None else element.place
        out.append([token, text is None, 1, at.get(around, -1), 0 if text is None else len(text) * size[token]])
    return _digest("\n".join(text for _, text in inside)), [tuple(x) for x in out]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, content, page, tokens): tokens by their hashes; their texts go no further than this task."""
    kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32())
    for rows in batches:
        contents, out, upto = [], [], [0]
        for text in rows.column(2).to_pylist():
            content, found = page_tokens(text or "")
            contents.append(content)
            out += found
            upto.append(len(out))
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)]
        tokens_ = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays(columns, names=["token", "tag", "n", "up", "size"]))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(contents, pa.int64()), rows.column(1), tokens_],
                                         names=["host", "content", "page", "tokens"])


_CHECKED = "host string, vector decimal(38,0), form long, texts array<bigint>, slot long, total long"


def class_on_page(found: list[dict], members: frozenset[int], whole: bool, all_members: frozenset[int]) -> tuple[int, list[int], int, int]:
    """A class on one page: the form of its tokens (order and nesting), its wording, the characters of the slots, of the region."""
    form, texts, holder = [], [], []   # holder: the member tag around each token; tags stand before what they hold
    for x in found:
        up = x["up"]
        up = up if up < 0 or (found[up]["token"] in members and found[up]["n"] == 1) else holder[up]
        holder.append(up)
        if x["token"] not in members:
            continue
        form.append(f"{x['token']}<{found[up]['token'] if up >= 0 else 0}")
        if not x["tag"] and (whole or up >= 0):  # a class on part of the pages must hold its wording in a tag of its own
            texts.append(x["token"])
    total = sum(x["size"] for x in found)
    return _digest(" ".join(form)), sorted(texts), total - sum(x["size"] for x in found if x["token"] in all_members), total


def _classes_on_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out: list[tuple] = []
        for host, found, classes in zip(*(rows.column(i).to_pylist() for i in range(3))):
            all_members = frozenset(t for c in classes for t in c["texts"])
            there = {x["token"] for x in found}
            for c in classes:
                if c["texts"][0] in there:
                    on = class_on_page(found, frozenset((*c["tags"], *c["texts"])), c["whole"], all_members)
                    out.append((host, c["vector"], *on))
        kinds = (pa.string(), pa.decimal128(38, 0), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)],
                                         names=["host", "vector", "form", "texts", "slot", "total"])


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wording): the wording of the valid classes of each host.

    Pages of a host with the same text in their main region count as one. A class is a candidate if it holds wording and
    stands on ``SUPPORT`` of the distinct pages, so a host has no more candidates than an average page has tokens, divided
    by that share. It needs a tag of its own, unless it is the template of the whole host (``MIN_SHARE`` of at least
    ``MIN_PAGES`` pages). It is valid if its tokens have the same order and nesting on all of its pages, and if
    ``MIN_SLOT`` of the text there lies in slots between candidates.
    """
    described = pages.select("host", "page", "html").mapInArrow(_described, f"host string, content long, page long, tokens {_TOKENS}")
    # copies are one page: partial minima, so that they do not gather
    distinct = scratch.keep(described.groupBy("host", "content").agg(F.min_by("tokens", "page").alias("tokens")).filter("size(tokens) > 0"), "distinct")
    per_host = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    vectors = distinct.select("host", "content", F.inline("tokens")).groupBy("host", "token", "tag").agg(
        F.count("*").alias("on"), F.max("n").alias("most"), F.sum(F.xxhash64("content", "n").cast("decimal(20,0)")).cast("decimal(38,0)").alias("vector"))
    support = F.greatest(F.lit(MIN_SUPPORT), F.col("pages") * SUPPORT)
    classes = (
        vectors.filter(F.col("on") >= MIN_SUPPORT).join(per_host, "host").filter(F.col("on") >= support).groupBy("host", "vector").agg(
            F.max("on").alias("on"), F.max("pages").alias("pages"),
            F.collect_list(F.when(F.col("tag") & (F.col("most") == 1), F.col("token"))).alias("tags"),
            F.collect_list(F.when(~F.col("tag"), F.col("token"))).alias("texts"))
        .withColumn("whole", (F.col("pages") >= MIN_PAGES) & (F.col("on") >= F.col("pages") * MIN_SHARE))
        .filter("size(texts) > 0 AND (whole OR size(tags) > 0)")
        .groupBy("host").agg(F.collect_list(F.struct("vector", "tags", "texts", "whole")).alias("classes"))
    )
    classes = scratch.keep(classes, "candidates")
    checked = distinct.join(classes, "host").select("host", "tokens", "classes").mapInArrow(_classes_on_pages, _CHECKED)
    valid = checked.groupBy("host", "vector").agg(
        F.min("form").alias("form"), F.max("form").alias("other"), F.min("texts").alias("texts"),
        F.sum("slot").alias("slot"), F.sum("total").alias("total")
    ).filter((F.col("form") == F.col("other")) & (F.col("slot") >= F.col("total") * MIN_SLOT))
    return valid.groupBy("host").agg(F.flatten(F.collect_list("texts")).alias("wording"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        texts = [main_text(text or "", frozenset(w or ())) for text, w in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def main_region(blocks: list[tuple[Open, str]]) -> list[tuple[Open, str]]:
    """Of the blocks that are not closed those in ``article``, else ``main``, if they hold more text than all others; else all."""
    left = [(element, text) for element, text in blocks if not element.closed]
    total = sum(len(text) for _, text in left)
    for region in (2, 1):
        inside = [(element, text) for element, text in left if element.region >= region]
        if 2 * sum(len(text) for _, text in inside) > total:
            return inside
    return left


def main_text(page: str, wordings: frozenset[int] = frozenset()) -> str:
    """The slots of the page's main region: blocks that are neither closed nor wording of the template, in page order.

    A region of which nothing would be left stays whole.
    """
    inside = main_region(Page(page).blocks)
    slots = [text for element, text in inside if wording(element, text) not in wordings] if wordings else []
    return "\n".join(slots or [text for _, text in inside])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    spark = ship(pages.sparkSession)
    scratch = Scratch(spark, "pages")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    found = scratch.keep(templates(rows.select("host", F.xxhash64("html").alias("page"), "html"), scratch), "templates")
    return (
        rows.join(found, "host", "left").select("page_id", "url", "html", "wording")
        .mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
    )
