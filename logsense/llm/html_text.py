"""Main text of web pages, with each site's own templates removed.

Pass one hashes every container element's subtree and counts, per host, the pages of different text it
occurs on, so that copies of a page are one; pass two drops the subtrees that recur, beside what HTML itself marks as no article
(menus, footers, scripts, forms and so on) and elements whose class, id or role says so. Inside the article
a class or id only counts for boxes (div, section and the like) of a clear name such as ad or comments; words
such as header, search or share, and any class of a paragraph or list item, count if the element recurs too. Other
headings and paragraphs are never counted as templates, so a passage that many articles share stays.

Defined cases: a null or empty html gives an empty text; a null url is a host of its own; tags left open
end with their parent, an unfinished tag at the end is dropped; formulas are text, drawings aren't; articles marked
as teasers go where another isn't; a page without article or main element is taken from its whole body; where templates leave nothing but headings, the longest of them that holds
more than links stays, as it may be an article with copies; equal pages of a host give equal texts; an empty table gives no rows; other columns
are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsense.functions.arrays import tidy
from logsense.session import checkpoint, ship

#: A subtree is a template if it is on so many pages of its host, however large the host is.
LEAST_PAGES = 4
#: Bytes up to which the table of templates is broadcast.
BROADCAST_BYTES = 8 << 20

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|title|textarea|noscript|iframe|xmp|noembed|noframes)\b(?:"[^"]*"|'[^']*'|[^'">])*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s(?:"[^"]*"|'[^']*'|[^'">])*|/)?)>
    |</?[a-zA-Z!?][^>]*(?:>|\Z)|<[!?/]?\Z""",
    re.S | re.I | re.X,
)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
CONTAINERS = frozenset("div section aside nav header footer ul ol dl table form fieldset details figure blockquote address menu dialog center".split())
BLOCKS = CONTAINERS | frozenset("html head body main article p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption thead tbody tfoot pre hr figcaption summary option select button label".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog audio video label fieldset svg canvas object template annotation annotation-xml".split())
FOREIGN = frozenset("svg math".split())  # elements that may close themselves
OWN = frozenset("blockquote table figure dl details address center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADINGS = TITLES | {"html", "body", "main"}
# Words in class, id and role that mark what isn't the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side rail widget widgets footer foot header masthead topbar toolbar share sharing social related recommended recommendations teaser comment comments commentlist disqus reply replies respond pagination pager skip legal copyright login search contentinfo complementary".split()
)
# Those of them that also name an article's own parts: inside the article they count only if the element recurs on the host.
WEAK = frozenset("header masthead foot footer side rail search legal copyright social share sharing alert notice notices banner navigation menu menus advertising promotion sponsor login overlay consent subscription skip".split())
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
TEASERS = frozenset("teaser related recommended recommendations promo promotion sponsored advert advertisement ad".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def marks(attrs: str) -> tuple[bool, set[str]]:
    """Whether an element is hidden or has a role that no article has, and the words of its class and id."""
    sure, out = False, set()
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in MARKED:
            sure = True  # a role isn't a name that an author makes up
        elif name in ("class", "id"):
            out.update(re.split(r"[^a-z0-9]+", value))
    return sure, out


def joined(text: str) -> str:
    """text with single spaces."""
    return " ".join(text.split())


class Page:
    """Elements of a page with the source range of each, and the hashes of the subtrees that may be templates.

    A subtree's hash is taken over its own tags and text and its children's hashes, so nesting costs nothing.
    """

    def __init__(self, html: str):
        self.html = html
        self.tokens = list(TOKEN.finditer(html))
        self.elements: list[list] = []  # tag, start, end, marked, inside article, holds article, weak words of its marks
        self.hashes: dict[int, int] = {}
        tags = {m["tag"].lower() for m in self.tokens if m["tag"] and not m["end"]}
        self.main = next((t for t in ("article", "main") if t in tags), "")
        self._open: list[int] = []
        self._count: dict[str, int] = {}
        self._parts: list[list[str]] = [[]]  # of each open element: tags, text and children's hashes
        self._texts: list[list[str]] = [[]]  # the same without tags, kept while an element with weak words is open
        self._weak = last = 0
        for m in self.tokens:
            self._add(joined(html[last : m.start()]), True)
            last = m.end()
            tag = (m["tag"] or "").lower()
            if not tag or tag in VOID or tag in FOREIGN and m["attrs"].endswith("/"):
                self._add(joined(m[0]))
            elif m["end"]:
                self._end(tag, m)
            else:
                self._start(tag, m)
        self._add(joined(html[last:]), True)
        self._close(0, len(html))
        mains = [e for e in self.elements if e[0] == self.main and not e[4]]
        if all(e[3] for e in mains):
            for e in mains:
                e[3] = False

    def _add(self, part: str, text: bool = False) -> None:
        if part:
            self._parts[-1].append(part)
            if text and self._weak:
                self._texts[-1].append(part)

    def _start(self, tag: str, m: re.Match) -> None:
        sure, words = marks(m["attrs"]) if m["attrs"] else (False, set())
        marked = set() if tag in HEADINGS else words & (READERS | TEASERS if tag == "article" else MARKED)
        if tag not in BLOCKS and tag not in DROPPED and not marked and not sure:
            self._add(joined(m[0]))
            return
        top = self.elements[self._open[-1]][0] if self._open else ""
        if top == "p" and tag in BLOCKS or top in CLOSES.get(tag, ()):
            self._close(len(self._open) - 1, m.start())
        inside = bool(self.main and self._count.get(self.main))
        # inside the article a class is only a hint, but for the boxes that hold what their class says
        strong = marked - WEAK if not inside or tag in CONTAINERS or tag == "article" else set()
        sure = (sure and tag not in HEADINGS) or bool(strong) or tag in DROPPED or tag == "header" and not inside
        weak = () if sure else sorted(marked)
        self._weak += bool(weak)
        self._open.append(len(self.elements))
        self._count[tag] = self._count.get(tag, 0) + 1
        self._parts.append([joined(m[0])])
        self._texts.append([])
        self.elements.append([tag, m.start(), len(self.html), sure, inside, False, weak])

    def _end(self, tag: str, m: re.Match) -> None:
        if self._count.get(tag):
            for n in range(len(self._open) - 1, -1, -1):
                name = self.elements[self._open[n]][0]
                if name == tag:
                    self._close(n + 1, m.start())
                    self._close(n, m.end())
                    return
                if name in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    return
        elif tag not in BLOCKS:
            self._add(joined(m[0]))

    def _close(self, n: int, at: int) -> None:
        """Close open elements until n are left."""
        while len(self._open) > n:
            k = self._open.pop()
            e = self.elements[k]
            tag, _, _, _, inside, holds, weak = e
            e[2] = at
            h, texts = digest("\0".join(self._parts.pop())), self._texts.pop()
            if weak:  # a box for sharing has other addresses on each page, and the same text
                self.hashes[k] = digest("\0".join([*weak, *texts]))
                self._weak -= 1
            elif tag in CONTAINERS and not holds and not (inside and tag in OWN):  # an article's quotes and tables are its own
                self.hashes[k] = h
            self._parts[-1].append(f"\1{h}")
            if self._weak:
                self._texts[-1].append(f"\1{digest(chr(0).join(texts))}")
            self._count[tag] -= 1
            if self._open and (holds or tag == self.main and not inside):
                self.elements[self._open[-1]][5] = True

    def text(self, templates: set[int]) -> str:
        """The article's blocks, one on a line."""
        known = {k for k, h in self.hashes.items() if h in templates} if templates else set()
        blocks = self.blocks(known)
        if known and not any(outside for _, outside in blocks):
            # nothing but headings is left: these may be copies of an article that differ around it
            marked = [e for e in self.elements if e[3] and not e[5]]
            ranges = [(e[2] - e[1], -k) for k in known if (e := self.elements[k])[4] >= bool(self.main) and not self.only_links(e) and not any(m[1] <= e[1] and e[2] <= m[2] for m in marked)]
            if ranges:
                _, first, end, *_ = self.elements[-max(ranges)[1]]
                blocks = self.blocks({k for k in known if not first <= self.elements[k][1] < end})
        return "\n".join(s for s, _ in blocks)

    def only_links(self, element: list) -> bool:
        """Whether an element has no text outside links."""
        rest = re.sub(r"<a\b.*?</a\s*>", "", self.html[element[1] : element[2]], flags=re.S | re.I)
        return not re.search(r"\w", unescape(TOKEN.sub("", rest)))

    def blocks(self, known: set[int]) -> list[tuple[str, bool]]:
        """Texts left without the known elements, each with whether it stands outside headings."""
        gone = sorted((e[1], e[2]) for k, e in enumerate(self.elements) if (e[3] and not e[5]) or k in known)
        kept = [(e[1], e[2]) for e in self.elements if e[0] == self.main and not e[4]] if self.main else [(0, len(self.html))]
        blocks, now = [], []
        heading = False
        g, upto = 0, 0  # the next range that is gone; where the ranges so far end
        w = 0

        def flush() -> None:
            if s := " ".join(unescape("".join(now)).split()):
                blocks.append((s, not heading))
            now.clear()

        def within(at: int) -> bool:
            nonlocal g, upto, w
            while g < len(gone) and gone[g][0] <= at:
                upto = max(upto, gone[g][1])
                g += 1
            while w < len(kept) and kept[w][1] <= at:
                w += 1
            return at >= upto and w < len(kept) and kept[w][0] <= at

        last = 0
        for m in self.tokens:
            if last < m.start() and within(last):
                now.append(self.html[last : m.start()])
            tag = (m["tag"] or "").lower()
            if tag in BLOCKS:
                flush()
                heading = not m["end"] and tag in TITLES
            elif tag == "br":
                now.append(" ")
            last = m.end()
        if last < len(self.html) and within(last):
            now.append(self.html[last:])
        flush()
        return blocks


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the url's host."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    return pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))


def digest(text: str) -> int:
    """64 bits of a text's hash."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host and the subtree hashes that recur on so many of its pages of different text."""
    ship(pages.sparkSession)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes, texts = [], [], []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(html)
                if own := set(page.hashes.values()):
                    hosts += [host] * len(own)
                    hashes += own
                    texts += [digest(page.text(set()))] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(texts, pa.int64())], ["host", "h", "page"])

    seen = with_host(pages).select("host", "html").mapInArrow(tidy(subtrees), "host string, h long, page long")
    seen = seen.groupBy("host", "h").agg(F.count_distinct("page").alias("n"))
    return seen.where(F.col("n") >= least_pages).groupBy("host").agg(F.collect_list("h").alias("templates"))


def with_templates(pages: DataFrame, known: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """with_host() and each page's own templates, null for none. Pages don't move if the table, measured, is small."""
    x = with_host(pages)
    size = known.agg(F.sum(F.octet_length("host") + 8 * F.size("templates"))).first()[0] or 0
    if size <= most:
        kind = pages.schema["page_id"].dataType.simpleString()
        found = pages.sparkSession.sparkContext.broadcast({r.host: np.sort(np.array(r.templates, np.int64)) for r in known.collect()})

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = []
                for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    if (all_ := found.value.get(host)) is None:
                        own.append(None)
                        continue
                    hashes = np.unique(np.array(list(Page(html).hashes.values()), np.int64))
                    at = np.minimum(np.searchsorted(all_, hashes), len(all_) - 1)
                    own.append(hashes[all_[at] == hashes].tolist() or None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.int64()))], [*batch.schema.names, "templates"])

        return x.mapInArrow(tidy(look_up), f"page_id {kind}, url string, html string, host string, templates array<bigint>")

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes = [], []
            for k, html in enumerate(batch.column("html").to_pylist()):
                own = set(Page(html).hashes.values())
                at += [k] * len(own)
                hashes += own
            rows = batch.select(["host", "a", "b"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(hashes, pa.int64())], ["host", "a", "b", "h"])

    # a page is known by its host and two hashes; what it has in common with its host's table is found by a join
    x = x.withColumns({"a": F.xxhash64("html"), "b": F.xxhash64("html", F.lit(1))})
    own = x.select("host", "a", "b", "html").mapInArrow(tidy(subtrees), "host string, a long, b long, h long").distinct()
    own = own.join(known.select("host", F.explode("templates").alias("h")), ["host", "h"])
    own = own.groupBy("host", "a", "b").agg(F.sort_array(F.collect_list("h")).alias("templates"))
    return x.join(own, ["host", "a", "b"], "left").select("page_id", "url", "html", "host", "templates")


def main_text(pages: DataFrame, **how) -> DataFrame:
    """page_id, url, text of every page."""
    ship(pages.sparkSession)
    known = checkpoint(site_templates(pages, **how))
    size = known.agg(F.sum(F.octet_length("host") + 8 * F.size("templates"))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    found = pages.sparkSession.sparkContext.broadcast({r.host: np.sort(np.array(r.templates, np.int64)) for r in known.collect()} if small else {})
    x = with_host(pages).withColumn("templates", F.lit(None).cast("array<bigint>")) if small else with_templates(pages, known, 0)
    x = x.select("page_id", "url", "html", "host", "templates")

    def own_templates(page: Page, host: str, templates: list[int] | None) -> set[int]:
        all_ = found.value.get(host)
        if all_ is None:
            return set(templates or ())
        return {h for h in page.hashes.values() if (k := int(np.searchsorted(all_, h))) < len(all_) and all_[k] == h}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, html, templates in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "templates")), strict=True):
                page = Page(html)
                texts.append(page.text(own_templates(page, host, templates)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return x.mapInArrow(tidy(extract), f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
