"""Main text of web pages by removing site templates: subtrees that recur across many pages of a host.

1. Each page is read into a tree of its block elements, bottom-up hashed (tag, text, children's hashes), and its main region is chosen
   by the page's own marks: ``article``, else ``main``, else an element named as content, else the body; within it menus, asides, footers, forms, notices,
   adverts and reader comments are known by tag, role or name.
2. Spark counts, for each host and subtree of the main regions, the pages of different main text that hold it. Exact copies of a page count once.
3. A subtree on ``MANY_PAGES`` pages or more and on a share of the host's pages is a template; each page's templates come back to it by
   (host, hash), and their blocks go. The rest is joined in page order.

What recurs within an article may be the article: its paragraphs, headings and list items are never templates, other subtrees not if they hold
over half of the page's main text. A page without article or main has no such marks, so there any subtree may be one, and one without
paragraphs or headings (a menu, a box) needs a smaller share. Pages with no subtree in question, as articles of plain paragraphs, need no join.

Character references are decoded, white space in a block becomes one space, blocks are joined by one space.

Defined cases: null or blank html, or html without text, gives an empty text and n_chars 0. A page whose url is null or has no host takes no part in the
counts. Repeated page_ids are pages of their own. Nesting of any depth and pages of any length are read whole, by loops and not by recursion; a task holds an
Arrow batch and one page's tree. A tag cut off by the end of the page is dropped, as browsers do. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import bound_batches, materialize

#: Pages of different main text that make a subtree a template, and their shares of the host's pages: of any subtree, and of one without prose on an unmarked page.
MANY_PAGES, SHARE, BOX_SHARE = 4, 0.5, 0.1

# Elements of HTML, and names that pages give to what isn't the article.
RAW = set("script style title textarea xmp iframe noembed noframes".split())
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
IGNORED = {"html", "head", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
DROPPED = set("nav aside footer header form button select dialog noscript template svg canvas object audio video map menu datalist".split())
BLOCKS = DROPPED | HEADINGS | set(
    "address article blockquote caption center dd details dir div dl dt fieldset figcaption figure frameset hgroup legend li listing main ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = HEADINGS | {"p", "pre", "blockquote"}
WITHIN_P = {"button", "select", "option", "optgroup", "noscript", "template", "svg", "canvas", "object", "audio", "video", "map", "datalist"}
#: A start tag closes an open element of the first set, looking up to one of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "article": ({"nav", "header"}, set()), "main": ({"nav", "header"}, set()),
}
TABLE = {"table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}
SCOPE = {"table", "caption", "td", "th", "template"}
NAMED = set(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar sidebar aside rail widget widgets footer masthead comment comments commentlist disqus respond replies share sharing social related recommended "
    "recommendations login search skip copyright disclaimer".split()
)
HEADER_NAMES = {"header", "topbar"}
NOT_ITS_NAME = {"no", "has", "with", "without", "hide", "open"}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CONTENT = set("content main maincontent main-content article article-body article-content articlebody post post-content post-body entry entry-content story story-body page-content".split())
COMMENT_TITLES = re.compile(r"(?:\d+ )?(?:reader )?(?:comments?|responses|kommentare?|leserkommentare|commentaires?|comentarios?)(?: \(?\d+\)?)?:?", re.I)

TOKEN = re.compile(r"""<(?:!--(?:(?=-?>)|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>|[!?/][^>]*+>)""", re.S)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"""(?:^|\s|["'/])(class|id|role|hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
HOST = re.compile(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)")

#: A page's blocks that stay by its own marks; the subtrees among them as hash, range and kind.
ANY, BOX = 0, 1
PARSED = "page_id long, url string, host string, digest long, blocks array<string>, subtrees array<struct<hash: long, a: int, b: int, kind: int>>"
SUBTREES = pa.list_(pa.struct([("hash", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("kind", pa.int32())]))


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def marks(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's attributes say that it isn't the article, that it is a header, that it is the content."""
    away = header = content = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            away = True
        elif name == "role":
            away, content = away or value.lower() in ROLES, content or value.lower() in ("main", "article")
        elif name in ("class", "id"):
            for one in value.split():
                parts = [p.lower() for p in NAME_PARTS.findall(one)]
                content |= one.lower() in CONTENT
                known = [p for k, p in enumerate(parts) if not (k and parts[k - 1] in NOT_ITS_NAME)]
                away |= any(p in NAMED for p in known) and parts[-1:] != ["open"]
                header |= any(p in HEADER_NAMES for p in known)
    return away, header, content


class Tree:
    """Block elements of a page in page order, each with the range of its blocks of text."""

    def __init__(self, html: str):
        self.tag, self.up, self.first, self.end, self.hash = ["body"], [-1], [0], [0], [0]
        self.marks = [(False, False, False)]
        self.blocks: list[str] = []
        self.linked: list[int] = []  # characters within links, by block
        self.links: list[int] = []  # links begun, by block
        self.stack, self.inner = [0], [[]]
        self.count: dict[str, int] = {}  # open elements by tag
        self.parts: list[str] = []
        self.in_links = self.begun = 0
        self.link_depth = 0  # of the stack when a link was opened; 0 if none is open
        self._read(html)

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.link_depth:
            self.in_links += len(text.strip())

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(text)
                self.linked.append(self.in_links)
                self.links.append(self.begun)
                self.inner[-1].append(text)
                self.in_links = self.begun = 0
            self.parts.clear()

    def _open(self, tag: str, found: tuple[bool, bool, bool]) -> None:
        self._flush()
        self.tag.append(tag)
        self.up.append(self.stack[-1])
        self.first.append(len(self.blocks))
        self.end.append(-1)
        self.hash.append(0)
        self.marks.append(found)
        self.stack.append(len(self.tag) - 1)
        self.count[tag] = self.count.get(tag, 0) + 1
        self.inner.append([])

    def _close_to(self, depth: int) -> None:
        """Close the elements of the stack from ``depth`` on."""
        self._flush()
        while len(self.stack) > depth:
            e, inner = self.stack.pop(), self.inner.pop()
            self.count[self.tag[e]] = self.count.get(self.tag[e], 0) - 1
            self.end[e] = len(self.blocks)
            self.hash[e] = number("\x00".join([self.tag[e], *inner]))
            if self.end[e] > self.first[e] and self.inner:
                self.inner[-1].append(f"\x01{self.hash[e]}")
        if self.link_depth > len(self.stack):
            self.link_depth = 0

    def _depth(self, tags: set[str], barriers: set[str]) -> int:
        if not any(self.count.get(tag) for tag in tags):
            return 0
        for d in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[d]]
            if tag in tags:
                return d
            if tag in barriers:
                return 0
        return 0

    def _start(self, tag: str, attributes: str) -> None:
        found = marks(attributes) if attributes and not attributes.isspace() else (False, False, False)
        if tag not in BLOCKS:
            if tag == "a":
                self.link_depth = len(self.stack)
                self.begun += 1
            if not found[0] and self.tag[self.stack[-1]] != tag:  # inline elements matter only within one that goes
                return
        elif tag not in WITHIN_P:
            top = len(self.stack) - 1
            while top and self.tag[self.stack[top]] not in BLOCKS:
                top -= 1
            if top and self.tag[self.stack[top]] == "p":
                self._close_to(top)
        if tag in IMPLIED and (depth := self._depth(*IMPLIED[tag])):
            self._close_to(depth)
        self._open(tag, found)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = 0
        if tag in HEADINGS:
            depth = self._depth(HEADINGS, SCOPE)
        else:
            depth = self._depth({tag}, {"table"} if tag in TABLE else SCOPE | {"button"} if tag == "p" else SCOPE)
        if depth:
            self._close_to(depth)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = TOKEN.search(html, at)
            if m is None:
                cut = re.compile("<[a-zA-Z/!?]").search(html, at)
                self._text(html[at : cut.start()] if cut else html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in IGNORED:
                continue
            if m[1]:
                if tag == "br":
                    self.parts.append(" ")
                elif tag == "p" and not self._depth({"p"}, SCOPE | {"button"}):
                    self._flush()
                elif tag in BLOCKS or tag == "a" or any(self.tag[e] == tag for e in self.stack[-1:]):
                    self._end(tag)
            elif tag in RAW:
                end = RAW_END[tag].search(html, at)
                at = html.find(">", end.end()) + 1 or size if end else size
            elif tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self._flush()
            elif tag not in VOID:
                self._start(tag, m[3])
        self._close_to(0)

    def main(self) -> tuple[list[str], list[dict], list[str]]:
        """The blocks that stay by the page's marks, the subtrees that may be templates, and the tags of the region's roots."""
        n, lengths = len(self.tag), [0, *accumulate(map(len, self.blocks))]

        def size(e: int) -> int:
            return lengths[self.end[e]] - lengths[self.first[e]]

        gone = [0] * (len(self.blocks) + 1)

        def drop(e: int, by: int = 1) -> None:
            gone[self.first[e]] += by
            gone[self.end[e]] -= by

        inside_of = self._wrappers(size)
        away = [False] * n  # itself, or something above it
        header = [False] * n
        for e in range(1, n):
            said, is_header, _ = self.marks[e]
            tag, wraps = self.tag[e], inside_of[e]
            own = said and not wraps or tag in DROPPED and tag != "header" and not (wraps and tag == "form")
            if tag in ("section", "div", "ol", "ul") and not wraps and self.end[e] > self.first[e] and COMMENT_TITLES.fullmatch(self.blocks[self.first[e]]):
                own = True
            away[e] = away[self.up[e]] or own
            header[e] = (is_header or tag == "header") and not wraps and not own

        roots = self._roots(away, size)
        region = [0] * (len(self.blocks) + 1)
        of_root = [False] * n
        for e in roots:
            of_root[e] = True
            region[self.first[e]] += 1
            region[self.end[e]] -= 1
        marked = self.tag[roots[0]] in ("article", "main")
        within = of_root[:]
        nested = [False] * n
        in_header = [False] * n
        for e in range(1, n):
            p = self.up[e]
            within[e] = within[e] or within[p]
            nested[e] = nested[p] or within[p] and marked and self.tag[e] == "article" and self.tag[roots[0]] == "article"
            in_header[e] = header[e] or in_header[p]
            if away[e] and not away[p] or nested[e] and not nested[p] or header[e] and not in_header[p]:
                drop(e)
            if marked and within[e] and self.tag[e] in HEADINGS and self.tag[p] not in HEADINGS and in_header[e]:
                drop(e, -1)
            if not marked and within[e] and not away[e] and self._menu(e, size(e)):
                away[e] = True
                drop(e)
        keep = [r > 0 and g <= 0 for r, g in zip(accumulate(region), accumulate(gone), strict=True)][: len(self.blocks)]
        place = [0, *accumulate(map(int, keep))]
        prose = [tag in PROSE for tag in self.tag]
        for e in reversed(range(1, n)):
            prose[self.up[e]] |= prose[e]
        subtrees = []
        for e in range(1, n):
            a, b = place[self.first[e]], place[max(self.first[e], self.end[e])]
            if a < b and not inside_of[e] and not of_root[e] and not (marked and (self.tag[e] in PROSE or self.tag[e] == "li")):
                subtrees.append({"hash": self.hash[e], "a": a, "b": b, "kind": ANY if marked or prose[e] else BOX})
        return [t for t, k in zip(self.blocks, keep, strict=True) if k], subtrees, [self.tag[e] for e in roots]

    def _wrappers(self, size) -> list[bool]:
        """The elements that hold the article (or main, or in a page with neither its first h1 and most of its text): no name takes them away.

        Comments may be articles too, so it is the first with an h1, else the first that nothing above it names otherwise, else the largest.
        """
        n = len(self.tag)
        wraps, named, titled = [False] * n, [False] * n, [False] * n
        heads = [e for e in range(n) if self.tag[e] == "h1" and self.end[e] > self.first[e]]
        for e in range(1, n):
            named[e] = named[self.up[e]] or self.marks[e][0] or self.tag[e] in DROPPED
        for e in reversed(range(1, n)):
            titled[self.up[e]] |= titled[e] or self.tag[e] == "h1"
        articles = [e for e in range(n) if self.tag[e] == "article" and size(e)]
        anchors = [e for e in range(n) if self.tag[e] == "main"]
        if articles:
            anchors.append(next((e for e in articles if titled[e]), None) or next((e for e in articles if not named[e]), None) or max(articles, key=size))
        for e in anchors:
            while e >= 0 and not wraps[e]:
                wraps[e] = True
                e = self.up[e]
        if not anchors and heads:
            e = heads[0]
            while e >= 0:
                wraps[e] = wraps[e] or 2 * size(e) > size(0)
                e = self.up[e]
        return wraps

    def _menu(self, e: int, size: int) -> bool:
        a, b = self.first[e], self.end[e]
        return self.tag[e] in ("ul", "ol", "div", "table", "p", "dl") and b > a and sum(self.links[a:b]) >= 3 and 5 * sum(self.linked[a:b]) >= 3 * size

    def _roots(self, away: list[bool], size) -> list[int]:
        """Outermost articles, else main, else an element named as content that holds most of the text, else the body."""
        n = range(1, len(self.tag))

        def outermost(of: list[int]) -> list[int]:
            out, end = [], -1
            for e in of:
                if e >= end:
                    out.append(e)
                    end = e + 1
                    while end < len(self.tag) and self.up[end] >= e:
                        end += 1
            return out

        mains = outermost([e for e in n if self.tag[e] == "main" and size(e)])
        articles = outermost([e for e in n if self.tag[e] == "article" and not away[e] and size(e)])
        if articles:
            titled = any(self.tag[e] in ("h1", "h2") and any(a <= e and self.first[a] <= self.first[e] and self.end[e] <= self.end[a] for a in articles[:1]) for e in n)
            if titled or 4 * sum(map(size, articles)) >= sum(map(size, mains or [0])):
                return articles
        if mains:
            return mains
        named = outermost([e for e in n if self.marks[e][2] and not away[e] and 2 * size(e) > size(0)])
        return named or [0]


def parse(html: str | None) -> tuple[list[str], list[dict]]:
    blocks, subtrees, _ = Tree(html or "").main()
    return blocks, subtrees


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, digests, blocks, subtrees = [], [], [], []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = HOST.match(url or "")
            own, found = parse(html)
            hosts.append(host[1].lower() if host else None)
            digests.append(number("\x00".join(own)))
            blocks.append(own)
            subtrees.append(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(blocks, pa.list_(pa.string())), pa.array(subtrees, SUBTREES)],
            ["page_id", "url", "host", "digest", "blocks", "subtrees"])


def without(blocks: list[str], templates: list[dict]) -> str:
    """The page's text when its templates are gone; one that holds over half of it stays."""
    lengths = [0, *accumulate(map(len, blocks))]
    gone = [0] * (len(blocks) + 1)
    for t in templates:
        if 2 * (lengths[t["b"]] - lengths[t["a"]]) <= lengths[-1]:
            gone[t["a"]] += 1
            gone[t["b"]] -= 1
    return " ".join(b for b, g in zip(blocks, accumulate(gone)) if g <= 0)


def _join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        templates = batch.column("templates").to_pylist()
        texts = [without(b, found or []) for b, found in zip(batch.column("blocks").to_pylist(), templates, strict=True)]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t or ()) for t in templates], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_templates"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, hash, n, pages): subtrees on ``MANY_PAGES`` or more pages of a host, of so many, each main text once."""
    known = pages.where("host IS NOT NULL")
    seen = known.select("host", "digest", F.explode("subtrees.hash").alias("hash")).groupBy("host", "hash").agg(F.count_distinct("digest").alias("n")).where(F.col("n") >= MANY_PAGES)
    return seen.join(known.groupBy("host").agg(F.count_distinct("digest").alias("pages")), "host")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_templates (subtrees of the page's main region that are templates of its host) of each page."""
    bound_batches(pages.sparkSession)
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = materialize(read.mapInArrow(_parse, PARSED).withColumn("no", F.monotonically_increasing_id()), "pages")
    asked = (F.size("subtrees") > 0) & F.col("host").isNotNull()
    own = parsed.where(asked).select("no", "host", F.explode("subtrees").alias("t")).select("no", "host", "t", F.col("t.hash").alias("hash"))
    share = F.when(F.col("t.kind") == BOX, BOX_SHARE).otherwise(SHARE)
    by_page = own.join(templates(parsed), ["host", "hash"]).where(F.col("n") >= share * F.col("pages")).groupBy("no").agg(F.collect_list("t").alias("templates"))
    joined = parsed.where(asked).select("no", "page_id", "url", "blocks").join(by_page, "no", "left").drop("no")
    some = joined.mapInArrow(_join, "page_id long, url string, text string, n_chars long, n_templates long")
    text = F.array_join("blocks", " ")
    rest = parsed.where(~asked).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.lit(0).cast("long").alias("n_templates"))
    return some.unionByName(rest)
