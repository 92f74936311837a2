"""Main text of web pages by removal of site templates.

Each page is parsed into an element tree once.  Every element outside the
article gets a Merkle hash of its subtree; the hashes are counted per host over
pages with different article texts (all their texts, if they have no article),
and a subtree that recurs across many of them is part of the site's template and
goes, if the page has text besides that does not recur.  What markup itself names as no article
text (menus, headers, footers, sidebars, forms, scripts, notices, adverts,
reader comments) goes as well.  If a page has an ``article`` or ``main``
element, its text is that element's; its paragraphs, headings, lists, tables and
the like stay even where copies of the article recur on the host, in containers
too; only text that stands in generic containers alone can be template.  A page
without one gives the rest of its body.

The text that is left is cut at block elements; character references are
decoded, white space in a block becomes one space, blocks are trimmed and joined
in page order.

Counting shuffles hashes, not text; a host with a third of all pages is counted
by (host, subtree, page) first, and only pages that have a removable block meet
their host's template, which is bounded by the subtrees of a page divided by
``least_share``.  Parsing and removal take time and space in proportion to a page:
a subtree is kept as the range of blocks that it spans, and the ranges that are
template are swept over the blocks once.

Defined results: null html is empty and gives an empty text; a null or odd url
belongs to the host ''; pages of equal article text count once for the template;
an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.tables import cut, table
from lotwise.llm.url_filter import host_of

#: A subtree is template if it is on at least this many different pages of the
#: host and at least this share of them.
LEAST_PAGES = 5
LEAST_SHARE = 0.2

# Element names of HTML, by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre
    section summary table tbody td tfoot th thead tr ul""".split())
DROPPED = frozenset("""aside audio button canvas dialog embed footer form head header iframe input map math menu
    nav noembed noframes noscript object script select style svg template textarea title video""".split())
MAIN = frozenset(("article", "main"))
CONTAINER = frozenset("div section details figure table ul ol dl center".split())
#: Generic containers, the only elements inside an article that can be template.
GENERIC = frozenset("div section details center".split())
#: Elements whose text inside an article is always the article's.
PROSE = frozenset("""p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table caption td th figure figcaption blockquote pre
    address""".split())
CLOSED_BY_BLOCK = frozenset(("p",))
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
             "td": ("td", "th"), "th": ("td", "th")}
#: Class, id or role names that mark what is no article text; outside an article also
#: as the leading word of a name.
MARKS = frozenset("""ad ads advert adverts advertisement advertising banner sponsored promo comment comments disqus
    cookie cookies consent notice notices alert popup modal nav navbar navigation menu breadcrumb breadcrumbs sidebar
    footer header masthead share sharing social related newsletter subscribe""".split())

#: A quote opens a value only after "="; possessive, so a tag without an end costs no backtracking.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)"""
                 r"""((?:=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)|[^>])*+)>|<[!?][^>]*>""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
LEAD = re.compile(r"[a-z0-9]+")
#: Elements that hold the text itself; their class names speak of the page.
UNMARKED = MAIN | {"html", "body"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

PAGE = ("page_id long, url string, host string, digest long, subtrees array<long>, "
        "texts array<string>, own array<long>, prose array<boolean>, "
        "spans array<struct<subtree: long, first: int, end: int>>")


def _marked(attributes: str, whole: bool) -> bool:
    """Whether a name marks the element; if ``whole``, only the name as it stands."""
    if not attributes:
        return False
    names = (name for m in NAMED.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").lower().split())
    if whole:
        return any(name in MARKS for name in names)
    return any(lead[0] in MARKS for lead in map(LEAD.match, names) if lead)


class _Element:
    __slots__ = ("name", "parts", "dropped", "main", "prose", "first")

    def __init__(self, name, attributes, parent, first):
        self.name, self.first = name, first
        self.parts = [f"<{name}{attributes}>"]  # for the subtree's hash
        self.dropped = parent is not None and parent.dropped or name in DROPPED or (
            name not in UNMARKED and _marked(attributes, parent is not None and parent.main))
        self.main = parent is not None and parent.main or name in MAIN
        self.prose = parent is not None and parent.prose or self.main and name in PROSE


def _signed(hash_: int) -> int:
    return hash_ - (1 << 64) if hash_ >> 63 else hash_


class Page:
    """Blocks of a page and the hashes of the subtrees that hold them."""

    def __init__(self, source: str):
        self.texts: list[tuple[str, bool, bool]] = []  # each block, whether in the article, and in its prose
        self.spans: list[tuple[int, int, int, bool]] = []  # subtree hash, first block, end block, in the article
        self.hashes: set[int] = set()
        self._pending: list[str] = []
        self._stack = [_Element("", "", None, 0)]
        self._open_names: Counter = Counter()
        self._parse(source)

    def _flush(self) -> None:
        if self._pending:
            text = " ".join(html.unescape("".join(self._pending)).split())
            self._pending = []
            if text:
                self.texts.append((text, self._stack[-1].main, self._stack[-1].prose))

    def _text(self, data: str) -> None:
        if data:
            top = self._stack[-1]
            top.parts.append(data)
            if not top.dropped:
                self._pending.append(data)

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._flush()
            if name != "br":
                self._close_open(CLOSED_BY_BLOCK)
        for ends in (SAME_ENDS.get(name),):
            if ends:
                self._close_open(ends)
        if name in VOID:
            self._stack[-1].parts.append(f"<{name}{attributes}>")
        else:
            if name in MAIN or name in DROPPED:
                self._flush()
            element = _Element(name, attributes, self._stack[-1], len(self.texts))
            if element.dropped and not self._stack[-1].dropped:
                self._flush()
            self._stack.append(element)
            self._open_names[name] += 1

    def _close_open(self, names) -> None:
        """Close the nearest of these elements, unless a container stands between."""
        if not any(self._open_names[name] for name in names):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth].name in names:
                self._pop_to(depth)
                return
            if self._stack[depth].name in CONTAINER or self._stack[depth].name in MAIN:
                return

    def _close(self, name: str) -> None:
        if not self._open_names[name]:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth].name == name:
                self._pop_to(depth)
                return

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            element = self._stack[-1]
            if element.name in BLOCK or element.name in MAIN:
                self._flush()
            self._stack.pop()
            self._open_names[element.name] -= 1
            hash_ = xxhash.xxh3_64_intdigest("\x00".join(element.parts))
            self._stack[-1].parts.append(f"{hash_:x}")
            free = element.name not in ("html", "body", "head") and element.name not in MAIN
            if free and (not element.main or element.name in GENERIC):
                signed = _signed(hash_)
                self.hashes.add(signed)
                if len(self.texts) > element.first and not element.dropped:
                    self.spans.append((signed, element.first, len(self.texts), element.main))

    def _parse(self, source: str) -> None:
        at, raw = 0, None
        while True:
            if raw is not None:
                end = RAW_END[raw].search(source, at)
                stop = end.start() if end else len(source)
                self._text(source[at:stop])
                at, raw = stop, None
            tag = TAG.search(source, at)
            if tag is None:
                rest = source[at:]
                cut_tag = re.search(r"<[A-Za-z/!?]", rest)  # a tag that the page's end cuts off
                self._text(rest[:cut_tag.start()] if cut_tag else rest)
                break
            self._text(source[at:tag.start()])
            at = tag.end()
            name = (tag[2] or "").lower()
            if not name:
                continue
            if tag[1]:
                if name in BLOCK:
                    self._flush()
                self._close(name)
            else:
                attributes = tag[3]
                self._open(name, attributes)
                if name in RAW and not attributes.endswith("/"):
                    raw = name
        self._pop_to(1)
        self._flush()

    def blocks(self) -> list[tuple[str, bool]]:
        """The article's blocks, or all if there is none, and whether each is the article's prose."""
        article = any(main for _, main, _ in self.texts)
        return [(text, prose) for text, main, prose in self.texts if main or not article]

    def ranges(self) -> list[tuple[int, int, int]]:
        """The subtrees that can be template, each with the range of ``blocks()`` that it spans."""
        article = any(main for _, main, _ in self.texts)
        before = [0, *accumulate(int(main or not article) for _, main, _ in self.texts)]
        out = [(hash_, before[first], before[end]) for hash_, first, end, inside in self.spans if inside == article]
        return [(hash_, first, end) for hash_, first, end in out if first < end]


def covered(count: int, ranges) -> list[bool]:
    """Which of ``count`` blocks lie in one of the ranges."""
    change = [0] * (count + 1)
    for first, end in ranges:
        change[first] += 1
        change[end] -= 1
    return [depth > 0 for depth in accumulate(change[:count])]


def _rows(source: str):
    """A page's digest of article text, the hashes it counts for, its blocks and their ranges.

    If one of its blocks can be template, the hashes include those of the blocks' texts.
    """
    page = Page(source)
    blocks, ranges = page.blocks(), page.ranges()
    texts, prose = [t for t, _ in blocks], [p for _, p in blocks]
    digest = _signed(xxhash.xxh3_64_intdigest("\n".join(texts)))
    own = [_signed(xxhash.xxh3_64_intdigest("\x01" + t)) for t in texts]
    if not any(c and not p for c, p in zip(covered(len(texts), [r[1:] for r in ranges]), prose)):
        ranges = []
    if ranges:
        page.hashes.update(own)
    return digest, sorted(page.hashes), texts, own, prose, [
        {"subtree": h, "first": first, "end": end} for h, first, end in ranges]


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row per page: host, digest of the article text, subtree hashes and blocks."""
    span = pa.struct([("subtree", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.bool_()),
             pa.list_(span))

    def run(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "host", "html"))))
            for lo in range(0, len(rows), 500):
                ids, urls, hosts, sources = (list(c) for c in zip(*rows[lo:lo + 500]))
                found = [list(c) for c in zip(*map(_rows, sources))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(hosts, pa.string()),
                     *[pa.array(c, kind) for c, kind in zip(found, kinds)]],
                    ["page_id", "url", "host", "digest", "subtrees", "texts", "own", "prose", "spans"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host_of("url").alias("host"),
                        F.coalesce(F.col("html"), F.lit("")).alias("html")).mapInArrow(run, PAGE)


def _kept(texts, own, prose, spans, template) -> list[str]:
    """The blocks that are left of a page whose host has this template."""
    known = set(template or ())
    gone = [c and not p for c, p in zip(covered(len(texts), [
        (s["first"], s["end"]) for s in spans if s["subtree"] in known]), prose)]
    # a page all of whose text recurs is a copy, and keeps it
    if all(g or o in known for g, o in zip(gone, own)):
        return texts
    return [t for t, g in zip(texts, gone) if not g]


def without_template(judged: DataFrame) -> DataFrame:
    """(page_id, url, texts) of pages beside their host's template."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("texts", "own", "prose", "spans", "template")]
            kept = [_kept(*row) for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"),
                                              pa.array(kept, pa.list_(pa.string()))], ["page_id", "url", "texts"])

    return judged.select("page_id", "url", "texts", "own", "prose", "spans", "template").mapInArrow(
        run, "page_id long, url string, texts array<string>")


def templates(parsed: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, subtrees): the subtrees that recur across many different article texts of a host."""
    pages = (parsed.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
             .where(F.col("pages") >= least_pages))
    seen = (parsed.select("host", "digest", F.explode("subtrees").alias("subtree")).distinct()
            .groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("on")).where(F.col("on") >= least_pages))
    return (seen.join(pages, "host").where(F.col("on") >= F.col("pages") * least_share)
            .groupBy(F.col("host").alias("t_host")).agg(F.collect_list("subtree").alias("template")))


def main_texts(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, url, text) for each page."""
    parsed = cut(parse_pages(pages), "parsed")
    removable = F.size("spans") > 0
    found = templates(parsed, least_pages, least_share)
    judged = without_template(parsed.where(removable).join(found, F.col("host") == F.col("t_host"), "left"))
    both = judged.unionByName(parsed.where(~removable).select("page_id", "url", "texts"))
    return both.select("page_id", "url", F.array_join("texts", " ").alias("text"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
