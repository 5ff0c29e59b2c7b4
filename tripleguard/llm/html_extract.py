"""Main text of web pages by nearest-URL page differencing.

Each page becomes text lines (its blocks). Pages of a host that mark no article are sorted by URL path, copies
(equal line lists) once; a page is
paired with the neighbour whose path shares the longer beginning, both line lists are
aligned by their longest common subsequence, and shared lines (the site's template) go. Markup
that names its role decides first: menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts and styles go in any case, and where a page marks its article, that is what
is kept: its lines stay even if a neighbour carries the same article.

White space, a line break element (br) included, is one space within a block. What is no valid markup is read as browsers read it:
`<!` and `<?` up to the next `>`, an unclosed comment, tag or script up to the end.

Pairs come from places in the order of host and path, so they don't depend on partitions; copies get one text.
Defined results: null or empty html and pages without text give an empty text; null urls form a host
of their own; a page with no other than its copies keeps its lines; repeated pages give a row each; further columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleguard.llm.shared import written
from tripleguard.llm.url_filter import host_of, path_of
from tripleguard.operators.vocabulary import dense_ids

# Elements by role.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
NO_TEXT = set("head script style noscript template iframe object svg math canvas audio video select textarea button title".split())
AROUND = set("nav header footer aside form menu dialog search".split())
WALLS = ("article", "main", "body", "td", "li")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style")
#: What surrounds an article: a name of one or more of these words, and of words of AT beside them, is not the article.
NOT_ARTICLE = set(
    "ad ads adbox adbar advert adverts advertisement advertisements advertising alert alerts banner banners breadcrumb breadcrumbs byline-share comment comments commentlist "
    "complementary consent contentinfo cookie cookies cookiebar disqus footer masthead menu menubar menus modal nav navbar navigation newsletter notice notices pager pagination popup popups "
    "promo promos promoted promotion promotions related reply replies respond responses search share sharing sharebar sidebar signup skyscraper social sponsor sponsored sponsors "
    "subscribe subscription tagcloud tags teaser teasers toolbar widget widgets".split()
)
#: Words that only say where something is or what form it has.
AT = set(
    "a all area articles aside bar block body bottom box button buttons col column container content count footer form global header holder icons inner item items js left link links "
    "list lower main menu news outer page pages panel posts row section side site slot small stories tag text title top unit upper wide wrap wrapper".split()
)
NAMES = {"author-box", "author-bio", "post-author", "entry-footer", "post-meta", "entry-meta", "post-tags", "site-header", "page-header", "top-header"}
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


@lru_cache(1 << 14)
def around_article(name: str) -> bool:
    """Whether one word of a class, id or role names something around the article, as cookie-notice does and social-history doesn't."""
    parts = [p.lower().rstrip("0123456789") for p in _PARTS.split(name)]
    parts = [p for p in parts if p]
    return "-".join(parts) in NAMES or any(p in NOT_ARTICLE for p in parts) and all(p in NOT_ARTICLE or p in AT for p in parts)


#: Whole words of class, id, role and itemprop attributes that name the article itself.
IS_ARTICLE = set("main article articlebody article-body post-body post-content entry-content main-content article-content story-body".split())

ARTICLE, PLAIN = 1, 0
LINES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.list_(pa.string())), ("marked", pa.bool_())])


_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: What follows a tag's name: its end, or an attribute with or without a value.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+)""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _tag_end(html: str, at: int) -> tuple[int, list[tuple[str, str | None]]]:
    """Where the tag whose name ends at the place is over, and its attributes; a tag without an end takes the rest."""
    attrs = []
    while found := _ATTRIBUTE.match(html, at):
        if found[1]:
            return found.end(), attrs
        value = found[3]
        attrs.append((found[2].lower(), None if value is None else unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value)))
        at = found.end()
    return len(html), attrs


def _after(html: str, mark: str, start: int) -> int:
    at = html.find(mark, start)
    return len(html) if at < 0 else at + len(mark)


class _Lines:
    """Collects (kind, line) of the text outside elements that are not the article.

    One pass over the page: each mark of the markup is looked for from where the last one ended, and the places of open
    elements are kept by name, so stray or unclosed tags cost no search. Nothing in a page is an error.
    """

    def __init__(self) -> None:
        self.open: list[str] = []
        self.depths: dict[str, list[int]] = {}  # by name, where the open elements of it are
        self.walls: list[int] = []  # depths of elements that the end of an inline one doesn't close
        self.skip_from: int | None = None  # depth of the outermost element whose text is dropped
        self.articles: list[int] = []  # depths of open elements that hold the article
        self.parts: list[str] = []
        self.lines: list[tuple[int, str]] = []

    def feed(self, html: str) -> None:
        at = 0
        while at < len(html):
            mark = html.find("<", at)
            if mark < 0:
                mark = len(html)
            if mark > at:
                self.text(html[at:mark])
            if mark == len(html):
                break
            following = html[mark + 1 : mark + 2]
            if html.startswith("<!--", mark):
                # <!--> and <!---> are whole comments
                at = mark + 5 if html.startswith(">", mark + 4) else mark + 6 if html.startswith("->", mark + 4) else _after(html, "-->", mark + 4)
            elif following in ("!", "?"):
                at = _after(html, ">", mark + 2)
            elif following == "/":
                if name := _NAME.match(html, mark + 2):
                    at, _ = _tag_end(html, name.end())
                    self.end(name[0].lower())
                else:
                    at = _after(html, ">", mark + 2)
            elif name := _NAME.match(html, mark + 1):
                tag = name[0].lower()
                at, attrs = _tag_end(html, name.end())
                self.start(tag, attrs)
                if tag in RAW:
                    end = _RAW_END[tag].search(html, at)
                    at = end.start() if end else len(html)
            else:
                self.text("<")
                at = mark + 1
        self.flush()

    def text(self, data: str) -> None:
        if self.skip_from is None:
            self.parts.append(data)

    def flush(self) -> None:
        if self.parts:
            if line := " ".join(unescape("".join(self.parts)).split()):
                self.lines.append((ARTICLE if self.articles else PLAIN, line))
            self.parts = []

    def start(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.text(" ")
            return
        if tag == "p" and self.open and self.open[-1] == "p":
            self.pop(len(self.open) - 1)  # a paragraph ends where the next begins
        if tag == "body" and self.depths.get("head"):
            self.pop(self.depths["head"][0])
        depth = len(self.open)
        self.open.append(tag)
        self.depths.setdefault(tag, []).append(depth)
        if tag in WALLS:
            self.walls.append(depth)
        # a heading inside the article is the article's own
        around = tag in AROUND and not (tag == "header" and self.articles)
        named = tag not in ("html", "body", "article", "main") and any(k in ("class", "id", "role") and v and any(map(around_article, v.split())) for k, v in attrs)
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        if self.skip_from is not None and tag in ("article", "main") and self.open[self.skip_from] == "form":
            self.skip_from = None  # a form around the whole page
        if self.skip_from is None and (tag in NO_TEXT or around or named or hidden):
            self.skip_from = depth
        if self.skip_from is None and (
            tag in ("article", "main")
            or tag in BLOCKS - {"body"} and any(k in ("class", "id", "role", "itemprop") and v and IS_ARTICLE & set(v.lower().split()) for k, v in attrs)
        ):
            self.articles.append(depth)

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in VOID or not self.depths.get(tag):
            return
        depth = self.depths[tag][-1]
        if tag in BLOCKS or not self.walls or self.walls[-1] <= depth:  # a stray inline end doesn't close a block
            self.pop(depth)

    def pop(self, depth: int) -> None:
        gone = self.open[depth:]
        if any(t in BLOCKS for t in gone):
            self.flush()
        for t in gone:
            self.depths[t].pop()
        for marks in (self.articles, self.walls):
            while marks and marks[-1] >= depth:
                marks.pop()
        del self.open[depth:]
        if self.skip_from is not None and depth <= self.skip_from:
            self.skip_from = None


def page_lines(html: str | None) -> tuple[list[str], bool]:
    """The lines of a page that may be its main text, and whether the page marks its article."""
    parser = _Lines()
    parser.feed(html or "")
    if any(kind == ARTICLE for kind, _ in parser.lines):
        return [line for kind, line in parser.lines if kind == ARTICLE], True
    return [line for _, line in parser.lines], False


def shared(a: list[int], b: list[int]) -> set[int]:
    """Positions of a in a longest common subsequence of a and b (linear memory)."""
    common = set(a) & set(b)
    pa_, pb = [i for i, x in enumerate(a) if x in common], [i for i, x in enumerate(b) if x in common]
    out: set[int] = set()
    todo = [(0, len(pa_), 0, len(pb))]
    av, bv = np.array([a[i] for i in pa_]), np.array([b[i] for i in pb])
    while todo:
        lo, hi, left, right = todo.pop()
        while lo < hi and left < right and av[lo] == bv[left]:
            out.add(pa_[lo])
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and av[hi - 1] == bv[right - 1]:
            out.add(pa_[hi - 1])
            hi, right = hi - 1, right - 1
        if lo >= hi or left >= right:
            continue
        if hi - lo == 1:
            if (bv[left:right] == av[lo]).any():
                out.add(pa_[lo])
            continue
        mid = (lo + hi) // 2
        up, down = _last_row(av[lo:mid], bv[left:right]), _last_row(av[mid:hi][::-1], bv[left:right][::-1])
        cut = left + int(np.argmax(up + down[::-1]))
        todo += [(lo, mid, left, cut), (mid, hi, cut, right)]
    return out


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return row


def _to_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(at, 128) for at in range(0, batch.num_rows, 128)):
            ids, urls, hosts, paths, html = part.columns
            made = [page_lines(x.as_py()) for x in html]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), urls, hosts, paths, pa.array([m[0] for m in made], pa.list_(pa.string())), pa.array([m[1] for m in made])], schema=LINES)


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key and the text of a page's lines without those that it shares with its mate."""
    for batch in batches:
        for part in (batch.slice(at, 128) for at in range(0, batch.num_rows, 128)):
            texts = []
            for lines, mate in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                gone = shared([hash(x) for x in lines], [hash(x) for x in mate])
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["host", "key", "text"])


def _common(a: str, b: str) -> Column:
    """Length of the common beginning of two columns; equal ones have the most."""
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
    return F.when(F.col(b).isNull(), -1).when(at == 0, F.lit(1 << 40)).otherwise(at)


def _mates(pages: DataFrame) -> DataFrame:
    """host, key, mate: the key of the nearest other page of the host. pages: host, path, key.

    Pages of one key are copies and count once, at their first path, so a page never meets its own copy.
    """
    once = pages.groupBy("host", "key").agg(F.min("path").alias("path"))
    placed = dense_ids(once.withColumn("order", F.struct("host", "path", "key")), "order").drop("order")
    beside = lambda step, s: placed.select((F.col("id") + step).alias("id"), *(F.col(c).alias(f"{c}_{s}") for c in ("host", "path", "key")))
    both = placed.join(beside(1, "b"), "id", "left").join(beside(-1, "a"), "id", "left")
    own = lambda s: F.when(F.col(f"host_{s}") == F.col("host"), F.col(f"path_{s}"))
    both = both.withColumns({"path_b": own("b"), "path_a": own("a")})
    mate = F.when(_common("path", "path_a") > _common("path", "path_b"), F.col("key_a")).otherwise(F.col("key_b"))
    return both.where("path_a is not null or path_b is not null").select("host", "key", mate.alias("mate"))


def difference(pages: DataFrame) -> DataFrame:
    """host, key, text of each distinct page that has a mate. pages: host, path, key, lines."""
    lines = pages.groupBy("host", "key").agg(F.first("lines").alias("lines"))
    pairs = _mates(pages).join(lines, ["host", "key"]).join(lines.select("host", F.col("key").alias("mate"), F.col("lines").alias("other")), ["host", "mate"])
    return pairs.select("host", "key", "lines", "other").mapInArrow(_difference, "host string, key string, text string")


def page_table(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, host, path, lines, marked of each row of pages, and key: a digest of the lines. Written once."""
    lines = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html")
    ).mapInArrow(_to_lines, "page_id long, url string, host string, path string, lines array<string>, marked boolean")
    return written(lines.withColumn("key", F.md5(F.array_join("lines", "\n").cast("binary"))))[0]


def site_lines(pages: DataFrame) -> DataFrame:
    """host, everywhere: the lines that more than half of a host's distinct pages hold, of hosts with four or more. pages: host, key, lines."""
    once = pages.groupBy("host", "key").agg(F.first("lines").alias("lines"))
    sizes = once.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    held = once.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("held")).where("held > 2")
    return held.join(sizes, "host").where("2 * held > n").groupBy("host").agg(F.collect_list("line").alias("everywhere"))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages.

    Every page is differenced against its mate. Without a marked article what differs is the text; inside a marked one a shared
    line goes only if the whole site has it, since two articles may share a sentence.
    """
    table = page_table(pages, page_id, url, html)
    whole = F.array_join("lines", "\n")
    texts = table.where(F.size("lines") == 0).select("page_id", "url", whole.alias("text"))
    plain, marked = (table.where(F.size("lines") > 0).where(c) for c in ("not marked", "marked"))
    if not plain.isEmpty():
        found = plain.join(difference(plain), ["host", "key"], "left")
        texts = texts.unionByName(found.select("page_id", "url", F.coalesce("text", whole).alias("text")))
    if not marked.isEmpty():
        named = lambda x: F.xxhash64(x).cast("string")
        hashed = marked.select("host", "path", "key", F.transform("lines", named).alias("lines"))  # the text stays where it is
        judged, _ = written(difference(hashed).withColumnRenamed("text", "differs").join(site_lines(hashed), "host"))
        stays = F.filter("lines", lambda x: ~F.array_contains("everywhere", named(x)) | F.array_contains(F.split("differs", "\n"), named(x)))
        found = marked.join(judged, ["host", "key"], "left")
        texts = texts.unionByName(found.select("page_id", "url", F.when(F.col("everywhere").isNull(), whole).otherwise(F.array_join(stays, "\n")).alias("text")))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
