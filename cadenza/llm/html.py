"""Main text of web pages by consensus paths of their hosts.

Pages of a host share templates.  Each page's containers are scored by the paragraphs they
hold; the best one votes for its generalised path (tags and classes from the root, numbers
struck out).  Spark counts the votes of each host, and every page is extracted again from the
first of its host's winning paths that it has.  A page without any of them keeps its own best
container.  Menus, headers, footers, forms, adverts, notices, comments and the like are left
out wherever they stand.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

#: Paths with at least this share of a host's votes win, best first.
SHARE = 0.1
#: Most hosts whose paths are broadcast; beyond, the pages of a host are dealt into so many parts.
HOSTS = 100_000
SALTS = 64
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

# Element names of the HTML standard by their role here, and words that sites use for page furniture.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
FURNITURE_TAGS = frozenset("nav footer aside form button select option svg canvas audio video object embed dialog menu head map math".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion cookie cookies consent gdpr notice
    notices notification alert newsletter subscribe subscription signup signin login register social share sharing related recommended
    recommendations sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments
    disqus replies respond popup modal overlay toolbar pagination pager copyright disclaimer search banner""".split()
)
CONTENT_NAMES = frozenset("content article main post entry story article-body post-content entry-content article-content post-body story-body main-content".split())
CLOSES_P = frozenset(
    """address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p
    pre section table ul li""".split()
)
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li td dd".split())
MAIN = frozenset("article main".split())


BLANK = np.array([i for i in range(65_536) if chr(i).isspace()], np.uint32)


@dataclass
class Node:
    tag: str
    name: str  # tag with generalised classes
    parent: int
    furniture: bool
    inside: bool  # an article or main element holds it
    end: int = 0  # of its pieces of text
    begin: int = 0
    score: float = 0.0
    path: int = 0  # number of its path in the page


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    pieces: list[tuple[str, bool]] = field(default_factory=list)  # text, and whether it is furniture
    paths: dict[tuple[int, str], int] = field(default_factory=dict)  # number of a path by its parent's and its last name


def generalised(name: str) -> str:
    return re.sub(r"\d+", "#", name.lower()).replace("/", ":")  # a slash divides paths


def parts(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]


def furnished(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is page furniture by its tag, role, visibility or names."""
    if tag in FURNITURE_TAGS or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in FURNITURE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "main", "article") or tag[0] == "h" and tag[1:].isdigit():
        return False
    names = [*attributes.get("class", "").split(), *attributes.get("id", "").split()]
    if any(n.lower() in CONTENT_NAMES for n in names):
        return False
    for n in names:
        w = parts(n)
        if w and w[0] not in ("with", "has", "no", "is") and (w[0] in FURNITURE_WORDS or w[-1] in FURNITURE_WORDS):
            return True
    return False


def parse(html: str) -> Page:
    """Elements and pieces of text of a page, as far as it can be read; unclosed elements end with their parents."""
    page = Page([Node("", "", -1, False, False)], [])
    nodes, pieces = page.nodes, page.pieces
    stack = [0]
    unclosed: Counter = Counter()

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = nodes[stack.pop()]
            node.end = len(pieces)
            unclosed[node.tag] -= 1

    def text(raw: str) -> None:
        if raw:
            top = nodes[stack[-1]]
            pieces.append((unescape(raw) if "&" in raw else raw, top.furniture))

    at = 0
    while True:
        m = MARKUP.search(html, at)
        text(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        block = tag not in INLINE
        if m[1] or m[4]:
            if block:
                pieces.append((" ", False))
            for depth in range(len(stack) - 1, 0, -1) if unclosed[tag] else ():
                if nodes[stack[depth]].tag == tag:
                    close(depth)
                    break
            continue
        if block:
            pieces.append((" ", False))
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])|\Z", re.I).search(html, at)
            stop = html.find(">", end.start())
            at = len(html) if stop < 0 else stop + 1
            continue
        if tag in CLOSES_P and unclosed["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                t = nodes[stack[depth]].tag
                if t == "p":
                    close(depth)
                    break
                if t not in INLINE:
                    break
        if tag in CLOSED_BY_SAME:
            for depth in range(len(stack) - 1, 0, -1):
                t = nodes[stack[depth]].tag
                if t == tag or {t, tag} in ({"dt", "dd"}, {"td", "th"}):
                    close(depth)
                    break
                if t in CLOSED_BY_SAME[tag]:
                    break
        raw = m[3] or m[6] or ""
        attributes = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}
        above = nodes[stack[-1]]
        furniture = above.furniture or furnished(tag, attributes, above.inside)
        name = ".".join([tag, *sorted({generalised(c) for c in attributes.get("class", "").split()})]) if attributes.get("class") else tag
        number = page.paths.setdefault((above.path, name), len(page.paths) + 1)
        nodes.append(Node(tag, name, stack[-1], furniture, above.inside or tag in MAIN, begin=len(pieces), path=number))
        if not raw.endswith("/") or tag in CLOSES_P or tag in INLINE:
            stack.append(len(nodes) - 1)
            unclosed[tag] += 1
        else:
            nodes[-1].end = len(pieces)
    close(1)
    nodes[0].end = len(pieces)
    return page


def content(page: Page, node: Node) -> str:
    """The text of an element without furniture; blocks and white space become single spaces."""
    return " ".join("".join([t for t, furniture in page.pieces[node.begin : node.end] if not furniture]).split())


def path(page: Page, i: int) -> str:
    names = []
    while i > 0:
        names.append(page.nodes[i].name)
        i = page.nodes[i].parent
    return "/".join(reversed(names))


def numbered(page: Page, wanted: str) -> int:
    """The number of a path in the page, 0 if the page does not have it."""
    number = 0
    for name in wanted.split("/"):
        number = page.paths.get((number, name), 0)
        if not number:
            return 0
    return number


class Measures:
    """Length and commas of the text of any element, from running sums over the page."""

    def __init__(self, page: Page):
        kept = [t if not furniture else "" for t, furniture in page.pieces]
        self.place = list(accumulate(map(len, kept), initial=0))
        code = np.frombuffer("".join(kept).encode("utf-32-le", "surrogatepass"), "<u4")
        word = ~np.isin(code, BLANK)
        begins = word & ~np.append(False, word[:-1])
        sums = lambda x: np.append(0, np.cumsum(x)).tolist()
        self.word, self.chars, self.words, self.commas = np.append(word, False).tolist(), sums(word), sums(begins), sums(code == 44)

    def of(self, node: Node) -> tuple[int, int]:
        """Code points of ``content`` of the element, and commas in it."""
        a, b = self.place[node.begin], self.place[node.end]
        words = self.words[b] - self.words[a]
        if a < b and self.word[a] and a and self.word[a - 1]:
            words += 1  # the element begins inside a word
        return self.chars[b] - self.chars[a] + max(0, words - 1), self.commas[b] - self.commas[a]


def best(page: Page) -> int:
    """The container that holds most of the paragraphs; 0, the whole page, if none does."""
    nodes = page.nodes
    measures = Measures(page)
    begins = [n.begin for n in nodes]  # elements are in page order
    linked = list(accumulate((measures.of(n)[0] if n.tag == "a" and not n.furniture else 0 for n in nodes), initial=0))
    for i, n in enumerate(nodes[1:], 1):
        if n.furniture or n.tag not in PARAGRAPHS:
            continue
        size, commas = measures.of(n)
        if n.tag in ("li", "td", "dd") and size < 40:
            continue
        points = min(size / 100, 5) + commas * 0.2 + (1 if size >= 25 else 0.1)
        links = linked[bisect_left(begins, n.end, i + 1)] - linked[i + 1]
        points *= 1 - min(1, links / max(1, size))
        up, weight = n.parent, 1.0
        while up >= 0 and weight > 0.2:
            nodes[up].score += points * weight
            up, weight = nodes[up].parent, weight * 0.5
    ranked = [(n.score * (1.5 if n.tag in MAIN else 1.0) + (0.5 if n.tag in MAIN else 0.0), -i) for i, n in enumerate(nodes) if not n.furniture and n.tag not in INLINE and n.tag not in ("html", "head")]
    score, i = max(ranked, default=(0, 0))
    return -i if score > 0 else 0


def extract(page: Page, wanted: list[str]) -> str:
    """The text of the elements on the first of the ``wanted`` paths that the page has, else of its best container."""
    if wanted:
        numbers = [numbered(page, w) for w in wanted]
        found: dict[int, list[Node]] = {k: [] for k in numbers if k}
        for n in page.nodes[1:]:
            if n.path in found and not n.furniture:
                found[n.path].append(n)
        for k in numbers:
            own = [t for t in (content(page, n) for n in found.get(k, [])) if t]
            if own:
                return " ".join(own)
    return content(page, page.nodes[best(page)])


def host(url: str = "url") -> Column:
    """Host of an address in lower case; empty without one."""
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): how many pages of a host have their best container there."""

    def run(batches):
        for batch in batches:
            count: Counter = Counter()
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = parse(html.as_py() or "")
                i = best(page)
                if i:
                    count[h, path(page, i)] += 1
            keys = list(count)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(count.values(), pa.int64())], names=["host", "path", "n"])

    counted = pages.select(host().alias("host"), "html").mapInArrow(run, "host string, path string, n long")
    return counted.groupBy("host", "path").agg(F.sum("n").alias("votes"))


def winners(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): paths with at least ``share`` of the host's votes, most votes first; at most 1 / share of them."""
    total = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    ahead = counted.join(total, "host").where(F.col("votes") >= share * F.col("total"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return ahead.groupBy("host").agg(ordered["path"].alias("paths"))


def main_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds text and n_chars (code points) to every row of ``pages`` (url, html).

    A null or empty page, and one with nothing but furniture, has empty text; pages of any depth are
    read in time in proportion to their length.  Pages without
    url vote together.  Columns named text or n_chars are replaced, repeated rows stay, an
    empty table stays empty.
    """
    won = common.stage(winners(common.stage(votes(pages), "votes")), "winners").withColumnRenamed("host", "__host").withColumnRenamed("paths", "__paths")
    named, key = pages.withColumn("__host", host()), ["__host"]
    if won.count() > HOSTS:
        # too many hosts for a broadcast: a host's pages are dealt out, its paths repeated
        named, key = named.withColumn("__salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")), ["__host", "__salt"]
        won = won.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    else:
        won = F.broadcast(won)
    joined = named.join(won, key, "left")

    def extracted(html, paths):
        found = [extract(parse(h.as_py()), p or []) if h.as_py() else "" for h, p in zip(html, paths.to_pylist(), strict=True)]
        return found, [len(t) for t in found]

    columns = [c for c in pages.columns if c not in ("__host", "__paths", "__salt")] if keep is None else keep
    return common.with_columns(joined, extracted, ["html", "__paths"], "text string, n_chars long", columns)
