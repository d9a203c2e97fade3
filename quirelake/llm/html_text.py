"""Main text of web pages by consensus paths of their hosts.

1. Every page is read into blocks of text with the path of containers they stand
   in, each container as its tag and its classes without digits.  A page's best
   container is the deepest that holds ``COVER`` of its good text, an article or
   main element before others; good text is weighed by the share that isn't links.
   Unless it is an article or main element, it gives way to the highest container
   above it that adds only headings and blocks that aren't mostly links, so an
   article's title and intro stay.  An article gives way to a main or article element
   around it, without what is mostly links there, and to another container if that
   adds only a title and what follows it, before an article that has none.
2. Each page votes for its best container's path; Spark sums the votes by host and
   path and chooses each host's winner.
3. Pages are read again, and the blocks below their host's winning path are the
   text.  A page takes those of its own best container if it has no such path, or if
   that container is around the winner, below body, or holds articles beside it.

What is a menu, notice, advert, comment or the like by its tag or role, is hidden, or
has a class or id all of whose words say so (``comment-list`` or ``ArticleComments``,
but not ``related-work`` or ``post-header``) is left out everywhere, inline elements
too.  So is a form, unless it holds at least ``FORM`` of the page's good text: then it
is a container.  Scripts, images and the like inside a sentence don't divide it.

Winning paths are broadcast while they are few (``BROADCAST_HOSTS`` and
``BROADCAST_BYTES``, measured first) and joined by host beyond that; adaptive
execution splits the pages of a large host there.

Reading takes time and memory in proportion to the page, however it is nested and
whatever is left open; containers are nodes of a tree, not strings.

Nulls, empty and odd rows: a null html counts as empty and gives the empty text; a very
long page is read whole, alone in its batch; pages with a null url are one host; ties
go to the path with more text, then the first by name; repeated rows give repeated
results and vote repeatedly; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, slices, table, written

#: Share of a page's good text that its best container holds.
COVER = 0.8
#: Least share that isn't links of a block that an article may gain, but for headings.
PLAIN = 0.5
#: Least share of a page's good text of a form that is a container.
FORM = 0.5
#: Most hosts whose paths are broadcast, and most characters of all hosts and paths.
BROADCAST_HOSTS, BROADCAST_BYTES = 50_000, 32 << 20

# Elements that hold no main text, elements whose content isn't
# markup, elements that end a block, inline elements that hold no text, roles, and
# words of classes and ids.
SKIPPED = set("head nav footer aside script style noscript template iframe button select textarea menu dialog object canvas audio video".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set("html head body main article section div nav aside header footer form ul ol li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address fieldset details summary hr menu dialog center hgroup search noscript template button select textarea object canvas audio video".split())
UNSEEN = set("svg annotation annotation-xml".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr thead tbody tfoot table ul ol dl caption figcaption figure address summary hgroup center".split())
CLOSED_BY_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert status menu menubar toolbar tablist form".split())
BOILERPLATE = set("ad ads adsbygoogle adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination pager paywall popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split())
# Words that say nothing of the content beside one of the former.
FURNITURE = set("a all and area articles author bar block body bottom box btn button buttons col column container content count crumb fixed float form global group header icons id inner item items js left link links list main media message meta mobile more new now outer overlay page panel posts primary reader right row secondary section site slot small social sticky stories text thread title to tool top unit us user users wrap wrapper your zone".split())
# Words of what follows a text, and those of the text that say nothing beside them, as
# in "post-comments", but do beside others, as in "post-header".
FOLLOWING = set("comment disqus pager pagination related replies reply respond share sharing".split())
TEXTS = set("article blog entry news post story".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_TO_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++)))?""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Letters of a word that may be two written as one, and of the first part at least.
JOINED, PART = 24, 4


class Tag(NamedTuple):
    """A tag's, comment's or declaration's place; the latter two have no name."""

    start: int
    end: int
    closing: bool
    name: str
    attributes: str


def tags(page: str) -> Iterator[Tag]:
    """The tags of ``page`` in order, without those in elements whose content isn't
    markup.  What is left open ends with the page."""
    at, quotes = 0, True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4) + 3
            at = end if end > 2 else len(page)
            yield Tag(start, at, False, "", "")
            continue
        closing = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closing)
        if not name:
            at = start + 1
            if closing or page[at : at + 1] in ("!", "?"):
                end = page.find(">", at)
                at = end + 1 if end >= 0 else len(page)
                yield Tag(start, at, False, "", "")
            continue
        to = _TO_END.match(page, name.end()) if quotes else None
        if to:
            at = to.end()
        else:  # an open quote: from here on quotes don't count
            quotes = False
            at = page.find(">", name.end()) + 1 or len(page)
        lower = name[0].lower()
        if lower in RAW and not closing:
            attributes = page[name.end() : at - 1]
            close = _RAW_END[lower].search(page, at)
            at = (page.find(">", close.end()) + 1 or len(page)) if close else len(page)
            yield Tag(start, at, False, lower, attributes)
        else:
            yield Tag(start, at, closing, lower, page[name.end() : at - 1])


def _boilerplate_in(word: str) -> str:
    """The word, its singular, or what is left of it without a word of furniture at its
    end or beginning, that is one of ``BOILERPLATE``; empty if there is none."""
    parts = [word, word.removesuffix("s")]
    for i in range(1, len(word)) if len(word) <= JOINED else ():
        parts += [word[:i]] * (i >= PART and word[i:] in FURNITURE) + [word[i:]] * (len(word) - i >= PART and word[:i] in FURNITURE)
    return next((x for x in parts if x in BOILERPLATE), "")


@functools.lru_cache(maxsize=1 << 14)
def _says_boilerplate(token: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(token)]
    says = [_boilerplate_in(w) for w in words]
    follows = any(x.removesuffix("s") in FOLLOWING for x in says)
    return any(says) and all(x or w in FURNITURE or follows and w in TEXTS for x, w in zip(says, words, strict=True))


def _attributes(text: str) -> tuple[str, bool]:
    """The classes for a path, and whether an element with these is left out."""
    if not text or text.isspace():
        return "", False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    tokens = found.get("class", "").replace(">", " ").split()
    out = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None
    out = out or found.get("role", "").lower() in ROLES or any(map(_says_boilerplate, [*tokens, found.get("id", "")]))
    return "".join("." + c for c in sorted({re.sub(r"\d+", "", c.lower()) for c in tokens}) if c), out


class Block(NamedTuple):
    """A block of text: its container, the share that isn't links, whether it is a
    heading."""

    node: int
    text: str
    plain: float
    heading: bool


class Page:
    """A page's blocks in order, without those that are left out, and its containers:
    a node for each path, after its parent."""

    def __init__(self, page: str):
        self.names, self.parents = [""], [-1]
        self.nodes: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self._read(page)
        self._core()

    def _node(self, parent: int, name: str) -> int:
        if (parent, name) not in self.nodes:
            self.nodes[parent, name] = len(self.names)
            self.names.append(name)
            self.parents.append(parent)
        return self.nodes[parent, name]

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, bool, bool, int]] = []  # tag, node, left out, in an article, in which form
        forms = 0
        form_of: list[int] = []  # of each block; 0: none
        opened: dict[str, int] = {}  # how many of each tag the stack has
        pieces: list[str] = []
        linked = at = 0
        in_link = False
        skipping, depth = "", 0  # an inline element that is left out, and how deep in it

        def flush() -> None:
            nonlocal linked
            _, node, out, _, form = stack[-1] if stack else ("", 0, False, False, 0)
            if pieces and not out:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    self.blocks.append(Block(node, text, max(0.0, 1 - linked / max(1, sum(map(len, pieces)))), bool(stack) and stack[-1][0] in HEADINGS))
                    form_of.append(form)
            pieces.clear()
            linked = 0

        def pop() -> None:
            opened[stack.pop()[0]] -= 1

        for tag in tags(page):
            if tag.start > at and not skipping:
                pieces.append(page[at : tag.start])
                linked += (tag.start - at) * in_link
            at = tag.end
            name = tag.name
            if not name or name in RAW:
                continue
            if name not in BLOCKS:
                if name == "br" and not skipping:
                    pieces.append(" ")
                elif name == "a":
                    in_link = not tag.closing
                if skipping:
                    depth += (name == skipping) * (-1 if tag.closing else 1)
                    skipping = skipping if depth else ""
                elif not tag.closing and name not in VOID and not tag.attributes.rstrip().endswith("/") and (name in UNSEEN or _attributes(tag.attributes)[1]):
                    skipping, depth = name, 1
                continue
            flush()
            in_link, skipping = False, ""
            if tag.closing:
                if opened.get(name):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                continue
            if name in VOID:
                continue
            while stack and (stack[-1][0] in CLOSED_BY_BLOCKS or stack[-1][0] in CLOSES.get(name, ())):
                pop()
            if tag.attributes.rstrip().endswith("/"):
                continue
            classes, out = _attributes(tag.attributes)
            _, node, above, inside, form = stack[-1] if stack else ("", 0, False, False, 0)
            core = name in ("article", "main")
            out = above or name in SKIPPED or out and not core and name not in ("html", "body") or name == "header" and not inside
            if name == "form" and not form:
                forms += 1
                form = forms
            stack.append((name, node if name in LEAVES else self._node(node, name + classes), out, inside or core, form))
            opened[name] = opened.get(name, 0) + 1
        if at < len(page) and not skipping:
            pieces.append(page[at:])
        flush()
        if forms:  # those that aren't containers go
            held = [0.0] * (forms + 1)
            for b, form in zip(self.blocks, form_of, strict=True):
                held[form] += len(b.text) * b.plain
            least = FORM * sum(held)
            self.blocks = [b for b, form in zip(self.blocks, form_of, strict=True) if not form or held[form] >= least > 0]

    def _core(self) -> None:
        """Which nodes are articles or main elements."""
        self.core = [name.split(".", 1)[0] in ("article", "main") for name in self.names]

    def sums(self, of) -> list[float]:
        """For each node, the sum of ``of`` a block over all blocks in and below it."""
        out = [0.0] * len(self.names)
        for b in self.blocks:
            out[b.node] += of(b)
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def path(self, node: int) -> str:
        """The names of a node and those above it, the outermost first."""
        names = []
        while node > 0:
            names.append(self.names[node])
            node = self.parents[node]
        return ">".join(reversed(names))

    def find(self, path: str) -> int:
        """The node of a path; -1 if there is none."""
        node = 0
        for name in path.split(">"):
            node = self.nodes.get((node, name), -1)
            if node < 0:
                break
        return node

    def best(self) -> tuple[int, float]:
        """The deepest node that holds ``COVER`` of the good text, or what it climbs to,
        and its good text's size; 0 is the page itself."""
        weight = self.sums(lambda b: len(b.text) * b.plain)
        if not weight[0]:
            return 0, 0.0
        depth, core = [0] * len(weight), self.core
        for i in range(1, len(weight)):
            depth[i] = depth[self.parents[i]] + 1
        fit = [i for i, w in enumerate(weight) if w >= COVER * weight[0]]
        best = max(fit, key=lambda i: (core[i], depth[i], weight[i], -i))
        best = self._around(best) if core[best] else self._climb(best)
        return best, weight[best]

    def _around(self, node: int) -> int:
        """The outermost article or main element around ``node``, and a container around
        that, below body, which adds only a title and what follows it, before an article
        that has no such."""
        up = node
        while up > 0:
            node = up if self.core[up] else node
            up = self.parents[up]
        every = self.sums(lambda b: 1)
        up = self.parents[node]
        while up > 0 and self.names[up].split(".", 1)[0] not in ("html", "body") and every[up] == every[node]:
            up = self.parents[up]
        if up <= 0 or self.names[up].split(".", 1)[0] in ("html", "body"):
            return node
        inside, above = self._inside(node), self._inside(up)
        own = [b for b in self.blocks if above[b.node]]
        first = next(i for i, b in enumerate(own) if inside[b.node])
        before = own[:first]
        titled = bool(before) and before[0].heading and not any(b.heading for b in own[first : first + 1])
        return up if titled and len(before) + every[node] == len(own) and all(b.heading or b.plain >= PLAIN for b in before) else node

    def _climb(self, node: int) -> int:
        """The highest ancestor all of whose further blocks are headings or not mostly
        links; one that adds no block isn't climbed to."""
        every, linked = self.sums(lambda b: 1), self.sums(lambda b: not b.heading and b.plain < PLAIN)
        best = node
        while node > 0 and self.parents[node] > 0:
            below, node = node, self.parents[node]
            if linked[node] > linked[below]:
                break
            if every[node] > every[below]:
                best = node
        return best

    def text(self, winner: str | None) -> str:
        """The text of the blocks below the winning path, or the page's own best one."""
        top = self.find(winner) if winner else -1
        own = self.best()[0]
        if top < 0 or not self._below(top) or self._holds_more(own, top):
            top = own
        return "\n".join(self._below(top))

    def _holds_more(self, own: int, top: int) -> bool:
        """Whether ``own`` is around ``top``, and below body, or holds articles beside."""
        inside, under = self._inside(own), self._inside(top)
        if under[own]:
            return False
        beside = any(inside[b.node] and not under[b.node] and self._in_core(b.node) for b in self.blocks)
        return beside or inside[top] and self.names[own].split(".", 1)[0] not in ("", "html", "body")

    def _in_core(self, node: int) -> bool:
        while node > 0 and not self.core[node]:
            node = self.parents[node]
        return node > 0

    def _inside(self, top: int) -> list[bool]:
        """For each node, whether it is ``top`` or below."""
        inside = [False] * len(self.names)
        for i, parent in enumerate(self.parents):
            inside[i] = i == top or parent >= 0 and inside[parent]
        return inside

    def _below(self, top: int) -> list[str]:
        """The texts below ``top``; beside an article in it that holds ``COVER`` of its
        good text, without blocks that are mostly links."""
        inside = self._inside(top)
        weight = self.sums(lambda b: len(b.text) * b.plain)
        cores = [i for i in range(top + 1, len(weight)) if inside[i] and self.core[i] and weight[i] >= COVER * weight[top] > 0]
        within = self._inside(cores[-1]) if cores else inside
        return [b.text for b in self.blocks if inside[b.node] and (within[b.node] or b.heading or b.plain >= PLAIN)]


def host(url: str | None) -> str:
    """The host of ``url`` in lower case; empty without one."""
    try:
        return (urlsplit(url or "").netloc or "").lower()
    except ValueError:
        return ""


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes) of each host's winning path."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64())])
        for batch, texts in slices(batches, "html"):
            rows = []
            for u, t in zip(batch.column(batch.schema.get_field_index("url")).to_pylist(), texts, strict=True):
                page = Page(t.decode())
                node, size = page.best()
                if node:
                    rows.append((host(u), page.path(node), size))
            yield record_batch({"host": [r[0] for r in rows], "path": [r[1] for r in rows], "score": [r[2] for r in rows]}, schema)

    votes = pages.select("url", "html").mapInArrow(vote, "host string, path string, score double").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum(F.floor("score")).alias("score"))
    # most votes, then most text, then the first name: the least of negated numbers
    return votes.groupBy("host").agg(F.min(F.struct(-F.col("votes"), -F.col("score"), "path")).alias("top")).select("host", F.col("top.path").alias("path"), (-F.col("top.col1")).alias("votes"))


def main_text(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(page_id, url, text) of ``pages`` (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = written(host_paths(pages), "host-paths")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def rewrite(batches: Iterator[pa.RecordBatch], paths) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "html"):
            yield record_batch({"page_id": batch.column(0).to_pylist(), "url": batch.column(1).to_pylist(), "text": [Page(t.decode()).text(w) for t, w in zip(texts, paths(batch), strict=True)]}, schema)

    sizes = winners.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("host") + F.length("path")).alias("size")).first()
    if sizes.n <= broadcast_hosts and (sizes.size or 0) <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.path for r in winners.toLocalIterator()})

        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from rewrite(batches, lambda b: [shared.value.get(host(u)) for u in b.column(1).to_pylist()])

        return pages.mapInArrow(by_broadcast, "page_id long, url string, text string")

    def by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rewrite(batches, lambda b: b.column(3).to_pylist())

    hosts = F.pandas_udf(lambda u: u.map(host), "string")
    return pages.withColumn("host", hosts("url")).join(winners.select("host", "path"), "host", "left").select("page_id", "url", "html", "path").mapInArrow(by_join, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all ``pages``."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
