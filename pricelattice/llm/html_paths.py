"""Main text of web pages by consensus host paths.

A first pass scores the containers of every page: text in paragraphs counts for a container, text in links against it, as do
roles such as navigation or comments. Each page votes for its best containers, named by *generalised paths*: tag and class
names from the root, digits and repetitions left out. Votes are added up per host in Spark (partial sums first, so a host
that holds a third of all pages is no hot group). A second pass extracts every page by its host's winning paths; a page that
has none of them (a different layout, or one of a kind) uses its own best container.

A page is read by one scan over its tags with a stack; unclosed ``p``, ``li`` and the like close as in browsers, anything else
left open closes with its parent or the page. A tag ends at its first ``>`` outside quotes; a quote that never closes is a
character, and a tag without such a ``>`` ends at the first one at all. Cost is linear in the page, however deep it nests and whatever its quotes:
containers point to the one around them, and paths of more than ``LONG_PATH`` characters begin with a digest of what lies above.

Defined results: null or empty html, or a page without text, gives an empty text; a null url is a host of its own; repeated
rows give repeated results; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Element names of HTML by their part in a page.
SILENT = frozenset("script style noscript template svg math iframe object canvas head title select option textarea button form input label".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption
    blockquote pre figure figcaption header footer nav aside address details summary hr center fieldset""".split())
CONTAINER = frozenset("body main article section div td".split())
ASIDE = frozenset("nav header footer aside dialog menu".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names and roles of parts that are not the article.
SIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer\w*|foot|header|masthead|"
    r"cookies?|consent|gdpr|notice\w*|popup|modal|newsletter|subscri\w*|signup|login|comments?|comment\w*|disqus|replies|respond|share\w*|sharing|"
    r"social\w*|related\w*|recommend\w*|widget\w*|toolbar|pagination|pager|tags?|search\w*|skip|hidden|legal|copyright|toc|teaser\w*)(?=$|[\s_-])", re.I)
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

_name = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
_turn = re.compile("[>\"']")
_attribute = re.compile(r"([^\s=\"'<>/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?")
_gap = re.compile(r"\s+")
#: Longer paths begin with a digest of what lies above.
LONG_PATH = 1_000


class _Tags:
    """The tags of a page from left to right, in time linear in its length whatever its quotes: where an attribute list ends is
    remembered for every place behind a closing quote, so no stretch is read twice."""

    def __init__(self, html: str):
        self.html, self.ends = html, {}
        self.ahead: dict[str, int] = {}
        self.special = -1

    def find(self, what: str, at: int) -> int:
        """First place of ``what`` at or after ``at``, remembered while places ascend; the page's length if there is none."""
        known = self.ahead.get(what, -1)
        if known < at:
            known = self.html.find(what, at)
            known = self.ahead[what] = len(self.html) if known < 0 else known
        return known

    def _next_turn(self, at: int) -> int:
        if self.special < at:
            found = _turn.search(self.html, at)
            self.special = found.start() if found else len(self.html)
        return self.special

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes begin at ``at``; quoted ones don't count, a quote that is never
        closed is a character. A tag that has none outside quotes ends at its first ``>``; -1 if there is none at all."""
        html, size, passed, here = self.html, len(self.html), [], at
        while (found := self.ends.get(here)) is None:
            turn = self._next_turn(here) if here >= at else size
            if turn == size or html[turn] == ">":
                found = turn
                break
            passed.append(here)
            close = self.find(html[turn], turn + 1) if turn + 1 < size else size
            here = (close if close < size else turn) + 1
        for place in (*passed, here):
            self.ends[place] = found
        if found < size:
            return found
        return html.find(">", at)

    def __iter__(self):
        """Each tag as (start, end, closing, name, attributes); comments and declarations with no name."""
        html, size, at = self.html, len(self.html), 0
        while (start := html.find("<", at)) >= 0:
            if html.startswith(("<!--", "<![CDATA["), start):
                mark = "-->" if html.startswith("<!--", start) else "]]>"
                end = html.find(mark, start + (4 if mark == "-->" else 9))
                end, piece = (size if end < 0 else end + 3), None
            elif html.startswith(("<!", "<?"), start):
                end = html.find(">", start)
                end, piece = (size if end < 0 else end + 1), None
            elif (name := _name.match(html, start + 1)) is None:
                at = start + 1
                continue
            else:
                end = self.end(name.end())
                if end < 0:
                    return
                end, piece = end + 1, (html[start + 1] == "/", name[1].lower(), html[name.end():end])
            skip = yield start, end, piece
            at = skip or end


class _Node:
    __slots__ = ("tag", "path", "side", "text", "links", "blocks", "within", "base", "run_links")

    def __init__(self, tag: str, path: str, side: bool, within: int, base: int, run_links: int):
        self.tag, self.path, self.side, self.within, self.base, self.run_links = tag, path, side, within, base, run_links
        self.text = self.links = self.blocks = 0


def _look(tag: str, attributes: str) -> tuple[str, bool]:
    """Generalised name of an element, and whether it is beside the article."""
    side, name = tag in ASIDE, tag
    if attributes and not attributes.isspace():
        given = {k.lower(): v.strip("\"'") for k, v in _attribute.findall(attributes) if v}
        names = f"{given.get('class', '')} {given.get('id', '')}".strip()
        if names:
            side = side or (tag not in ("body", "html", "article", "main") and bool(SIDE_WORDS.search(unescape(names))))
            kinds = sorted({re.sub(r"\d+", "", c).strip("-_") for c in given.get("class", "").split()} - {""})
            name = f"{tag}.{'.'.join(kinds)}" if kinds else tag
        side = side or given.get("role", "").lower() in SIDE_ROLES or given.get("aria-hidden") == "true" or re.search(
            r"display\s*:\s*none", given.get("style", ""), re.I) is not None or bool(re.search(r"(?:^|\s)hidden(?=$|[\s=/])", attributes, re.I))
    return name, side


def blocks(html: str) -> tuple[list[tuple[str, int, bool, int]], list[_Node]]:
    """The page's text blocks in order (text, number of the nearest container or -1, beside the article, characters in links) and its
    containers; a container's ``within`` is the number of the next one around it, always a lower one."""
    root = _Node("", "", False, -1, 0, 0)
    stack, nodes, out = [root], [], []
    parts: list[str] = []
    linked, silent = 0, 0
    open_: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _gap.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                top = stack[-1]
                in_links = min(linked, len(text))
                home = homes[-1] if homes else -1
                out.append((text, home, top.side, in_links))
                if home >= 0 and not top.side:
                    node = nodes[home]
                    node.text, node.links, node.blocks = node.text + len(text), node.links + in_links, node.blocks + 1
        linked = 0

    homes: list[int] = []  # numbers of the open containers

    def pop() -> None:
        nonlocal silent
        node = stack.pop()
        open_[node.tag] -= 1
        if node.tag in CONTAINER:
            homes.pop()
        if node.tag in SILENT:
            silent -= 1

    at, tags = 0, _Tags(html)
    pieces, skip = iter(tags), None
    while True:
        try:
            start, end, piece = pieces.send(skip)
        except StopIteration:
            start, end, piece = len(html), -1, None
        skip = None
        if start > at and not silent:
            text = html[at:start]
            parts.append(text)
            if open_["a"]:
                linked += len(text.strip())
        if end < 0:
            break
        at = end
        if piece is None:
            continue
        closing, tag, attributes = piece
        if tag == "br" and not silent:
            parts.append(" ")
        if closing:
            if open_[tag] > 0:
                if tag in BLOCK:
                    flush()
                while stack[-1].tag != tag:
                    pop()
                pop()
            elif tag == "p":
                flush()
            continue
        if tag in BLOCK:
            flush()
            # an open paragraph ends where a block begins, and so do its unclosed inline elements
            k = stack[-1].base
            if stack[k].tag == "p" or (stack[k].tag in HEADINGS and tag in HEADINGS):
                while len(stack) > k:
                    pop()
            elif not stack[-1].run_links:
                while len(stack) > k + 1:
                    pop()
            same = CLOSES.get(tag, "").split()
            if same and stack[-1].tag in same:
                while stack[-1].tag in same:
                    pop()
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        parent = stack[-1]
        name, side = _look(tag, attributes)
        path = _below(parent.path, name) if tag in BLOCK else parent.path
        # a header within the article holds its heading; one outside is the site's
        if tag == "header" and not parent.side and open_["article"] + open_["main"] > 0:
            side = parent.side or bool(SIDE_WORDS.search(re.sub(r"(?i)header", "", name.partition(".")[2].replace(".", " "))))
        inline = tag in INLINE
        node = _Node(tag, path, parent.side or side, homes[-1] if homes else -1, parent.base if inline else len(stack), (parent.run_links if inline else 0) + (inline and tag == "a"))
        if tag in CONTAINER:
            homes.append(len(nodes))
            nodes.append(node)
        stack.append(node)
        open_[tag] += 1
        if tag in SILENT:
            silent += 1
        if tag in RAW:
            close = re.compile(f"</{tag}\\s*>", re.I).search(html, at)
            skip = at = close.end() if close else len(html)
            pop()
    flush()
    for node in reversed(nodes):  # what lies in a container lies in those around it
        if node.within >= 0 and not node.side:
            around = nodes[node.within]
            around.text, around.links, around.blocks = around.text + node.text, around.links + node.links, around.blocks + node.blocks
    return out, nodes


def _below(path: str, name: str) -> str:
    if len(path) > LONG_PATH:
        path = f"#{hashlib.md5(path.encode('utf-8', 'surrogatepass')).hexdigest()}"
    return f"{path}/{name}"


def _score(node: _Node, total: int) -> float:
    """Share of the page's article-like text, less what sits in links; named article parts count for more."""
    if node.side or not node.text:
        return 0.0
    gain = (node.text - 2 * node.links) / max(total, 1)
    return gain * {"article": 1.6, "main": 1.4, "body": 0.9}.get(node.tag, 1.2 if "content" in node.path.rpartition("/")[2] else 1.0)


def votes(page: tuple[list, list[_Node]], most: int = 3) -> list[tuple[str, float]]:
    """A page's best containers by generalised path: of those with nearly all of the best's text, inner ones first."""
    found, nodes = page
    total = sum(len(t) for t, _, side, _ in found if not side)
    best: dict[str, float] = {}
    for depth, node in enumerate(nodes):
        value = _score(node, total)
        if value > 0.1:
            best[node.path] = best.get(node.path, 0.0) + value
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:most]


def text_of(page: tuple[list, list[_Node]], paths: list[str]) -> str:
    """The text under the first of ``paths`` that the page has; else under its own best container; else all that isn't beside it."""
    found, nodes = page
    for path in [*paths, *(p for p, _ in votes(page))]:
        inside: list[bool] = []
        for n in nodes:
            inside.append(n.path == path and not n.side or n.within >= 0 and inside[n.within])
        lines = [t for t, at, side, _ in found if not side and at >= 0 and inside[at]]
        if lines:
            return "\n".join(lines)
    return "\n".join(t for t, _, side, linked in found if not side and 2 * linked <= len(t))


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
WINNERS = 3


def host_paths(pages: DataFrame, winners: int = WINNERS) -> DataFrame:
    """``host, paths``: each host's paths by votes. Every page adds its scores; sums per host and path are combined before the shuffle."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, v) for h, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()) for p, v in votes(blocks(html))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["host", "path", "vote"])

    cast = _named(pages).select("host", "html").mapInArrow(vote, "host string, path string, vote double")
    tally = cast.groupBy("host", "path").agg(F.sum("vote").cast("decimal(20,6)").alias("votes"))
    # Spark limits the ranks per task before the shuffle, so that only the best few paths of a task reach their host's task
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("path")))
    best = tally.filter("votes >= 0.5").withColumn("place", place).filter(F.col("place") <= winners)
    top = F.sort_array(F.collect_list(F.struct("place", "path")))
    return best.groupBy("host").agg(top.alias("top")).select("host", F.col("top.path").alias("paths"))


def _named(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), HOST, 1))
    return pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))


def extract(pages: DataFrame, winners: int = WINNERS) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(blocks(html), paths or []) for html, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    # written first: with its size known, a small table goes to the pages, and a large one leaves hot hosts to be split
    paths = stored(host_paths(pages, winners), "paths")
    return _named(pages).join(paths, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(
        take, f"page_id {kind}, url string, text string, n_chars bigint")
