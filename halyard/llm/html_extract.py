"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text that stands in them; each page votes for its best container paths (tags
and classes, digits generalised), votes are summed by host in Spark, and each page is extracted again from the containers
on its host's winning path. A page without such a container uses its own best one; where the host's containers hold less
than ``COVER`` of what the page's own best ones hold, both are taken.

A path is where text is dense, such as the sections of an article; what is extracted is the whole article around it (see ``_lift``).

Tags that mean furniture (navigation, headers and footers of the page, asides, forms, dialogs) are left out. Names are a hint only: a container
whose class, id or role names furniture counts a quarter, and what it holds is left out unless the winning path leads
through it. A name that has other words too ("share-price") halves a container's score and drops its lists of links.

Time and memory are linear in the page's length: containers are a tree of parent pointers in page order, paths are interned step by step, and what an ancestor
needs to know is summed once, from the leaves up or from the root down.

Defined cases: malformed tags are read as ``markup.tags`` states; containers that are never closed nest as deep as they stand; null or empty html, or a page without text, gives an empty text; a null url, or one without a host, belongs
to the host ''; equal pages vote each; ties between paths go to the greater path; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_slices
from .markup import attributes, tags

_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_CONTAINERS = frozenset("html body main article section div td center form nav header footer aside ul ol dl table tr tbody details fieldset figure head dialog".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre address figcaption caption th summary legend option hr".split())
_OUTSIDE = frozenset("head nav footer aside form dialog button".split())
_OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus respond reply replies related recommended"
    " recommendations footer copyright pagination pager toolbar widget widgets skip search".split()
)
#: Words that say nothing beside a name of furniture: "comment-list" is a list of comments, "share-price" no share button.
_PLAIN_NAMES = frozenset(
    "area articles bar bars block body bottom box button buttons center col column container content feed footer form global group header holder icons inner item items"
    " layout left link links list main module outer page panel posts post primary reader readers right row section secondary site slot stories the thread tools top unit user users wrap wrapper".split()
)
_TITLE_NAMES = frozenset("header masthead topbar".split())
_CONTENT_NAMES = frozenset("article content entry post story main text body".split())
_STORY_NAMES = frozenset("article entry post story".split())
_PAGE_NAMES = frozenset("sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead topbar footer copyright toolbar skip".split())
VOTES = 3
COVER = 0.8
HINTED, PARTLY = 0.25, 0.5  # what text counts below a name of furniture, and below one with other words


def _furniture_name(values: list[str], names: frozenset[str]) -> int:
    """2 if a class, id or role names furniture and nothing else, 1 if it has such a word among others, 0 if none has."""
    found = 0
    for value in values:
        for token in value.split():
            words = [w for w in _SPLIT.split(token) if w and not w.isdigit()]
            if any(w in names for w in words):
                found = max(found, 2 if all(w in names or w in _PLAIN_NAMES for w in words) else 1)
    return found


class _Node:
    """A container. ``own_links`` are the link blocks directly in it, ``links`` all inside, ``furniture`` the page furniture inside: navigation, mastheads, footers."""

    __slots__ = ("parent", "tag", "path", "outside", "content", "whole", "top", "story", "hint", "is_furniture", "furniture", "direct", "links", "own_links")

    def __init__(self, parent: _Node | None, tag: str, path: int = -1, outside: bool = False, content: bool = False, whole: bool = False, story: bool = False, hint: int = 0, is_furniture: bool = False):
        self.parent, self.tag, self.path, self.outside, self.content, self.whole, self.story, self.hint = parent, tag, path, outside, content, whole, story, hint
        self.top: _Node | None = None if parent is None else parent.top or (parent if parent.whole else None)  # the outermost article or main around it
        self.is_furniture = is_furniture
        self.direct = False  # running text stands in it directly
        self.furniture = self.links = self.own_links = 0


class _Page:
    """A page's containers in page order, and its text blocks outside of furniture tags: text, container, hint of the block's own names, share of text in links."""

    def __init__(self) -> None:
        self.nodes = [_Node(None, "")]
        self.blocks: list[tuple[str, _Node, int, float]] = []
        self._steps: dict[tuple[int, str], int] = {}  # (path above, step) -> path
        self._names: list[tuple[int, str]] = []

    def path(self, above: int, step: str) -> int:
        found = self._steps.setdefault((above, step), len(self._names))
        if found == len(self._names):
            self._names.append((above, step))
        return found

    def path_text(self, path: int) -> str:
        steps = []
        while path >= 0:
            path, step = self._names[path]
            steps.append(step)
        return "".join(f">{s}" for s in reversed(steps))

    def find_path(self, text: str | None) -> int | None:
        """The number of a path on this page."""
        found: int | None = None
        for step in (text or "").split(">")[1:]:
            found = self._steps.get((-1 if found is None else found, step))
            if found is None:
                return None
        return found

    def sum_up(self) -> None:
        for c in reversed(self.nodes):
            c.links += c.own_links
            if c.parent is not None:
                c.parent.links += c.links
                c.parent.furniture += c.furniture + c.is_furniture


def _read(html: str) -> _Page:
    page = _Page()
    stack = [page.nodes[0]]
    opened: dict[str, int] = defaultdict(int)  # open containers by tag
    text: list[str] = []
    linked = at = 0
    in_link = False
    hinted = 0  # of a block whose own names are of furniture

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join(unescape("".join(text)).split())
            text.clear()
            inner = stack[-1]
            if block and not inner.outside:
                share = min(1.0, linked / len(block))
                page.blocks.append((block, inner, hinted, share))
                if share <= 0.5:
                    inner.direct = inner.direct or not hinted
                else:
                    inner.own_links += 1
        linked = 0

    for start, end, tag, closing, attrs in tags(html):
        if start > at:
            piece = html[at:start]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = end
        if not tag:
            continue
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            text.append(" ")
        elif tag in _CONTAINERS or tag == "button":
            flush()
            hinted = 0
            if closing:
                while opened[tag]:
                    last = stack.pop().tag
                    opened[last] -= 1
                    if last == tag:
                        break
            else:
                inner = stack[-1]
                given = _named(attrs)
                words = {w for v in given.values() for w in _SPLIT.split(v)}
                whole = tag in ("article", "main") or given.get("role") in ("article", "main")
                content = inner.content or tag in ("article", "main")
                outside = inner.outside or tag in _OUTSIDE or (tag == "header" and not content)
                hint = 0
                if tag not in ("html", "body", "article", "main") and given:
                    hint = _furniture_name(list(given.values()), _OUTSIDE_NAMES)
                    if hint < 2 and not content:
                        hint = max(hint, _furniture_name(list(given.values()), _TITLE_NAMES))
                furniture = (outside and not inner.outside and (tag in ("nav", "header", "footer") or bool(words & _PAGE_NAMES))) or (hint == 2 and bool(words & _PAGE_NAMES))
                story = tag not in ("html", "body") and bool(words & _STORY_NAMES)
                names = sorted({_DIGITS.sub("0", x) for x in given.get("class", "").replace(">", "").split()})
                path = page.path(inner.path, ".".join([tag, *names]))
                stack.append(_Node(inner, tag, path, outside, content or bool(words & _CONTENT_NAMES), whole, story, hint, furniture))
                opened[tag] += 1
                page.nodes.append(stack[-1])
        elif tag in _BLOCKS:
            flush()
            hinted = 0
            if not closing and (given := _named(attrs)):
                hinted = _furniture_name(list(given.values()), _OUTSIDE_NAMES)
    if at < len(html):
        text.append(html[at:])
    flush()
    page.sum_up()
    return page


def _named(attrs: str) -> dict[str, str]:
    """Class, id and role of a tag, in lower case."""
    if not attrs.strip():
        return {}
    return {k: v.lower() for k, v in attributes(attrs).items() if k in ("class", "id", "role") and v}


def _scores(page: _Page) -> dict[int, float]:
    scores: dict[int, float] = defaultdict(float)
    for block, inner, hinted, links in page.blocks:
        worth = len(block) * (1 - links)
        if hinted:
            worth *= HINTED if hinted == 2 else PARTLY
        c, k = inner, 1 if hinted else 0  # a block with names of its own is a level too
        while c.parent is not None and k <= 6:
            if c.hint:
                worth *= HINTED if c.hint == 2 else PARTLY
            scores[c.path] += worth * 0.5**k * (1.5 if c.content else 1.0)
            c, k = c.parent, k + 1
    return scores


def container_scores(html: str | None) -> dict[str, float]:
    """Score of each container path: the letters of the blocks inside, less those in links, halved for each level in between."""
    page = _read(html or "")
    return {page.path_text(p): s for p, s in _scores(page).items()}


def _votes(page: _Page) -> list[tuple[str, int]]:
    best = sorted(_scores(page).items(), key=lambda x: (-x[1], x[0]))[:VOTES]  # of equal scores, the path that the page has first
    return [(page.path_text(p), int(1000 * s / best[0][1])) for p, s in best if best[0][1] > 0]


def page_votes(html: str | None) -> list[tuple[str, int]]:
    """The page's best paths with their share of its best score, in thousandths."""
    return _votes(_read(html or ""))


def _lift(c: _Node, lifted: dict[_Node, _Node]) -> _Node:
    """The container that holds the whole article of ``c``: its outermost article or main, if it is in one, and from there on
    any container above in which running text stands directly, that is named a story, or that adds no page furniture and no lists of links.

    ``lifted`` has what was found before for containers on the way.
    """
    way = []
    c = c.top or c
    while c not in lifted and (up := c.parent) is not None and (up.direct or up.story or (up.furniture == c.furniture + c.is_furniture and up.links - up.own_links == c.links)):
        way.append(c)
        c = up
    top = lifted.get(c, c)
    for x in (*way, c):
        lifted[x] = top
    return top


def _kept(page: _Page, tops: set[_Node] | None, through: set[_Node]) -> set[int]:
    """The blocks inside ``tops`` (all if None) that names don't leave out: those below a container that is named furniture, or a list of links below one
    with other words too, apart from containers on the way to the winning path."""
    inside: dict[_Node, bool] = {}
    worst: dict[_Node, int] = {}
    for c in page.nodes:
        up = c.parent
        inside[c] = tops is None or c in tops or (up is not None and inside[up])
        worst[c] = max(0 if c in through else c.hint, worst[up] if up is not None else 0)
    return {i for i, (_, c, hinted, links) in enumerate(page.blocks) if inside[c] and (hint := max(hinted, worst[c])) < 2 and not (hint and links > 0.5)}


def _inside(page: _Page, path: str | None) -> set[int]:
    """The blocks in the articles around the containers on the path."""
    wanted = page.find_path(path)
    if wanted is None:
        return set()
    lifted: dict[_Node, _Node] = {}
    tops: set[_Node] = set()
    through: set[_Node] = set()
    holding: set[_Node] = set()  # containers that hold a block
    for _, c, _, _ in page.blocks:
        while c is not None and c not in holding:
            holding.add(c)
            c = c.parent
    for c in page.nodes[1:]:
        if c.path == wanted and c in holding:
            tops.add(_lift(c, lifted))
            while c is not None and c not in through:
                through.add(c)
                c = c.parent
    return _kept(page, tops, through) if tops else set()


def extract_page(html: str | None, path: str | None) -> str:
    """Text of the articles around the containers on the path; around those on the page's own best path too, if the former hold
    little of what the latter hold; all blocks that are not named furniture if there are neither."""
    page = _read(html or "")
    blocks = page.blocks
    chosen = _inside(page, path)
    if len(chosen) < len(blocks):
        votes = _votes(page)
        own = _inside(page, votes[0][0]) if votes else set()
        worth = [sum(len(blocks[i][0]) * (1 - blocks[i][3]) for i in x) for x in (chosen, own)]
        if worth[0] < COVER * worth[1]:
            chosen |= own
    if not chosen:
        chosen = _kept(page, None, set())
    return "\n".join(b[0] for i, b in enumerate(blocks) if i in chosen)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    src = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")).withColumn("host", host)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(0).to_pylist()
            sums: dict[tuple[str, str], int] = defaultdict(int)
            for start, _, texts in byte_slices(batch, "html"):
                for k, t in enumerate(texts):
                    for path, weight in page_votes(t.decode("utf-8", "replace") if t else ""):
                        sums[hosts[start + k], path] += weight
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["host", "path", "weight"])

    votes = src.select("host", "html").mapInArrow(vote, "host string, path string, weight long")
    votes = votes.groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    winners = votes.groupBy(F.col("host").alias("h")).agg(F.max(F.struct("weight", "path"))["path"].alias("path"))
    winners = scratch.save(winners, "winners")  # a written table: its size is known when the join is planned
    joined = src.join(winners, F.col("host") == F.col("h"), "left").select("id", "url", "html", "path")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(3).to_pylist()
            for start, stop, texts in byte_slices(batch, "html"):
                got = [extract_page(t.decode("utf-8", "replace") if t else "", paths[start + k]) for k, t in enumerate(texts)]
                n = stop - start
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], names=["id", "url", "text", "n_chars"])

    out = joined.mapInArrow(extract, f"id {dict(src.dtypes)['id']}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
