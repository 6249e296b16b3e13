"""Main text of web pages by consensus of each host's pages.

Pass 1 parses each page, scores its containers (text that is not in links, menus, forms and so on, with a bonus for tags
and classes that name an article) and emits the best container's generalised path: tags with classes, digits made ``#``.
Spark sums the scores by host and path; each host's winner goes to a table in the shared folder. Pass 2 reads
pages again beside their host's winner and extracts the container at that path; a page that has none, or
no text there, uses its own best container. Names of class, id and role take whole blocks out only where every word of one name
says so (``share-bar``, not ``related-work``), never paragraphs or headings; else they lower a container's score, and the vote decides.

Votes are summed before they are shuffled, so a host with a third of all pages costs one row a task. The
winners (one row a host) are joined, and broadcast only if Spark finds their written table below its threshold.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spool, map_arrow, quoted, str_texts

_START = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: What may end a tag, or begin a quoted value that hides the end.
_EVENT = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Tags whose content is not markup.
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that are never part of an article.
_OUT = frozenset("nav aside footer form script style noscript template iframe title textarea select button svg object embed canvas head dialog menu xmp noembed".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article main section div td body".split())
#: Tags that words of class, id and role may mark as not of the article; of others (paragraphs, headings, inline ones) they only lower the score.
_MARKED = frozenset("div section ul ol dl table td tr li aside header figure details center fieldset span a".split()) - frozenset("span a li".split())
#: Words of class, id and role that mark what is not the article, those that may stand beside them in one name, and what is the article.
_NOT_ARTICLE = frozenset("ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar toolbar header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations trending comment comments disqus respond replies reply pagination pager copyright legal disclaimer skip hidden complementary contentinfo".split())
_BESIDE = frozenset("area bar block box button buttons col column container content count feed form group header heading icon icons inner item items label left line link links list module outer panel posts articles stories right row section site slot stream table thread title tools top bottom unit view wrap wrapper zone global page primary secondary main".split())
_ARTICLE = frozenset("article content main post entry story body text page".split())
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile("[0-9]+")
_SPACE = re.compile(r"\s+")
#: End tags that an open tag of the same kind implies; paragraphs and cells are often left open.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_BARRIER = frozenset("table ul ol dl article section main body div".split())
_LOWERED = 0.5


class Node:
    __slots__ = ("classes", "key", "level", "link", "lowered", "named", "out", "parent", "parts", "tag")

    def __init__(self, tag: str, classes: str = "", parent: Node | None = None, out: bool = False, link: bool = False, named: int = 0, lowered: bool = False) -> None:
        self.tag, self.classes, self.parent, self.out, self.link, self.named, self.lowered = tag, classes, parent, out, link, named, lowered
        self.key = hash((parent.key, tag, classes)) if parent else 0
        #: Open tags since the nearest element that ends a search for implied end tags.
        self.level: Counter[str] = Counter() if parent is None or parent.tag in _BARRIER else parent.level
        self.parts: list[str | Node] = []

    def is_container(self) -> bool:
        return self.tag in _CONTAINER

    def path(self) -> str:
        steps, n = [], self
        while n.parent is not None:
            steps.append(f">{n.tag}{n.classes}")
            n = n.parent
        return "".join(reversed(steps))


def key_of(path: str) -> int:
    """``Node.key`` of a path, in this process."""
    key = 0
    for step in path.split(">")[1:]:
        tag, dot, classes = step.partition(".")
        key = hash((key, tag, dot + classes))
    return key


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Texts ("", "", text), tags ("<" or "</", name, attributes) in page order; comments and declarations are left out.

    A tag ends at the next ``>`` outside quoted values; a quote that is never closed is a character like any other, and a ``<`` whose tag
    never ends is text. Where a tag that starts at some place ends is kept for every place passed on the way, so each is passed once."""
    events = [(m.start(), m[1], m.end()) for m in _EVENT.finditer(page)]
    starts = [e[0] for e in events]
    known: dict[int, int] = {}
    unclosed: set[str] = set()

    def end_from(i: int) -> int:
        k, passed, end = bisect_left(starts, i), [], -1
        while k < len(events):
            if k in known:
                end = known[k]
                break
            passed.append(k)
            at, quote, after = events[k]
            if quote is None:
                end = at
                break
            close = -1 if quote in unclosed else page.find(quote, after)
            if close < 0:
                unclosed.add(quote)
                k += 1
            else:
                k = bisect_left(starts, close + 1)
        known.update(dict.fromkeys(passed, end))
        return end

    at = done = 0
    while (at := page.find("<", at)) >= 0:
        m = _START.match(page, at)
        if m is None:
            at += 1
            continue
        if m[2] is None:
            closed = page.find("-->", at + 4) if m[0] == "<!--" else page.find(">", at)
            stop = len(page) if closed < 0 else closed + (3 if m[0] == "<!--" else 1)
            token = None
        elif (end := end_from(m.end())) < 0:
            at += 1
            continue
        else:
            stop, token = end + 1, ("<" + m[1], m[2].lower(), page[m.end() : end])
        if done < at:
            yield "", "", page[done:at]
        if token:
            yield token
        at = done = stop
    if done < len(page):
        yield "", "", page[done:]


def _words(attrs: str) -> tuple[bool, frozenset[str], str]:
    """Whether a name among class, id and role says that this is not the article; all their words; the classes, digits generalised,
    sorted. A name says so if it has such a word and besides only ones that may stand beside them."""
    words: set[str] = set()
    classes: list[str] = []
    out = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for one in value.split():
                parts = {w.lower() for w in _CLASS_WORD.findall(one)}
                words |= parts
                out |= bool(parts & _NOT_ARTICLE) and parts <= _NOT_ARTICLE | _BESIDE
            if name == "class":
                classes = sorted(_DIGITS.sub("#", c) for c in value.split())
        elif name in ("hidden", "aria-hidden") and value.lower() in ("true", "hidden"):
            out = True
    return out, frozenset(words), "".join(f".{c.replace('>', '')}" for c in classes)


def parse(page: str) -> Node:
    """A lenient tree: unclosed paragraphs, cells and items are closed by what follows; stray end tags are ignored. Any depth."""
    root = node = Node("html")
    raw = ""
    opened: Counter[str] = Counter()
    for kind, tag, rest in tokens(page):
        if raw:
            if kind == "</" and tag == raw:
                raw, node = "", _closed(node, node.parent or root, opened)
            continue
        if not kind:
            node.parts.append(rest)
        elif kind == "</":
            if opened[tag]:
                node = _ended(node, tag, opened)
        elif tag in _VOID:
            node.parts.append(Node(tag))
        else:
            if tag in _ENDS_P:
                node = _implied(node, {"p"}, opened)
            if tag in _CLOSES:
                node = _implied(node, _CLOSES[tag], opened)
            bad, words, classes = _words(rest) if rest else (False, frozenset(), "")
            out = tag in _OUT or bad and tag in _MARKED
            named = 2 * (tag in ("article", "main")) + bool(words & _ARTICLE)
            child = Node(tag, classes, node, node.out or out, node.link or tag == "a", named, bool(words & _NOT_ARTICLE))
            node.parts.append(child)
            if not rest.endswith("/"):
                node = child
                opened[tag] += 1
                child.level[tag] += 1
                raw = tag if tag in _RAW else ""
    return root


def _closed(node: Node, to: Node, opened: Counter[str]) -> Node:
    """``to``, with everything from ``node`` up to it closed."""
    while node is not to and node.parent is not None:
        opened[node.tag] -= 1
        node.level[node.tag] -= 1
        node = node.parent
    return to


def _ended(node: Node, tag: str, opened: Counter[str]) -> Node:
    """What stays open after an end tag. Inline end tags don't close blocks."""
    if tag not in _BLOCK and not node.level[tag]:
        return node
    up: Node | None = node
    while up is not None and up.parent is not None:
        if up.tag == tag:
            return _closed(node, up.parent, opened)
        if tag not in _BLOCK and up.tag in _BARRIER:
            break
        up = up.parent
    return node


def _implied(node: Node, tags: set[str], opened: Counter[str]) -> Node:
    """The node that stays open after the end tags that a new tag implies."""
    if node.tag in _BARRIER or not any(node.level[t] for t in tags):
        return node
    up: Node | None = node
    while up is not None and up.tag not in _BARRIER:
        if up.tag in tags and up.parent is not None:
            return _closed(node, up.parent, opened)
        if up.tag == "li" and "li" not in tags:
            break
        up = up.parent
    return node


def blocks(node: Node) -> list[str]:
    """Texts of the container's blocks in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            if t := _SPACE.sub(" ", html.unescape("".join(line))).strip():
                out.append(t)
            line.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        n, i = stack.pop()
        if i == 0 and n.tag in _BLOCK:
            end()
        while i < len(n.parts):
            p = n.parts[i]
            i += 1
            if isinstance(p, str):
                line.append(p)
            elif p.tag in _VOID:
                if p.tag == "hr":
                    end()
                elif p.tag == "br":
                    line.append(" ")
            elif _skipped(p, node):
                if p.tag in _BLOCK:
                    end()
            else:
                stack += [(n, i), (p, 0)]
                break
        else:
            if n.tag in _BLOCK:
                end()
    end()
    return out


def _skipped(p: Node, top: Node) -> bool:
    """A header inside the container that has a heading is the article's title; any other, and what is marked, is left out."""
    if p.tag == "header":
        return p.out and not top.out or top.tag == "body" and not _inside_article(p) or not _has_heading(p)
    return p.out and not top.out


def _has_heading(p: Node) -> bool:
    todo = [p]
    while todo:
        n = todo.pop()
        if n.tag in ("h1", "h2"):
            return True
        todo += [x for x in n.parts if isinstance(x, Node) and not x.out]
    return False


def _inside_article(p: Node) -> bool:
    up = p.parent
    while up is not None:
        if up.tag in ("article", "main"):
            return True
        up = up.parent
    return False


def containers(root: Node) -> list[tuple[float, Node]]:
    """Containers with their scores, in page order. A container's text counts in full for it, and less for each container around it."""
    order: list[tuple[Node, int]] = []
    score: list[float] = []
    inside: list[tuple[Node, int]] = [(root, -1)]
    while inside:
        n, holder = inside.pop()
        if n.out:
            continue
        if n.is_container():
            order.append((n, holder))
            score.append(0.0)
            holder = len(order) - 1
        if holder >= 0 and (text := sum(len(p) for p in n.parts if isinstance(p, str) and not p.isspace())):
            score[holder] += (-text if n.link else text) * (_LOWERED if n.lowered else 1)
        inside += [(p, holder) for p in reversed(n.parts) if isinstance(p, Node) and p.parts]
    for i in range(len(order) - 1, -1, -1):  # inner ones stand behind
        n, holder = order[i]
        if holder >= 0:
            score[holder] += score[i] * (0.9 if n.tag != "body" else 0.5)
    return [(x * (1 + n.named), n) for x, (n, _) in zip(score, order, strict=True)]


def best(found: list[tuple[float, Node]]) -> tuple[float, Node] | None:
    top: tuple[float, Node] | None = None
    for x in found:
        if x[0] > 0 and (top is None or x[0] > top[0]):
            top = x
    return top


def host_of(url: str) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    return m[1].lower() if m else ""


def extract(page: str, winner: str | None = None) -> tuple[str, str]:
    """Main text, and the path of the container it came from: the best one at the host's winning path that has any text, else the
    page's own best, else the page."""
    root = parse(page)
    found = containers(root)
    if winner:
        key = key_of(winner)
        for _, n in sorted((x for x in found if x[1].key == key and x[1].path() == winner), key=lambda x: -x[0]):
            if text := blocks(n):
                return "\n".join(text), winner
    if (own := best(found)) is None:
        return "\n".join(blocks(root)), ""
    return "\n".join(blocks(own[1])), own[1].path()


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes, score: summed over each task's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[str, str], list[float]] = {}
            for url, page in zip(str_texts(b.column(0)), str_texts(b.column(1)), strict=True):
                if (top := best(containers(parse(page)))) is not None:
                    t = total.setdefault((host_of(url), top[1].path()), [0, 0.0])
                    t[0] += 1
                    t[1] += top[0]
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([int(total[k][0]) for k in keys], pa.int64()), pa.array([total[k][1] for k in keys], pa.float64())], names=["host", "path", "votes", "score"])

    read = pages.select(F.col(quoted(url_col)).cast("string").alias("url"), F.col(quoted(html_col)).cast("string").alias("html"))
    return map_arrow(read, run, "host string, path string, votes long, score double").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, path of every row of ``pages``.

    Null html: empty text. A null or malformed url: the host ``''``. Votes of equal number: the path that sorts first
    wins. Repeated rows are rows of the result (and vote twice); empty table: empty result; extra columns are not read. Pages of any length,
    depth and number of tags are read alike."""
    spool = Spool(pages.sparkSession, "html")
    ranked = votes(pages, url_col, html_col).groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("top"))
    winners = spool.table(ranked.select(F.col("host").alias("vote_host"), F.col("top.path").alias("winner")))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(p, w) for p, w in zip(str_texts(b.column(2)), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([p for _, p in got], pa.string())], names=["page_id", "url", "text", "n_chars", "path"])

    read = pages.select(F.col(quoted(id_col)).alias("page_id"), F.col(quoted(url_col)).cast("string").alias("url"), F.col(quoted(html_col)).cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    beside = read.join(winners, host == F.col("vote_host"), "left").select("page_id", "url", "html", "winner")
    return map_arrow(beside, run, f"page_id {kind}, url string, text string, n_chars long, path string").withColumnsRenamed({"page_id": id_col, "url": url_col})
