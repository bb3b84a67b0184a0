"""Main text of web pages by consensus host paths (operator 8).

Each page's containers are scored by the text of their blocks less that of links; the page votes for the path of its
best container, generalised to tags and classes without numbers. Votes are summed by host and path in Spark, and every page is
extracted again from the containers at its host's winning path, in page order, less those that are mostly links. Each is widened to the
article or main around it, and further to outer ones while they add more text than links; without any, to the parent below
body, if it does so. A page that has no text there uses the path of its own best container.

Edge cases: null and empty html give the empty text; a null or hostless url votes under the empty host; broken markup
(unclosed or stray tags and quotes, bare ``<``) is read as browsers do it, roughly, in linear time; inline elements of a sentence and a header that holds the article's
h1 stay, whatever their class; ties of votes go to the path with more text, then
the smaller path; elements marked as outside, and forms, that wrap the article are inside; a page of 100,000 nested elements takes
seconds, not minutes; repeated rows vote and are returned each; empty tables give empty tables; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import materialize, slices

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
#: Most tags: attributes without single quotes and angle brackets. A try ends at the next angle bracket.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*+)([^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+)*+)>")
_HEADLINES = re.compile(r"<(h1|/header)(?=[\s/>])", re.I)
_ATTR = re.compile(r"""(class|id|role|hidden|itemprop|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never belong to the article.
OUTSIDE = frozenset("head script style noscript template nav header footer aside button select textarea input iframe svg canvas object dialog menu title audio video map".split())
#: Words of class, id or role that mark what is outside the article, as a form does; unless it is a wrapper of the article (``_wrappers``).
OUTSIDE_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside notice notices cookie cookies consent gdpr banner ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored promo promotion newsletter subscribe subscription signup login comment comments disqus reply replies respond share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager popup modal overlay search toolbar widget copyright complementary contentinfo form alert".split()
)
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
NOT_WORDS = frozenset("has with no without free".split())
NEVER_OUTSIDE = frozenset(("html", "body", "main", "article"))
LIKELY_WORDS = frozenset("article content entry main post story text articlebody".split())
#: Elements whose inline children are text, whatever their class says.
SENTENCES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())
CLOSES = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"),
}
KEEPS_P = frozenset("button td th table caption object html".split())
SCOPES = frozenset("table td th html".split())
LISTS = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",)}


class Tags:
    """The tags of a page in order, in one forward pass whose time is linear in the page, however broken its markup is.

    A tag ends at the first ``>`` outside of quotes, or, where none comes, at the first one. What a scan for the former has found out about a place is remembered:
    a later scan that gets there stops.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.dead: set[int] = set()  # quotes outside of quotes from which no tag ends

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``at``; there is one after it."""
        page, passed, start = self.page, [], at
        while m := _SPECIAL.search(page, at):
            place = m.start()
            if page[place] == ">":
                return place
            if place in self.dead:
                break
            passed.append(place)
            close = page.find(page[place], place + 1)
            if close < 0:
                break
            at = close + 1
        self.dead.update(passed)
        return page.find(">", start)

    def following(self, at: int) -> tuple[int, int, str | None, bool, str]:
        """Of the next tag from ``at``: where it begins and ends, its name (null for comments and the like), whether it closes, its attributes. At the end: the page's size."""
        page, size = self.page, len(self.page)
        while (start := page.find("<", at)) >= 0:
            if m := _PLAIN.match(page, start):
                return start, m.end(), m[2].lower(), m[1] == "/", m[3]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, size if end < 0 else end + 3, None, False, ""
            if start > self.last:  # only a comment could follow
                at = page.find("<!--", start)
                if at < 0:
                    break
                continue
            if m := _NAME.match(page, start + 1):
                end = self._end(m.end())
                return start, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end]
            if page[start + 1] in "!?/":
                return start, page.find(">", start) + 1, None, False, ""
            at = start + 1
        return size, size, None, False, ""


Token = tuple[str, int, str | None, bool, str]


def _tokens(page: str) -> list[Token]:
    """The text before each tag, the place of the tag, its name (null for what is no element), whether it closes, its attributes. The content of raw elements is left out."""
    out, at, size, tags = [], 0, len(page), Tags(page)
    while at < size:
        start, end, tag, closes, attrs = tags.following(at)
        out.append((page[at:start], start, tag, closes, attrs))
        at = end
        if tag in RAW and not closes:
            m = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            stop = page.find(">", m.start()) if m else -1
            at = size if stop < 0 else stop + 1
    return out


class Node:
    """An open or closed element: the number of its generalised path, and blocks first..last of the page (last exclusive)."""

    __slots__ = ("tag", "step", "number", "soft", "outside", "clean", "first", "last", "score", "bonus", "link", "parent", "article")

    def __init__(self, tag, step, number, soft, outside, clean, first, bonus, link, parent):
        self.tag, self.step, self.number, self.soft, self.outside, self.clean = tag, step, number, soft, outside, clean
        self.first, self.bonus, self.link, self.parent = first, bonus, link, parent
        self.last, self.score = -1, 0.0
        self.article = parent and (self if tag in ("article", "main") else parent.article)

    @property
    def path(self) -> str:
        steps, node = [], self
        while node.parent is not None:
            steps.append(node.step)
            node = node.parent
        return "".join("/" + x for x in reversed(steps))


def _attributes(attrs: str) -> tuple[tuple[str, ...], bool, bool, bool, bool]:
    """Of an element's attributes: class names without numbers; whether it is hidden, and marked by comment words, by outside words, as likely the article."""
    names, words = [], set()
    hidden = False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
            continue
        if key == "class":
            names = sorted({re.sub(r"\d+", "#", c).replace("/", "|") for c in value.lower().split()})
        for one in value.split():
            got = [w.lower() for w in _WORD.findall(one)]
            if not NOT_WORDS.intersection(got):
                words.update(got)
    return tuple(names), hidden, bool(COMMENT_WORDS & words), bool(OUTSIDE_WORDS & words), bool(LIKELY_WORDS & words)


_remembered = lru_cache(4096)(_attributes)
_NONE = _attributes("")


def _open(tag: str, attrs: str, parent: Node, first: int, numbers: dict[tuple[int, str], int], wrapper: bool, place: int, inside) -> Node:
    names, hidden, comment, marked, likely = (_remembered if len(attrs) < 200 else _attributes)(attrs) if attrs and not attrs.isspace() else _NONE
    # 2: marked by comment words, 1: by others or a form, 0: not
    soft = 0 if tag in ("html", "body") else 2 if comment else 1 if marked or tag == "form" else 0
    never = tag in OUTSIDE and not (tag == "header" and inside(tag, place))
    outside = parent.outside or never or hidden or bool(soft) and tag not in NEVER_OUTSIDE and not wrapper and not inside(tag, place)
    step = ".".join([tag, *names])
    bonus = 1.5 if tag in ("article", "main") else 1.2 if likely else 1.0
    clean = not marked and (tag in ("article", "main", "h1") or likely)
    number = numbers.setdefault((parent.number, step), len(numbers) + 1)
    return Node(tag, step, number, soft, outside, clean, first, bonus, tag == "a" or parent.link, parent)


def parse(page: str) -> tuple[list[str], list[Node]]:
    """The page's blocks outside of what never belongs to the article, in order, and its elements."""
    blocks, _, nodes, _ = _parse(page)
    return blocks, nodes


def _parse(page: str) -> tuple[list[str], list[int], list[Node], dict[tuple[int, str], int]]:
    """``parse`` with each block's characters in links, and the number of each path by its parent's and its last step."""
    tokens = _tokens(page)
    got = _read(page, tokens, frozenset(), False)
    if any(n.soft and n.tag not in NEVER_OUTSIDE for n in got[2]):
        if around := _wrappers(page, tokens):
            got = _read(page, tokens, around, False)
    return got


def _wrappers(page: str, tokens: list[Token]) -> frozenset[int]:
    """Places of marked elements that wrap the article: they hold most of the page's text and in it a container or headline that is not
    marked, or nearly all text, if not marked as comments."""
    blocks, linked, nodes, _ = _read(page, tokens, frozenset(), True)
    own = [max(0, len(t) - n) for t, n in zip(blocks, linked)]
    size = [0, *accumulate(own)]
    clean = [0, *accumulate(int(n.clean and not n.outside) for n in nodes)]
    found = set()
    ends = [0] * len(nodes)  # number of elements opened until each is closed
    place = {id(n): i for i, n in enumerate(nodes)}
    for i in range(len(nodes) - 1, -1, -1):
        ends[i] = max(ends[i], i + 1)
        if nodes[i].parent is not None:
            up = place[id(nodes[i].parent)]
            ends[up] = max(ends[up], ends[i])
    marked = [(i, n, clean[ends[i]] > clean[i + 1]) for i, n in enumerate(nodes) if n.soft and not n.outside]
    rest = list(own)  # without marked elements that hold no such container
    done = 0
    for _, n, holds in marked:
        if not holds and n.last > done:
            rest[max(done, n.first) : n.last] = [0] * (n.last - max(done, n.first))
            done = n.last
    total = sum(rest)
    for i, n, holds in marked:
        inside = size[n.last] - size[n.first]
        if holds and 2 * inside > total or n.soft == 1 and 10 * inside > 9 * size[-1]:
            found.add(i)
    return frozenset(found)


def _read(page: str, tokens: list[Token], wrappers: frozenset[int], all_: bool) -> tuple[list[str], list[int], list[Node], dict[tuple[int, str], int]]:
    """Blocks, their characters in links, elements and paths; marked elements at ``wrappers``, or all, count as inside."""
    root = Node("", "", 0, 0, False, False, 0, 1.0, False, None)
    numbers: dict[tuple[int, str], int] = {}
    opened: Counter = Counter()
    stack, nodes, blocks, linked = [root], [root], [], []
    pieces: list[str] = []
    links = 0

    def flush():
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                blocks.append(text)
                linked.append(links)
                gain, node = max(0.0, len(text) - 2.0 * links), stack[-1]
                while node.parent is not None and node.tag not in BLOCKS:
                    node = node.parent
                if node.tag in ("p", "li", "pre", "blockquote", "td", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption") and node.parent:
                    node = node.parent
                for share in (1.0, 0.5, 0.25):
                    node.score += share * gain
                    if (node := node.parent) is None:
                        break
            links = 0

    def close(to: int):
        flush()
        pop(to)

    def pop(to: int):
        while len(stack) > to:
            opened[stack[-1].tag] -= 1
            stack.pop().last = len(blocks)

    def text(raw: str):
        nonlocal links
        if raw and not stack[-1].outside:
            raw = html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if stack[-1].link:
                links += len(raw)

    def find(names: tuple[str, ...], stops) -> int:
        if not any([opened[x] for x in names]):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                return i
            if stack[i].tag in stops:
                return 0
        return 0

    headlines: list[tuple[int, bool]] | None = None  # places of h1 and of ends of headers

    def titled(place: int) -> bool:
        """Whether a header that begins there holds the headline."""
        nonlocal headlines
        if headlines is None:
            headlines = [(m.start(), m[1].lower() == "h1") for m in _HEADLINES.finditer(page)]
        k = bisect(headlines, (place, True))
        return k < len(headlines) and headlines[k][1]

    def inside(tag: str, place: int) -> bool:
        """Whether an element is inside the article whatever marks it: part of a sentence, or a header with the article's headline."""
        return tag not in BLOCKS and any([opened[x] for x in SENTENCES]) or tag == "header" and stack[-1].article is not None and titled(place)

    for before, start, tag, closes, attrs in tokens:
        text(before)
        if tag is None:
            continue
        if closes:
            if tag == "p" and not find(("p",), KEEPS_P):
                flush()
            elif tag == "br":
                flush()
            elif i := find((tag,), SCOPES - {tag} if tag not in ("table", "html", "body", "tr", "tbody") else ()):
                if tag in BLOCKS or any(n.tag in BLOCKS for n in stack[i:]):
                    close(i)
                else:
                    pop(i)
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag in BLOCKS:
            flush()
            if tag != "br" and (i := find(("p",), KEEPS_P)):
                close(i)
            if tag in CLOSES and (i := find(CLOSES[tag], LISTS.get(tag, ("table",)))):
                while j := find(CLOSES[tag], LISTS.get(tag, ("table",))):
                    i = j
                    close(i)
            if tag == "body" and (i := find(("head",), ())):
                close(i)
        if tag in VOID or tag in RAW:
            continue
        node = _open(tag, attrs, stack[-1], len(blocks), numbers, all_ or len(nodes) in wrappers, start, inside)
        if node.outside and not stack[-1].outside and tag in BLOCKS | OUTSIDE:
            flush()
            node.first = len(blocks)
        stack.append(node)
        nodes.append(node)
        opened[tag] += 1
    close(0)
    return blocks, linked, nodes, numbers


def best(nodes: list[Node]) -> Node:
    return max(nodes, key=lambda n: -1.0 if n.outside else n.score * n.bonus)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _spans(node: Node, sizes: list[int], linked: list[int], top: bool) -> range:
    """Blocks of ``node`` widened; none if it is mostly links and not the ``top`` of its path. ``sizes`` and ``linked`` are running sums."""

    def links(*spans: tuple[int, int]) -> bool:
        return 2 * sum(linked[b] - linked[a] for a, b in spans) > sum(sizes[b] - sizes[a] for a, b in spans)

    def wide(up: Node | None, node: Node) -> bool:
        return up is not None and not links((up.first, node.first), (node.last, up.last))

    if not top and links((node.first, node.last)):
        return range(0)
    if node.article is not None:
        node = node.article
        while wide(node.parent.article, node):
            node = node.parent.article
    elif node.parent is not None and node.parent.tag not in ("", "html", "body") and wide(node.parent, node):
        node = node.parent
    return range(node.first, node.last)


def extract(page: str | None, path: str | None) -> str:
    """The text of the containers at ``path``, or at that of the page's own best one."""
    if not page:
        return ""
    blocks, links, nodes, numbers = _parse(page)
    sizes, linked = [0, *accumulate(map(len, blocks))], [0, *accumulate(links)]
    wanted = []
    if path is not None:
        number: int | None = 0
        for step in path.split("/")[1:]:
            number = numbers.get((number, step)) if number is not None else None
        wanted.append(number)
    for where in [*wanted, best(nodes).number]:
        if at := [n for n in nodes if n.number == where and not n.outside]:
            top = best(at)
            take: set[int] = set()
            for span in dict.fromkeys(_spans(n, sizes, linked, n is top) for n in at):
                take.update(span)
            if take:
                return " ".join(blocks[i] for i in sorted(take))
    return " ".join(blocks)


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path): the container path with most votes of each host. Votes are counted in each task first."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__html"):
            votes: Counter = Counter()
            sizes: Counter = Counter()
            for u, text in zip(batch.column("__url").to_pylist(), batch.column("__html").to_pylist()):
                if text:
                    blocks, nodes = parse(text)
                    node = best(nodes)
                    key = host_of(u), node.path
                    votes[key] += 1
                    sizes[key] += sum(map(len, blocks[node.first : node.last]))
            keys = list(votes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([votes[k] for k in keys], pa.int64()), pa.array([sizes[k] for k in keys], pa.int64())],
                names=["host", "path", "votes", "size"],
            )

    rows = pages.select(F.col(url).alias("__url"), F.col(page).alias("__html"))
    counted = rows.mapInArrow(vote, "host string, path string, votes long, size long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("size").alias("size"))
    # least of (-votes, -size, path) by host
    return counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("size")).alias("s"), "path")).alias("m")).select("host", "m.path")


def main_text(pages: DataFrame, *, url: str = "url", page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text and n_chars of every page.

    The winning paths, a row a host, are written first, so that Spark knows their size: it broadcasts them below its
    threshold and otherwise joins by host, splitting hot hosts.
    """
    rows = pages.select(*keep, F.col(url).alias("__url"), F.col(page).alias("__html"))
    host = F.lower(F.regexp_extract(F.coalesce("__url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    paths = materialize(host_paths(pages, url, page)).select(F.col("host").alias("__host"), F.col("path").alias("__path"))
    joined = rows.withColumn("__host", host).join(paths, "__host", "left")
    schema = rows.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__html"):
            texts = [extract(h, p) for h, p in zip(batch.column("__html").to_pylist(), batch.column("__path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return joined.select(*keep, "__html", "__path").mapInArrow(run, schema)
