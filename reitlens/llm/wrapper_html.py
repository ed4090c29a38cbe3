"""HTML main text by wrapper induction.

Pages of a host share a template.  The elements of all pages of a host are
aligned by the path of their labels; Spark counts on how many pages a path and
its content stand.  Elements that most pages of their path share belong to the
template, inside an article as well as outside; all other places are slots.
Slots are content unless their element's role says otherwise (menus, headers,
footers, side bars, notices, adverts, forms, comments); where a page marks its
article or main element, the content is that slot, without the template in it.
Passages that only some articles of a host share stay.
"""

from __future__ import annotations

import html as entities
import re
from functools import cache, lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reitlens.llm.common import ship, sized, stored, text_slices
from reitlens.llm.url_rules import url_parts

_START = r"<(/?)([a-zA-Z][^\s/>]*+)"
_OTHER = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
_TOKEN = re.compile(rf"""{_OTHER}|{_START}((?:[^>"']++|"[^"]*"|'[^']*')*+)>|{_START}([^>]*)(?:>|\Z)""", re.S)
#: The same without quotes, for pages with many quotes that are never closed: looking for their ends would read the page again and again.
_PLAIN_TOKEN = re.compile(rf"{_OTHER}|{_START}([^>]*)(?:>|\Z)(()())?", re.S)
_OPEN_QUOTES = 64
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_MARKS = pa.list_(pa.struct([("path", pa.int64()), ("content", pa.int64()), ("inside", pa.bool_())]))

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br_ caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCK - {"body", "br_", "caption", "head", "html", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: A start tag closes an open element of these names, unless one of the second set stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
          "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: Elements without main text.
ASIDE = frozenset("head script style noscript template nav header footer aside form button select iframe svg math object menu dialog textarea audio video canvas search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Class and id names, or all parts of one (cookie-notice), that mark what is no main text.
ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form gdpr header "
                        "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related reply replies respond share sharing "
                        "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Pages of a host that hold an element at least, where not all of them do or where it stands in an article.
LEAST_PAGES = 4


class Node:
    __slots__ = ("tag", "label", "children", "kind", "by_words")

    def __init__(self, tag: str, label: str = "", kind: str = ""):
        self.tag, self.label, self.kind = tag, label, kind  # kind: "", "aside", "article"
        self.children: list = []  # nodes and strings
        self.by_words = False  # an aside only by its class or id


def _hash(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _aside_name(names: str) -> bool:
    """Whether a whole class or id name, or each part of one, is among the words (no-sidebar is not)."""
    return any(parts and ASIDE_WORDS.issuperset(parts) for parts in map(_WORD.findall, names.split()))


@lru_cache(1 << 12)
def _kind(tag: str, attributes: str, inside_article: bool) -> tuple[str, str, bool]:
    """(label, kind, whether by class words only) of an element from its attributes."""
    names, role, kind, by_words = "", "", "", False
    if attributes and "=" in attributes or "hidden" in attributes:
        found = {}
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), entities.unescape((m[2] or "").strip("\"'")))
        names = f"{found.get('id', '')} {found.get('class', '')}".lower()
        role = found.get("role", "").lower()
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            kind = "aside"
    if tag in ASIDE and not (tag == "header" and inside_article) or role in ASIDE_ROLES:
        kind = "aside"
    elif not kind and (tag in ("article", "main") or role in ("article", "main")):
        kind = "article"
    elif not kind and tag not in ("html", "body") and _aside_name(names):
        kind, by_words = "aside", True
    return (f"{tag}.{names.strip()}" if names.strip() else tag), kind, by_words


def _has_own_text(node: Node) -> bool:
    return any(isinstance(c, str) and c.strip() for c in node.children)


def _with_text(tree: Node) -> set[int]:
    """Identities of the nodes that hold text, not counting asides below them."""
    order, todo = [], [(tree, None)]
    while todo:
        x, above = todo.pop()
        order.append((x, above))
        todo.extend((c, x) for c in x.children if not isinstance(c, str))
    found: set[int] = set()
    for x, above in reversed(order):
        if _has_own_text(x):
            found.add(id(x))
        if id(x) in found and above is not None and x.kind != "aside" and x.tag not in RAW:
            found.add(id(above))
    return found


def _release(tree: Node) -> None:
    """Where no article with text stands outside of asides, an element around one is no aside by its class words."""
    texts = None  # found when first asked for: most pages have an article and no aside by class words around it
    held, todo = [], [(tree, None)]  # a node and the asides around it: (innermost, the others)
    while todo:
        x, over = todo.pop()
        if x.kind == "article" and texts is None:
            if over is None and any(_has_own_text(c) for c in x.children if not isinstance(c, str) and c.kind != "aside" and c.tag not in RAW):
                return
            texts = _with_text(tree)
        if x.kind == "article" and id(x) in texts:
            if over is None:
                return
            held.append(over)
            continue
        if x.kind == "aside" and not x.by_words:
            continue
        over = (x, over) if x.by_words else over
        todo.extend((c, over) for c in x.children if not isinstance(c, str))
    for over in held:
        while over is not None and over[0].by_words:
            over[0].kind, over[0].by_words = "", False
            over = over[1]


class _Open:
    """The open elements, with the places of each tag among them, so that no end or start tag searches the whole stack."""

    def __init__(self, root: Node):
        self.stack, self.articles = [root], 0
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK or node.tag == "button":
            self.blocks.append(len(self.stack))
        self.articles += node.kind == "article"
        self.stack.append(node)

    def last(self, tags) -> int:
        """Place of the innermost open element with one of ``tags``, or 0."""
        return max((at[-1] for at in map(self.places.get, tags) if at), default=0)

    def cut(self, at: int) -> None:
        """Close the element at place ``at`` and all inside it."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            self.articles -= node.kind == "article"


_CELLS = ("td", "th", "table")
_TABLE_ENDS = frozenset(("table", "tr", "tbody", "thead", "tfoot", "body", "html"))


def parse(page: str) -> Node:
    """DOM tree of a page; unclosed and misplaced tags are put right the usual way, nothing is dropped.  Takes time in proportion to the page."""
    root = Node("#root", "#root")
    open_, pos, bad = _Open(root), 0, 0
    search = _TOKEN.search
    while True:
        m = search(page, pos)
        text = page[pos:m.start() if m else len(page)]
        if text:
            open_.stack[-1].children.append(text)
        if not m:
            _release(root)
            return root
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        if m[5] and (bad := bad + 1) == _OPEN_QUOTES:
            search = _PLAIN_TOKEN.search
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            at = open_.places.get(tag)
            if at and (at[-1] == len(open_.stack) - 1 or tag in _TABLE_ENDS or at[-1] >= open_.last(_CELLS)):
                open_.cut(at[-1])
            continue
        if tag in ENDS_P:
            at = open_.places.get("p")
            if at and at[-1] == open_.blocks[-1]:
                open_.cut(at[-1])
        if tag in CLOSES:
            ends, barrier = CLOSES[tag]
            stop = open_.last(barrier)
            while (at := open_.last(ends)) > stop:
                open_.cut(at)
        label, kind, by_words = _kind(tag, attributes, open_.articles > 0)
        node = Node(tag, label, kind)
        node.by_words = by_words
        open_.stack[-1].children.append(node)
        if tag in RAW:
            end = _raw_end(tag).search(page, pos)
            close = page.find(">", end.end()) if end else -1
            pos = close + 1 if end and close >= 0 else len(page)
            continue
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        open_.push(node)


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}", re.I)


def _name(node: Node) -> str:
    """Label of a node in a path: numbers in names count as equal; the page's own names on html, body and the article do not count."""
    return node.tag if node.tag in ("html", "body") or node.kind == "article" else _DIGITS.sub("#", node.label)


def fingerprint(tree: Node) -> dict[int, tuple[int, int, bool]]:
    """(path, content, inside an article) of each element with text that is no aside, by identity of the node.

    The path is the hash of the labels from the root, the content the hash of
    the labels and texts below the node.  Two elements of a host are aligned if
    their paths are equal.
    """
    order, todo = [], [(tree, 0, False)]
    while todo:
        x, above, inside = todo.pop()
        path = _hash(b"%d %s" % (above, _name(x).encode("utf-8", "replace")))
        order.append((x, path, inside))
        inside = inside or x.kind == "article"
        todo.extend((c, path, inside) for c in x.children if not isinstance(c, str) and c.kind != "aside" and c.tag not in RAW)
    content: dict[int, int] = {}
    out: dict[int, tuple[int, int, bool]] = {}
    for x, path, inside in reversed(order):
        parts = []
        for c in x.children:
            if isinstance(c, str):
                text = _SPACE.sub(" ", entities.unescape(c)).strip()
                if text:
                    parts.append(text.encode("utf-8", "replace"))
            elif content.get(id(c)):
                parts.append(b"%d %s" % (content[id(c)], _name(c).encode("utf-8", "replace")))
        if parts:
            content[id(x)] = _hash(b"\0".join(parts))
            out[id(x)] = path, content[id(x)], inside
    return out


def _slots(tree: Node, skip: set[int]) -> list[Node]:
    """The outermost article and main elements."""
    slots, todo = [], [tree]
    while todo:
        x = todo.pop()
        if x.kind == "article":
            slots.append(x)
        elif x.kind != "aside" and id(x) not in skip or x is tree:
            todo.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return slots


def page_marks(page: str | None) -> tuple[int, list[tuple[int, int, bool]]]:
    """(hash of the article or else the page, sorted distinct marks of the elements that may be template)."""
    if not page:
        return 0, []
    tree = parse(page)
    found = fingerprint(tree)
    slots = _slots(tree, set())
    body = _hash(b" ".join(b"%d" % found[id(x)][1] for x in slots or [tree] if id(x) in found))
    whole = {id(tree), *map(id, slots)}
    return body, sorted({m for i, m in found.items() if i not in whole})


def blocks(node: Node, skip: set[int]) -> list[str]:
    """Texts of the blocks below ``node`` in page order, without asides and the nodes in ``skip``."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        if line:
            text = _SPACE.sub(" ", entities.unescape("".join(line))).strip()
            line.clear()
            if text:
                out.append(text)

    todo: list = [(node, 0)]
    while todo:
        x, state = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif state == 1:
            flush()
        elif x is not node and (x.kind == "aside" or id(x) in skip or x.tag in RAW):
            if x.tag in BLOCK:
                flush()
        elif x.tag in ("br", "img"):
            line.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append((x, 1))
            children = x.children if x.tag != "header" else [c for c in x.children if not isinstance(c, str) and c.tag in _HEADING]
            todo.extend((c, 0) for c in reversed(children))
    flush()
    return out


def main_text(page: str | None, template: set[tuple[int, int]]) -> str:
    """Main text of a page without the elements whose (path, content) is in ``template``: blocks joined by two line feeds (null or empty page: empty)."""
    if not page:
        return ""
    tree = parse(page)
    skip = {i for i, m in fingerprint(tree).items() if m[:2] in template} if template else set()
    slots = _slots(tree, skip)
    found: list[str] = []
    for s in slots:
        found += blocks(s, skip)
    return "\n\n".join(found) if found else "\n\n".join(blocks(tree, skip - {id(tree)}))


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, marks): (path, content) of the template elements of each host, judged over all its pages.

    Pages with the same article (without one: the same text) count once, so
    copies say nothing.  An element is template if it is on most of the pages that
    have its path, and on ``LEAST_PAGES`` at least; outside of articles also if
    it is on all of two or more.  No list grows with a host: one page holds each
    mark once, and a mark is listed only if it is on most pages of its path.
    """
    host, _ = url_parts(F.col(url))
    src = pages.select(host.alias("host"), F.col(html).alias("html"))

    def run(batches):
        for batch in batches:
            for b in text_slices(batch, "html"):
                got = [page_marks(p) for p in b.column("html").to_pylist()]
                marks = pa.array([[{"path": p, "content": c, "inside": i} for p, c, i in m] for _, m in got], _MARKS)
                yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([x for x, _ in got], pa.int64()), marks], names=["host", "body", "marks"])

    each = src.mapInArrow(run, "host string, body long, marks array<struct<path: long, content: long, inside: boolean>>").where(F.size("marks") > 0)
    each = stored(each.groupBy("host", "body").agg(F.min("marks").alias("marks")), "wrapper-pages")
    # one row per page and path, and per page, path and content; both sums are combined inside the tasks first
    places = stored(each.select("host", F.explode("marks").alias("m")).groupBy("host", "m.path", "m.content", "m.inside").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "wrapper-places")
    each = each.select("host", F.explode(F.array_distinct(F.transform("marks", lambda m: m["path"]))).alias("path"))
    total = each.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))
    most = (F.col("n") >= LEAST_PAGES) & (2 * F.col("n") > F.col("pages"))
    both = places.join(total, ["host", "path"]).where(most | ~F.col("inside") & (F.col("n") == F.col("pages")))
    return both.groupBy("host").agg(F.collect_set(F.struct("path", "content")).alias("marks"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Columns of ``pages`` without the html, plus text (the main text, empty if none).

    A null or empty page has an empty text.  Pages without a host are aligned
    with each other.  Repeated rows are extracted alike; where all pages of a
    host are equal, all of them counts as slots.  A column ``text`` of ``pages``
    is replaced.  An empty table gives an empty result.
    """
    ship(pages.sparkSession)
    marks = stored(templates(pages, url, html), "wrapper-templates").select(F.col("host").alias("ref_host__"), F.col("marks").alias("marks__"))
    rest = [c for c in pages.columns if c not in (html, "text")]
    host, _ = url_parts(F.col(url))
    src = pages.select(*rest, F.col(html).alias("html__"), host.alias("host__")).join(sized(marks), F.col("host__") == F.col("ref_host__"), "left").select(*rest, "html__", "host__", "marks__")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*rest).schema.fields)

    def run(batches):
        for batch in batches:
            for b in text_slices(batch, "html__"):
                known: dict[str | None, set] = {}
                texts = []
                for i, (p, h) in enumerate(zip(b.column("html__").to_pylist(), b.column("host__").to_pylist())):
                    if h not in known:
                        known[h] = {(m["path"], m["content"]) for m in b.column("marks__")[i].as_py() or ()}
                    texts.append(main_text(p, known[h]))
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(rest))], pa.array(texts, pa.string())], names=[*rest, "text"])

    return src.mapInArrow(run, ", ".join(x for x in (fields, "text string") if x))
