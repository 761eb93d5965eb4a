"""Main text of web pages by composite text density.

Every node of a page's element tree gets a density: its characters per tag, lowered
where links hold them. A node's children's densities add up to its density sum; the
node with the largest sum is the core of the article. The lowest density on the path
from the core up to the body is the threshold: other blocks at or above it belong to
the article too, and the smallest subtree that holds all of them is its text. Blocks
inside it below the threshold are left out where links make them: lists of links, menus
and teasers. Short paragraphs are below it as well, but no links hold them; they stay.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split())
#: Elements that a start tag of the given name closes, unless one of the others stands between.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
             "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
             "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set())}
P, P_SHIELDS = {"p"}, {"td", "th", "table", "caption", "button", "blockquote", "div", "section", "article", "li"}
CLOSES_P = BLOCK - {"br", "body", "head", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never belong to an article's text.
NEVER = frozenset("nav footer aside button select textarea input label fieldset dialog menu search svg math canvas audio video "
                  "object embed iframe head title template noscript script style".split())
#: Words of class, id or role that name furniture of the page, not text of the article.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "consent contentinfo cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination paywall popup promo promoted promotion recommended related replies reply "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar widget".split())

MARKUP = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORD_SPLIT = re.compile(r"[^a-z]+")
#: Words beside a listed one that make a class say how a box looks ("with-sidebar"), not what it is.
STATE = frozenset("with without no not has have is enabled disabled on off open opened closed allowed".split())
#: Listed words for what readers write; it can outweigh the article.
REPLIES = frozenset("comment comments commentlist disqus replies reply respond".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "up", "kids", "out", "named", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, name: str, up: Node | None, out: bool, named: int):
        self.name, self.up, self.kids, self.out, self.named = name, up, [], out, named


def _out(name: str, attrs: str, in_article: bool) -> bool:
    if name in NEVER:
        return True
    if name == "header":  # an article's own header holds its title
        return not in_article
    return bool(attrs) and name not in ("html", "body", "article", "main") and bool(HIDDEN.search(attrs))


def _named(name: str, attrs: str) -> int:
    """1 for an element that its name makes furniture, 2 for readers' comments, else 0."""
    found = int(name == "form")
    if not attrs or name in ("html", "body", "article", "main"):
        return found
    for m in NAMES.finditer(attrs):
        for token in (m[1] or m[2] or m[3] or "").split():
            words = WORD_SPLIT.split(CAMEL.sub(" ", token).lower())
            if not FURNITURE.isdisjoint(words) and STATE.isdisjoint(words):
                found = max(found, 1 if REPLIES.isdisjoint(words) else 2)
    return found


class _Tree:
    """The open elements while a page is read, and how many there are of each name."""

    def __init__(self):
        self.root = Node("#root", None, False, 0)
        self.open, self.count = [self.root], Counter()
        self.named: list[Node] = []

    def add(self, name: str, attrs: str, stays: bool) -> None:
        up = self.open[-1]
        out = up.out or _out(name, attrs, bool(self.count["article"] or self.count["main"]))
        new = Node(name, up, out, 0 if out else _named(name, attrs))
        if new.named:
            self.named.append(new)
        up.kids.append(new)
        if stays:
            self.open.append(new)
            self.count[name] += 1

    def leave(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        while len(self.open) > depth:
            self.count[self.open.pop().name] -= 1

    def close_implied(self, names: set, stops: set) -> None:
        """Leave the outermost open element of ``names`` that no element of ``stops`` shields."""
        left = sum(self.count[x] for x in names)
        at, found = len(self.open) - 1, 0
        while left and self.open[at].name not in stops:
            if self.open[at].name in names:
                found, left = at, left - 1
            at -= 1
        if found:
            self.leave(found)

    def end(self, name: str) -> None:
        if self.count[name]:
            at = len(self.open) - 1
            while self.open[at].name != name:
                at -= 1
            self.leave(at)
        elif name == "p":
            self.add(name, "", False)


def parse(page: str) -> Node:
    """The element tree of a page, however broken: kids are nodes and decoded strings."""
    tree = _Tree()
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            tree.open[-1].kids.append(html.unescape(page[at:lt]))
            at = lt
            continue
        m = MARKUP.match(page, at) or LOOSE_TAG.match(page, at)
        if m is None:  # a lone "<"
            tree.open[-1].kids.append("<")
            at += 1
            continue
        at = m.end()
        if m.re is MARKUP:
            end, name, attrs = m["end"], m["name"], m["attrs"]
            if name is None:
                if m["cdata"]:
                    tree.open[-1].kids.append(m["cdata"])
                continue
        else:
            end, name, attrs = m[1], m[2], m[3]
        name = name.lower()
        if end:
            tree.end(name)
            continue
        if name == "html" or (name == "body" and tree.count["body"]):
            continue
        if name in CLOSES_P:
            tree.close_implied(P, P_SHIELDS)
        if name in CLOSED_BY:
            tree.close_implied(*CLOSED_BY[name])
        if name in RAW:
            tree.add(name, attrs, False)
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else n
        else:
            tree.add(name, attrs, name not in VOID and not (attrs.endswith("/") and name not in BLOCK))
    if tree.named:
        _judge_names(tree.root, tree.named)
    return tree.root


def _measure(root: Node) -> list[Node]:
    """Characters, tags, and what links hold of them, for every node outside furniture; children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if not isinstance(k, str) and not k.out)
    order.reverse()
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len(k) - k.count(" ") if k.strip() else 0
            elif not k.out:
                node.chars += k.chars
                node.tags += k.tags + (k.name != "br")
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.name == "a")
        if node.name == "a":
            node.link_chars = node.chars
    return order


def _body(root: Node, order: list[Node]) -> Node:
    return next((x for x in reversed(order) if x.name == "body"), root)


def _core(body: Node, inside: list[Node]) -> Node:
    return max(inside, key=lambda x: (x.sum, x.density)) if any(x.sum for x in inside) else body


def _judge_names(root: Node, named: list[Node]) -> None:
    """Put elements out that their names make furniture (``named``, in page order), unless they hold the article.

    Such an element stays where it holds most of the body's text that is no link, or the
    densest subtree; but not beside an article or main element that stands outside all
    of them, nor, without a paragraph or heading of its own, beside a title that does.
    Readers' comments, which may well hold most, stay only if nothing else has text.
    """
    def most(left: list[Node]) -> bool:
        order = _measure(root)
        body = _body(root, order)
        total = body.chars - body.link_chars
        if not total:
            return False
        _densities(order, body)
        core, holds = _core(body, _measure(body)), set()
        while core is not None:
            holds.add(id(core))
            core = core.up
        within, outside = set(), set()  # nodes inside named ones; names of the others with text
        for x in reversed(order):
            if x.named or id(x.up) in within:
                within.add(id(x))
            elif x.chars:
                outside.add(x.name)
        prose: dict[int, bool] = {}
        for x in order:
            prose[id(x)] = own = prose.get(id(x), False) or bool(x.chars) and (x.name == "p" or x.name in HEADINGS)
            if own:
                prose[id(x.up)] = True
        for x in left:
            if id(x) in prose:  # else inside an element that is out
                stays = x.chars and (id(x) in holds or (x.chars - x.link_chars) * 2 > total)
                x.out = not stays or not outside.isdisjoint(("article", "main") if prose[id(x)] else ("article", "main", "h1"))
        return True

    replies, others = [x for x in named if x.named == 2], [x for x in named if x.named == 1]
    for x in replies:
        x.out = True
    found = most(others)
    if not found and replies:
        for x in replies:
            x.out = False
        most(named)


def _densities(order: list[Node], body: Node) -> None:
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
            node.density = c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / base if lc else c / t
        node.sum = sum(k.density for k in node.kids if not isinstance(k, str) and not k.out)


def _text(node: Node) -> str:
    """The text below a node without furniture: blocks in page order, white space made one space."""
    parts, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.out:
            if x.name in BLOCK:
                parts.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.kids))
    return SPACES.sub(" ", "".join(parts)).strip()


def _leave_out_links(top: Node, least: float) -> None:
    """Mark blocks below ``top`` as out that are below the threshold because of their links.

    Links hold at least half of such a block, or it is a teaser: a box of which each heading
    is a link. Headings go with their box only, and a block with the title stays.
    """
    order, linked = _measure(top), set()
    for x in reversed(order):
        if x.name == "a" or id(x.up) in linked and x is not top:
            linked.add(id(x))
    heads: dict[int, list[int]] = {}  # of every node: headings, headings that are links, titles
    for x in order:
        n = heads.setdefault(id(x), [0, 0, 0])
        if x.name in HEADINGS and x.chars:
            n[0] += 1
            n[1] += x.link_chars == x.chars or id(x) in linked
            n[2] += x.name == "h1"
        if x is not top:
            up = heads.setdefault(id(x.up), [0, 0, 0])
            for k in range(3):
                up[k] += n[k]
    for x in order:
        if x is not top and x.name in BLOCK and x.name not in HEADINGS and x.chars and x.density < least:
            n, links, titles = heads[id(x)]
            if not titles and (x.link_chars * 2 >= x.chars or (n and n == links)):
                x.out = True


def _title(top: Node, body: Node) -> Node | None:
    """The title of an article or main element whose text is ``top``, where it stands before it."""
    around = top
    while around is not body and around.name not in ("article", "main"):
        around = around.up
    if around is top or around.name not in ("article", "main"):
        return None
    stack = [around]
    while stack:
        x = stack.pop()
        if x is top:
            return None
        if x.name == "h1" and x.chars:
            return x
        stack.extend(k for k in reversed(x.kids) if not isinstance(k, str) and not k.out)
    return None


def main_text(page: str | None) -> str:
    """The article's text of one page; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    body = _body(root, order)
    if not body.chars:
        return ""
    _densities(order, body)
    inside = _measure(body)
    core = _core(body, inside)
    least, x = core.density, core
    while x is not body:
        x = x.up
        least = min(least, x.density)
    # the lowest node above the core and all blocks as dense as the least dense node of its path
    marked = {id(x) for x in inside if x is core or (x.density >= least and x.chars and x is not body and x.name in BLOCK)}
    held, top = dict.fromkeys(map(id, inside), 0), body
    for x in inside:
        held[id(x)] += id(x) in marked
        if held[id(x)] == len(marked):
            top = x
            break
        held[id(x.up)] += held[id(x)]
    _leave_out_links(top, least)
    title = _title(top, body)
    return f"{_text(title)} {_text(top)}".strip() if title else _text(top)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` (main text of the whole page) and ``n_chars`` of every row.

    Null and empty pages, and pages without text outside furniture, give the empty
    text; broken markup is read as browsers read it, roughly; null ids and addresses stay
    null; repeated rows give equal results; an empty table gives an empty result;
    other columns are not read. One map over the rows, with no shuffle.
    """
    small_batches(pages.sparkSession, 200)
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h) for h in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], names=schema.names)

    out = pages.select(id_col, url_col, F.col(html_col)).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
