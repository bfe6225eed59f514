"""Main text of web pages by composite text density (operator 6).

Each page is parsed into a tree in one pass (implied end tags, raw-text
elements and unclosed tags as browsers treat them).  Parts that can't be
article text by element or role are left out of the tree's counts, and so are
parts whose class or id is wholly a name of surroundings ("sidebar",
"post-comments").  Names are a hint, not a verdict: a name after "with-", "has-",
"no-" or before "-free" names nothing; the named part with most non-link text
stays, with its named ancestors, if it holds four times the text outside all
named parts; a name among other words ("related-work") or on a paragraph,
heading or table only leaves a part out where links prevail or where it has less
than half of the article's characters a tag.  For every node, from characters C, tags T, link characters LC and link
tags LT:

    density = C/T * log_B(C/LC' * T/LT'),   B = ln(C/(C-LC)' * LC + LC_body/C_body * C + e)

(a dashed denominator is 1 where it would be 0).  A node's density sum adds the
densities of its children.  The node with the largest sum is the core of the
article; the smallest density on the path from it to the body is the
threshold.  An article element (or else main) around the core stands for it.  Its
parent contributes the siblings that reach the threshold, have more text than links
and are built like it (an article split into sections).  Other article elements of
the same main are parts as well if they are in no named part, have more text than
links and reach the threshold, or half of its like in characters a tag; inside the selected
subtrees nothing dense or thin is dropped, apart from the left-out parts.

Blocks are joined in page order by an empty line; white space inside a block
becomes one space; character references are decoded once, in text only.

Edge cases: null, empty or textless pages give the empty text; markup without
a body is treated as a body; broken markup never fails; depth is not limited
(no recursion); repeated rows give repeated results; extra columns are kept.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
                   "tfoot thead tr ul caption").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
                  "td": {"td", "th"}, "th": {"td", "th"}}
LIST_SCOPE = frozenset("ul ol dl table select menu".split())
# elements that never hold article text
DROPPED = frozenset(("script style textarea title xmp iframe noembed noframes head noscript template nav footer aside form button "
                     "select input option svg canvas object menu dialog audio video label fieldset").split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
# names (parts of class and id) of what surrounds an article
DROPPED_NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs pagination pager toc skip "
    "sidebar sidebars aside rail widget widgets related recommended recommendations recirculation trending popular "
    "footer foot masthead topbar toolbar bottombar copyright colophon "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts banner banners popup modal overlay paywall "
    "disclaimer newsletter subscribe subscription signup signin login register search "
    "comment comments commentlist reply replies respond disqus discussion guestbook reactions "
    "share sharing social follow followers form hidden").split())
# words that say nothing beside such a name, and words that turn it into a property of what holds it
FILLERS = frozenset((
    "a an and area article block blog body bottom box button buttons card cards col column container content entry false fixed footer group "
    "header inner item items layer left link links list lists main mobile desktop more of outer page panel part post posts primary "
    "row section secondary site slot story stories the thread to top true unit us wrap wrapper zone").split())
BEFORE = frozenset("has have with without no non not hide disable disabled enable enabled show".split())
AFTER = frozenset("free less enabled disabled open closed off on none".split())
# elements of running text: a name on them is that of a text, not of a part of the page
TEXTUAL = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption figure figcaption".split())
KEPT_TAGS = frozenset("html body main article".split())
SITE = frozenset("site page top global main".split())


class _Node:
    __slots__ = ("tag", "parent", "children", "named", "drop", "chars", "tags", "links", "link_tags", "density", "total", "holds_main",
                 "inside", "owner")

    def __init__(self, tag: str, parent, named: int):
        self.tag, self.parent, self.children, self.named = tag, parent, [], named
        self.drop, self.owner = False, None
        # within an article or main element
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.total = 0.0
        self.holds_main = False


def _single_name(single: str) -> int:
    """0: one word of a class or id names no surroundings, 1: it does among
    other words, 2: it says nothing else."""
    words = [w.lower() for w in _WORD.findall(single)]
    names = [i for i, w in enumerate(words) if w in DROPPED_NAMES
             and not (i and words[i - 1] in BEFORE) and not (i + 1 < len(words) and words[i + 1] in AFTER)]
    if "header" in words and (len(words) == 1 or not SITE.isdisjoint(words)):
        return 2
    if not names:
        return 0
    return 2 if all(w in DROPPED_NAMES or w in FILLERS or w.isdigit() for w in words) else 1


def _named_out(tag: str, attrs: str) -> int:
    """0: not named, 1 or 2: named by class or id, 3: by role or as hidden."""
    level = 0
    if not attrs or attrs.isspace():
        return level
    for m in _ATTR.finditer(attrs):
        name = m.group(1).lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if name in ("class", "id"):
            for single in value.split():
                level = max(level, _single_name(single))
        elif name == "role":
            if value.strip().lower() in DROPPED_ROLES:
                return 3
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return 3
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 3
    return min(level, 1) if tag in TEXTUAL else level


def _parse(page: str) -> tuple[_Node, list[_Node]]:
    """The tree's root and all nodes in page order.  Children are nodes and
    decoded strings."""
    root = _Node("html", None, 0)
    nodes, stack = [root], [root]
    pos, n = 0, len(page)

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(html.unescape(raw))

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            text(page[pos:])
            break
        m = _TOKEN.match(page, at) or _LOOSE.match(page, at)
        if m is None:                               # a plain "<"
            text(page[pos:at + 1])
            pos = at + 1
            continue
        text(page[pos:at])
        pos = m.end()
        groups = m.groupdict()
        if groups.get("cdata") is not None:
            stack[-1].children.append(groups["cdata"])
            continue
        if not groups["tag"]:
            continue
        tag = groups["tag"].lower()
        if groups["end"]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag not in BLOCK and stack[depth].tag in BLOCK:
                    break                           # an inline end tag never closes a block
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack[1:]):
            continue
        if tag == "html":
            continue
        if tag in BLOCK:                            # a block ends an open paragraph
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCK:
                    break
        closes = CLOSED_BY_SAME.get(tag)
        if closes:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in closes:
                    del stack[depth:]
                    if tag != "tr" or stack[-1].tag not in closes:
                        break
                elif stack[depth].tag in LIST_SCOPE:
                    break
        if tag == "body":                           # an unclosed head ends here
            del stack[1:]
        parent = stack[-1]
        node = _Node(tag, parent, _named_out(tag, groups["attrs"]))
        parent.children.append(node)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            pos = close.end() if close else n
        elif tag not in VOID and not groups["attrs"].endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag in BLOCK:
            stack.append(node)                      # "<div/>" is a start tag in pages
    return root, nodes


def _leave_out(root: _Node, nodes: list[_Node]) -> None:
    """Sets ``drop`` by element, role and name."""
    marks = False
    for node in reversed(nodes):
        if node.tag in ("main", "article"):
            node.holds_main = marks = True
        if node.holds_main and node.parent is not None:
            node.parent.holds_main = True
    gone, linked = {None: False}, {None: False}
    free, held = 0, {}
    for node in nodes:
        # a wrapper of the article is not left out for its name; a page header is, an article's is not
        up = node.parent
        own = node.tag in DROPPED or (not node.holds_main and node.tag not in KEPT_TAGS
                                      and (node.named == 3 or (node.tag == "header" and not node.inside)))
        gone[node] = gone[up] or own
        linked[node] = linked[up] or node.tag == "a"
        named = node.named == 2 and not node.holds_main and node.tag not in KEPT_TAGS
        node.owner = node if named else up.owner if up is not None else None
        if not gone[node] and not linked[node]:
            n = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
            if node.owner is None:
                free += n
            else:
                held[node.owner] = held.get(node.owner, 0) + n
    # the text itself may stand under a name; where elements mark the article, only inside of them
    most = max((x for x in held if x.inside or not marks), key=lambda x: held[x], default=None)
    stays = set(_path(most)) if most is not None and held[most] > 4 * free else set()
    for node in nodes:
        node.drop = gone[node] or (node.owner is node and node not in stays) or (node.parent is not None and node.parent.drop)


def _measure(root: _Node, nodes: list[_Node]) -> None:
    _leave_out(root, nodes)
    for node in reversed(nodes):
        if node.drop:
            continue
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            elif not c.drop:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.links += c.links
                node.link_tags += c.link_tags
        if node.tag == "a":
            node.links = node.chars
            node.link_tags += 1


def _path(node) -> Iterator[_Node]:
    while node is not None:
        yield node
        node = node.parent


def _density(node: _Node, body: _Node) -> float:
    c, t = node.chars, node.tags or 1
    if not c:
        return 0.0
    lc, lt = node.links, node.link_tags
    base = math.log(c / ((c - lc) or 1) * lc + (body.links / (body.chars or 1)) * c + math.e)
    inner = c / (lc or 1) * t / (lt or 1)
    return c / t * (math.log(inner) / math.log(base) if base > 1.0 and inner > 0 else math.log(inner) if inner > 0 else 0.0)


def _reads_on(x: _Node, threshold: float) -> bool:
    return x.density >= threshold and x.links * 2 < x.chars


def _marked(core: _Node, body: _Node) -> _Node | None:
    """The outermost article element around the core, or else the main element."""
    around = [x for x in _path(core) if x is not body]
    articles = [x for x in around if x.tag == "article"]
    return articles[-1] if articles else next((x for x in around if x.tag == "main"), None)


def _parts(core: _Node, body: _Node, threshold: float, live: list[_Node]) -> list[_Node]:
    """The parts of the article in page order."""
    # an element that marks an article holds the core's part of it whole
    top = _marked(core, body) or core
    if top is body or top.parent is None:
        return [top]
    parts = {x for x in top.parent.children if not isinstance(x, str) and not x.drop
             and (x is top or (_reads_on(x, threshold) and (x.tag == top.tag or x.tag in HEADINGS or x.tag == "p")))}
    if top.tag == "article":
        # other article elements are parts of it wherever they stand, but not
        # in or under a name of surroundings, nor outside of the core's main
        path = set(_path(top))
        main = next((x for x in path if x.tag == "main"), body)
        clear = {x: x is not top for x in path}
        # characters a tag: the composite density also grows with length, and a short article is one too
        thin = 0.5 * min(x.chars / (x.tags or 1) for x in path if x.chars and (x is not body.parent or body.tag != "body"))
        for x in live:
            if x not in clear:
                clear[x] = clear.get(x.parent, True) and x.named == 0 and x not in parts
                if (clear[x] and x.tag == "article" and x.links * 2 < x.chars and any(a is main for a in _path(x))
                        and (x.density >= threshold or x.chars / (x.tags or 1) >= thin)):
                    parts.add(x)
                    clear[x] = False
        parts = {x for x in parts if x is top or x.tag != "article" or x.named == 0}
    return [x for x in live if x in parts]


def _selected(root: _Node, nodes: list[_Node]) -> list[_Node]:
    body = next((x for x in nodes if x.tag == "body"), root)
    live = [x for x in nodes if not x.drop]
    for x in live:
        x.density = _density(x, body)
    for x in live:
        x.total = sum(c.density for c in x.children if not isinstance(c, str) and not c.drop and c.tag != "a")
    inside = [x for x in live if any(a is body for a in _path(x)) and x.chars]
    if not inside:
        return []
    core = max(inside, key=lambda x: (x.total, x.chars))
    threshold = min(x.density for x in _path(core) if x is not root or x is body)
    parts = _parts(core, body, threshold, live)
    path = set(_path(core))
    for x in live:
        # a name among other words, or on running text, leaves out what does not read like the article
        if x.named == 1 and x.tag not in KEPT_TAGS and x not in path and not x.holds_main:
            x.drop = x.links * 2 >= x.chars or x.chars * (core.tags or 1) * 2 < core.chars * (x.tags or 1)
    return [x for x in parts if not x.drop]


def _blocks(node: _Node) -> list[str]:
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            out.append(line)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x.drop and x is not node:
            continue
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            elif x.tag in ("br", "td", "th"):
                parts.append(" ")
            todo.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's text of one page."""
    if not page:
        return ""
    root, nodes = _parse(page)
    _measure(root, nodes)
    return "\n\n".join(line for part in _selected(root, nodes) for line in _blocks(part))


def extract(page: Column) -> Column:
    """Main text of each page; the empty text where there is none."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for start in range(0, len(batch), 256):
                out += [main_text(p) for p in batch.slice(start, 256).to_pylist()]
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(page)


def extract_pages(pages: DataFrame, markup: str = "html", out: str = "text") -> DataFrame:
    """Adds ``out`` (string, replacing a column of that name)."""
    return pages.withColumn(out, extract(F.col(f"`{markup}`")))
