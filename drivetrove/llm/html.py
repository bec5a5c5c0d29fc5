"""Main text of web pages by tree scoring.

Paragraphs give points for length and commas to their ancestors, less with each level and discounted by link density; the
best container is kept together with siblings that score well or read like prose. What is boilerplate by its element or role is
taken out before and never counts, and what is by its name, unless it holds the article or much of the page.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, small_batches, texts

# A quote opens a value only right after "="; one that never closes is a plain character, so that the tag ends at the next ">".
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
_ATTRIBUTES = re.compile(r"""([^\s=/>][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPACE = re.compile(r"\s+")
# Element names of the HTML standard by role.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "datalist", "fieldset", "label", "dialog", "menu", "svg", "canvas", "object",
           "audio", "video", "map", "math", "head", "applet", "input", "output", "progress", "meter", "iframe"} | RAW
BLOCK = {"address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr",
         "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd", "figcaption"}
CLOSES_P = BLOCK - {"html", "body"} | {"nav", "header", "footer", "aside", "form", "fieldset", "menu", "dialog"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
             "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
WALLS = {"td", "th", "table", "ul", "ol", "dl", "body", "html", "article", "section", "main", "div", "blockquote", "nav", "header", "footer", "aside", "form", "menu"}
WEIGHT = {"article": 25.0, "main": 25.0, "section": 3.0, "div": 2.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "table": -1.0,
          "h1": -5.0, "h2": -5.0, "h3": -5.0, "h4": -5.0, "h5": -5.0, "h6": -5.0}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
#: Words of class and id names, as whole parts between separators, that mark boilerplate; those of the first kind at any size.
_NEVER = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|breadcrumbs?|comments?|disqus|replies|respond|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|subscription|signup|"
                    r"login|pagination|pager|related|recommend\w*)(?:$|[_-]|\d)", re.I)
_BAD = re.compile(r"(?:^|[_-])(?:banner|nav\w*|menu\w*|sidebar\w*|footer\w*|header|masthead|notices?|overlay|share|sharing|social|toolbar|widgets?|search|form|alert|disclaimer|copyright|skip|"
                  r"hidden|legal)(?:$|[_-]|\d)", re.I)
#: Names that speak of something else: what a layout has or lacks, categories, utility classes.
_ABOUT = re.compile(r"^(?:has|have|with|without|no|not|layout|category|cat|tag|overflow|visually|is|js|theme)[_-]", re.I)
_GOOD = re.compile(r"(?:^|[_-])(?:article\w*|body|content\w*|entry\w*|main|page|post\w*|story\w*|text)(?:$|[_-]|\d)", re.I)


class Node:
    __slots__ = ("tag", "up", "kids", "score", "names", "size", "linked", "commas", "bad", "holds")

    def __init__(self, tag: str, up: Node | None, names: str = ""):
        self.tag, self.up, self.kids, self.names = tag, up, [], names
        self.bad, self.holds = badness(names) if names else 0, False  # how surely it is boilerplate by name; whether an article is in it
        self.score, self.size, self.linked, self.commas = 0.0, 0, 0, 0


def badness(names: str) -> int:
    """2 for names that mark boilerplate of any size, 1 for those that may be part of an article's, else 0."""
    told = [n for n in names.split() if not _ABOUT.match(n)]
    if any(_NEVER.search(n) for n in told):
        return 2
    return int(any(_BAD.search(n) for n in told) and not any(_GOOD.search(n) and not _BAD.search(n) for n in told))


def attributes(text: str) -> tuple[str, bool]:
    """Class and id names, and whether the element is out by its attributes."""
    names, out, seen = [], False, set()
    for m in _ATTRIBUTES.finditer(text):
        name, value = m[1].lower(), (m[2] or "").strip()
        value = value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0] else value
        if name in seen:
            continue  # the first of equal attributes counts
        seen.add(name)
        if name in ("class", "id"):
            names.append(value)
        elif name == "role":
            out |= value.strip().lower() in ROLES
        elif name == "hidden":
            out = True
        elif name == "aria-hidden":
            out |= value.lower() == "true"
        elif name == "style":
            out |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return " ".join(names), out


def parsed(html: str) -> Node:
    """Tree of the elements that may hold main text; texts are kept as strings among the children."""
    root = Node("html", None)
    at, here, end = 0, root, len(html)
    while at < end:
        m = _MARKUP.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            here.kids.append(unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            if tag in VOID or tag in ("html", "body"):
                continue
            node = here
            while node is not None and node.tag != tag and not (node.tag in WALLS and tag not in WALLS):
                node = node.up
            if node is not None and node.tag == tag and node.up is not None:
                here = node.up
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if tag == "br" or tag == "wbr" or tag == "hr":
            if tag == "hr":
                here.kids.append(Node("hr", here))
            elif tag == "br":
                here.kids.append(" ")
            continue
        names, out = attributes(m[3]) if m[3] and not m[3].isspace() else ("", False)
        here = opened(here, tag)
        if tag in DROPPED or out:
            here.kids.append(" ")
            if tag not in VOID and not m[3].endswith("/"):
                here = Node(tag, here)  # hangs below no one's children, so nothing in it counts
            continue
        if tag in VOID:
            continue
        node = Node(tag, here, names)
        here.kids.append(node)
        here = node
    return root


def opened(here: Node, tag: str) -> Node:
    """Where a new element goes, after the ends that HTML leaves out."""
    if tag in CLOSES_P:
        node = here
        while node is not None and node.tag not in WALLS and node.tag != "p":
            node = node.up
        if node is not None and node.tag == "p":
            here = node.up
    if tag in CLOSED_BY:
        node = here
        while node is not None and node.tag not in CLOSED_BY[tag] and not (node.tag in WALLS and node.tag not in ("td", "th")):
            node = node.up
        if node is not None and node.tag in CLOSED_BY[tag]:
            here = node.up
    return here


def in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed([k for k in node.kids if isinstance(k, Node)]))
    return out


def measured(nodes: list[Node]) -> None:
    """Text, linked text and commas below each node; children come before parents in reverse order."""
    for node in reversed(nodes):
        node.size = node.linked = node.commas = 0
        for kid in node.kids:
            if isinstance(kid, str):
                size = len(_SPACE.sub(" ", kid).strip())
                node.size += size
                node.linked += size if node.tag == "a" else 0
                node.commas += kid.count(",") + kid.count("，") + kid.count("、")
            else:
                node.size += kid.size
                node.linked += kid.size if node.tag == "a" else kid.linked
                node.commas += kid.commas
                node.holds |= kid.holds or (kid.tag in ("article", "main") and not kid.bad)


def pruned(root: Node) -> list[Node]:
    """The nodes without what is boilerplate by its name. That never takes an element around an article, and by the weaker names none
    with more than a third of the page's text, unless most of it is links; such a name just lowers the score."""
    nodes = in_order(root)
    measured(nodes)
    cut = {id(n) for n in nodes if n.bad and not n.holds and n is not root and (n.tag not in ("article", "main") or n.bad == 2)
           and (n.bad == 2 or 3 * n.size <= root.size or 2 * n.linked > n.size)}
    if not cut:
        return nodes
    for node in nodes:
        node.kids = [" " if not isinstance(k, str) and id(k) in cut else k for k in node.kids]
    nodes = in_order(root)
    measured(nodes)
    return nodes


def scored(nodes: list[Node]) -> None:
    for node in nodes:
        if node.tag in WEIGHT:
            node.score += WEIGHT[node.tag]
        if node.names:
            node.score += -25.0 if node.bad else 15.0 if any(_GOOD.search(n) for n in node.names.split()) else 0.0
    for node in nodes:
        own = node.tag in PARAGRAPHS or (node.tag in BLOCK and any(isinstance(k, str) and k.strip() for k in node.kids))
        if not own or node.size < 25:
            continue
        points = (1 + node.commas + min(node.size / 100, 3.0)) * (1 - node.linked / max(1, node.size))
        up, part = node.up, 1.0
        level = 0
        while up is not None and level < 5:
            up.score += points * part
            level += 1
            part = 0.5 if level == 1 else 1 / (3 * level)
            up = up.up


def density(node: Node) -> float:
    return node.linked / max(1, node.size)


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below the given nodes, in page order."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        if text:
            out.append(text)

    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                buffer.append(item)
            else:
                if item.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(item.kids))
        flush()
    return out


def main_text(html: str) -> str:
    """The article of a page: blocks joined by empty lines; empty where there is none."""
    root = parsed(html)
    nodes = pruned(root)
    scored(nodes)
    areas = [n for n in nodes if n.tag in BLOCK or n is root]
    best = max(areas, key=lambda n: n.score * (1 - density(n)), default=root)
    if best.score <= 0 and best.size == 0:
        best = root
    inside = best
    while inside is not None:  # what the page itself marks as its article goes first
        if inside.tag in ("article", "main"):
            best = inside
        inside = inside.up
    if best.tag not in ("article", "main"):
        held = [n for n in areas if n.tag in ("article", "main") and n.size]
        if len(held) == 1 and held[0].size * 2 > best.size:
            best = held[0]
    chosen = [best]
    if best.up is not None:
        limit = max(10.0, best.score * (1 - density(best)) * 0.2)
        chosen = []
        for kid in best.up.kids:
            if kid is best:
                chosen.append(kid)
            elif isinstance(kid, Node) and kid.tag in BLOCK and best.tag not in ("article", "main"):
                score = kid.score * (1 - density(kid)) + (best.score * 0.2 if kid.names and kid.names == best.names else 0)
                prose = kid.tag == "p" and (kid.size > 80 and density(kid) < 0.25 or 0 < kid.size <= 80 and density(kid) == 0)
                heading = kid.tag in ("h1", "h2", "h3") and density(kid) == 0
                if score >= limit or prose or heading:
                    chosen.append(kid)
            elif isinstance(kid, Node) and kid.tag == "article" and best.tag == "article" and kid.score * (1 - density(kid)) >= limit:
                chosen.append(kid)
    return "\n\n".join(blocks(chosen))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text (main text, empty if none), n_chars.

    Character references are decoded, white space inside a block becomes one space, blocks follow in page order with an empty
    line between. NULL or empty html: empty text. Unclosed and stray tags are taken as browsers do in the common cases; a page
    without markup is one block. Repeated rows are treated alike, ids and urls may be NULL, empty input gives no rows.
    """

    def run(batches):
        for batch in batches:
            for part in small_batches(batch, "html"):
                made = [main_text(h) for h in texts(part.column("html"))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    return only(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")
