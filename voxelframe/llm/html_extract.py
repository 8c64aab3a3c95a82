"""Main-text extraction from HTML by tree scoring.

A page becomes a tree (tolerant of unclosed and stray tags, and of broken attributes, which end at ">"). Blocks of text
score points for length and commas and pass them to their ancestors, less with each step; a container's sum
is discounted by its link density. The best container is widened to the article or main
element around it, and siblings that score well or read as prose join it. Navigation, page
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are cut before scoring, by element and by the words of class, id and role. A name marks an element if all
its words tell of such parts or of mere layout ("social-share", "ad-box", not "social-history").
A form that holds an article or main element, or most of the page's paragraphs, is no form but the page's frame and stays.

Defined results: null, empty or tagless-empty html gives an empty text; html without tags is
one block; a tag that the page's end cuts off is dropped; repeated rows are extracted each; other columns are ignored. A page is handled
alone, so its size bounds the memory; time grows with its length, however tags are nested or broken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: A start tag: quotes count only right after "=".
START = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)>", re.S)
CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*+)")
ATTR = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
RAW_END = {t: re.compile(rf"</{t}\s*(?:/?>|\s[^>]*>|\Z)|\Z", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul", "head", "caption",
}
#: Elements that never hold main text.
CUT = {"nav", "footer", "aside", "form", "button", "select", "option", "input", "head", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "map"} | RAW
#: Words of class, id and role that mark what is not main text.
CUT_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "disclaimer", "discussion", "disqus", "footer", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "navi", "newsletter", "notice", "notices",
    "notification", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promoted", "promotion", "recommend", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing",
    "sidebar", "sidenav", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "trending", "widget", "widgets", "alert", "dialog", "alertdialog", "tablist",
}
#: Words of names that tell of layout only.
LAYOUT = {
    "a", "above", "after", "area", "article", "articles", "aside", "b", "bar", "before", "below", "blog", "block", "body", "bottom", "box", "btn", "button", "buttons", "by", "c", "card", "center", "col", "column", "container", "content", "copyright", "dfp", "div",
    "dropdown", "el", "element", "entry", "fixed", "float", "for", "form", "global", "google", "gpt", "grid", "group", "hamburger", "header", "heading", "hidden", "holder", "icon", "icons", "id", "info", "inline", "inner", "item", "items", "js", "label", "language", "large", "law", "layer", "left", "link", "links",
    "list", "local", "main", "media", "mega", "message", "mobile", "module", "more", "network", "networks", "next", "now", "o", "outer", "page", "pane", "panel", "placeholder", "policy", "post", "posts", "prev", "previous", "primary", "reader", "readers", "region", "right", "row", "secondary", "section", "side",
    "site", "slot", "small", "sticky", "stories", "story", "tabs", "tags", "teaser", "text", "this", "thread", "title", "to", "toggle", "top", "ui", "unit", "us", "user", "view", "wide", "wp", "wrap", "wrapper", "x", "you", "zone",
}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Class names that tell of something elsewhere, or of a text's subject.
ABOUT = re.compile(r"(has|no|not|with|without|is|category|cat|tag|type|format|status|lang|js)[-_]", re.I)
#: Marks that hold even for what contains an article: such articles aren't the page's own.
OTHERS = {"comment", "comments", "commentlist", "replies", "reply", "discussion", "disqus", "respond", "related", "recommend", "recommended", "sidebar", "promo", "trending"}
#: Elements whose id, within an article or main, is an anchor made from the heading; a section's id that names reader comments still counts.
SLUGGED = {"section", "h1", "h2", "h3", "h4", "h5", "h6"}
READERS = {"comment", "comments", "commentlist", "disqus", "respond"}
#: Opening one of these ends an open one of those.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: An open p ends where one of these begins.
ENDS_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose own text is a paragraph's, and how much of it a form has at least that frames a page.
PROSE, FRAME = {"p", "pre", "blockquote", "div", "td", "li", "dd", "section"}, 140
SCOPE = {"table", "article", "section", "main", "div", "body", "html", "ul", "ol", "dl", "td", "blockquote", "aside", "nav", "form", "header", "footer", "td", "th"}


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "soft", "score", "chars", "links", "n")

    def __init__(self, tag: str, parent: Node | None, cut: bool, soft: bool = False):
        self.tag, self.parent, self.cut, self.soft = tag, parent, cut, soft
        self.kids: list[Node | str] = []
        self.score = 0.0
        self.chars = self.links = self.n = 0


class Open:
    """The open elements, with the depths at which each tag and each scope is open: every question takes one step."""

    def __init__(self, root: Node):
        self.path = [root]
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    @property
    def here(self) -> Node:
        return self.path[-1]

    def push(self, node: Node) -> None:
        if node.tag in SCOPE:
            self.scopes.append(len(self.path))
        self.at.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def cut(self, depth: int) -> None:
        """Close what is open at ``depth`` and deeper; the root stays."""
        while len(self.path) > max(depth, 1):
            node = self.path.pop()
            self.at[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()

    def last(self, tags: set[str]) -> int:
        """Depth of the innermost open element of these tags, or 0."""
        return max((d[-1] for t in tags if (d := self.at.get(t))), default=0)

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0


def _mark(name: str) -> list[str]:
    return [w.lower() for w in WORD.findall(name)]


def _unwanted(tag: str, attrs: str, opened: Open) -> tuple[bool, bool]:
    """Whether an element is cut, and whether only by words that an article inside outweighs."""
    own = bool(opened.last({"article", "main"}))
    if tag in CUT or (tag == "header" and not own):
        return True, tag == "form"
    if not attrs or tag in ("html", "body", "main"):
        return False, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True, False
    if tag in SLUGGED and own and not (tag == "section" and READERS & set(_mark(found.get("id", "")))):
        found.pop("id", None)
    names = [n for k in ("class", "id", "role") if k in found for n in found[k].split() if not ABOUT.match(n)]
    words = [_mark(n) for n in names]
    if tag == "article":
        return any(w and w[0] in OTHERS for w in words), False
    marks = {x for w in words if all(x in CUT_WORDS or x in LAYOUT for x in w) for x in w}
    page_header = any("header" in w and not {"article", "post", "entry", "content", "story"} & set(w) for w in words) and not own and tag in ("div", "section", "td", "table", "tr")
    hit = marks & CUT_WORDS
    return bool(hit) or page_header, not hit & OTHERS


def _settle(root: Node) -> Node:
    """Cuts that an article outweighs don't hold around the page's own article; what lies in a cut element is cut."""
    order = [n for n, enter in _walk(root) if enter]
    closed, holds, prose = set(), set(), {}
    for node in order:  # from the top: those under a cut that always holds
        if node.parent is not None and (node.parent in closed or node.parent.cut and not node.parent.soft):
            closed.add(node)
    for node in reversed(order):  # from below: those around an article, and the characters of paragraphs
        if node in closed:
            continue
        if node.tag in ("article", "main") and not node.cut:
            holds.add(node)
        if node.tag in PROSE:
            prose[node] = prose.get(node, 0) + sum(len(x.strip()) for x in node.kids if isinstance(x, str))
        if node.parent is not None:
            if node in holds:
                holds.add(node.parent)
            if prose.get(node) and not (node.cut and node.tag != "form"):
                prose[node.parent] = prose.get(node.parent, 0) + prose[node]
    for node in order:
        if node.cut and node.soft and (node in holds or node.tag == "form" and prose.get(node, 0) >= FRAME and 2 * prose[node] > prose.get(root, 0)):
            node.cut = False
        node.cut = node.cut or (node.parent is not None and node.parent.cut)
    return root


def parse(html: str) -> Node:
    """The tree of a page; texts are unescaped strings among an element's children."""
    root = Node("html", None, False)
    opened = Open(root)
    at, end, final = 0, len(html), html.rfind(">")
    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            opened.here.kids.append(unescape(html[at:]))
            break
        following = html[begin + 1 : begin + 2]
        letter = html[begin + 2 : begin + 3] if following == "/" else following
        if following not in ("!", "?") and not (letter.isascii() and letter.isalpha()) or not following:
            opened.here.kids.append(unescape(html[at : begin + 1]))
            at = begin + 1
            continue
        if begin > at:
            opened.here.kids.append(unescape(html[at:begin]))
        if html.startswith("<!--", begin):
            stop = html.find("-->", begin + 4)
            at = end if stop < 0 else stop + 3
            continue
        if html.startswith("<![CDATA[", begin):
            stop = html.find("]]>", begin)
            opened.here.kids.append(html[begin + 9 : stop if stop >= 0 else end])
            at = end if stop < 0 else stop + 3
            continue
        if begin > final:
            break  # a tag that the end cuts off
        if following in ("!", "?", "/"):
            at = html.find(">", begin) + 1
            if following == "/" and (m := CLOSE.match(html, begin)):
                _close(opened, m[1].lower())
            continue
        m = START.match(html, begin)
        if m:
            tag, attrs, at = m[1].lower(), m[2], m.end()
        else:  # a quote that isn't closed before the end: the tag ends at the first ">"
            at = html.find(">", begin) + 1
            tag, attrs = CLOSE.match("</" + html[begin + 1 : at])[1].lower(), ""
        at = _start(opened, root, tag, attrs, html, at)
    return _settle(root)


def _close(opened: Open, tag: str) -> None:
    depth = opened.last({tag})
    if depth and (tag in SCOPE or depth > opened.scope()):
        opened.cut(depth)
    elif tag in ("p", "br"):
        opened.here.kids.append(Node(tag, opened.here, False))


def _start(opened: Open, root: Node, tag: str, attrs: str, html: str, at: int) -> int:
    """Open an element, with what HTML closes before it; the place to read on from."""
    if tag == "html" and opened.here is not root:
        return at
    closing = ENDS.get(tag, set()) | ({"p"} if tag in ENDS_P else set()) | (HEADINGS if tag in HEADINGS else set())
    if closing:
        depth = opened.last(closing)
        # cells of a table are closed by the next cell or row though they are scopes
        fence = max((d for d in opened.scopes[-3:] if not (tag in ENDS and opened.path[d].tag in ("td", "th"))), default=0)
        while depth and depth > fence:
            opened.cut(depth)
            depth = opened.last(closing) if tag in ENDS and opened.here.tag in closing else 0
            fence = 0
    if tag == "body":
        opened.cut(1)  # whatever the head left open
    child = Node(tag, opened.here, *_unwanted(tag, attrs, opened))
    opened.here.kids.append(child)
    if tag in RAW:
        return RAW_END[tag].search(html, at).end()
    if tag not in VOID and (not attrs.endswith("/") or tag in BLOCK or tag in ("span", "a", "b", "i")):  # HTML ignores the slash
        opened.push(child)
    return at


def _walk(root: Node) -> list[tuple[Node, bool]]:
    """Nodes in order, each on entering (True) and on leaving (False)."""
    out, stack = [], [(root, True)]
    while stack:
        node, enter = stack.pop()
        out.append((node, enter))
        if enter:
            stack.append((node, False))
            stack.extend((k, True) for k in reversed(node.kids) if isinstance(k, Node))
    return out


def _score(root: Node) -> Node | None:
    """Fill in scores; the best container, or None where nothing scores."""
    order = [n for n, enter in _walk(root) if not enter and not n.cut]
    for node in order:
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        below = [k for k in node.kids if isinstance(k, Node) and not k.cut]
        node.chars = own + sum(k.chars for k in below)
        node.links = node.chars if node.tag == "a" else sum(k.links for k in below)
        node.n = any(k.tag in BLOCK or k.n for k in below)
    for node in order:
        if node.n or node.tag not in BLOCK or node.chars < 25 or node.tag in ("li", "th") and node.links * 2 > node.chars:
            continue
        commas = sum(k.count(",") + k.count("،") + k.count("、") + k.count("，") for k in _strings(node))
        points = (1 + commas + min(node.chars / 100, 3)) * (1 - node.links / node.chars)
        share, up = 1.0, node.parent
        if node.tag == "div":
            up = node
        for step in range(5):
            if up is None:
                break
            up.score += points * share
            share = 0.5 if step == 0 else share * 2 / 3 / (step + 1)
            up = up.parent
    scored = [n for n in order if n.score > 0]
    for n in scored:
        n.score *= 1 - n.links / max(1, n.chars)
    return max(scored, key=lambda n: n.score, default=None)


def _strings(node: Node) -> Iterator[str]:
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif not x.cut:
            stack.extend(reversed(x.kids))


def _chosen(root: Node) -> list[Node]:
    best = _score(root)
    if best is None:
        named = [n for n, enter in _walk(root) if enter and not n.cut and n.chars and n.tag in ("article", "main")]
        return [max(named, key=lambda n: n.chars)] if named else [root]
    up = best
    while up is not None:  # the outermost article, or main element, around it
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    if best.tag in ("article", "main", "html", "body"):
        return [best]
    kept = []
    for k in best.parent.kids if best.parent else [best]:
        if k is best:
            kept.append(k)
        elif isinstance(k, Node) and not k.cut and k.chars:
            density = k.links / k.chars
            prose = re.fullmatch("p|pre|blockquote|h[1-6]|ul|ol|table|figure|dl", k.tag) and density < 0.25
            if prose or k.score >= max(2, 0.2 * best.score) and density < 0.5:
                kept.append(k)
    return kept


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    blocks: list[list[str]] = [[]]
    for top in _chosen(root):
        stack: list[tuple[Node | str, bool]] = [(top, True)]
        blocks.append([])
        while stack:
            x, enter = stack.pop()
            if isinstance(x, str):
                blocks[-1].append(x)
            elif x.tag in ("br", "hr"):
                blocks[-1].append(" ")
            elif not enter:
                blocks.append([])
            elif not x.cut:
                if x.tag in BLOCK:
                    blocks.append([])
                    stack.append((x, False))
                stack.extend((k, True) for k in reversed(x.kids))
        blocks.append([])
    return " ".join(t for b in blocks if (t := " ".join("".join(b).split())))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
