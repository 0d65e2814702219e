"""Main text of web pages by tree scoring.

A page is parsed into a tree (implied end tags closed, scripts and styles skipped as raw text).
Subtrees that are page furniture by element, role or class name are left out; a name counts only
as a whole, if it says nothing but furniture and layout ("related-posts", not "related-work").
Every block of
text passes points for its length and its commas to its ancestors, halved with each level; an
ancestor's points are discounted by the share of its text that is link text. The best container
is kept together with its siblings that score well or are headings and plain paragraphs; an article
is kept together with articles beside it that score half as much or more.

Runs per page inside tasks; nothing is shuffled and one page is in memory as a tree at a time.
Parsing is linear in the page, unmatched tags included.

Defined cases: a null or empty page gives the empty text; a page without markup is one block;
rows that repeat give repeated results; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: element and attribute names of HTML
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed",
        "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
         "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del",
           "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s",
           "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
           "wbr", "img", "input"}
_SKIP = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg",
         "math", "canvas", "object", "audio", "video", "map", "fieldset", "head", "search"}
_SKIP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog",
               "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
_SKIP_NAMES = {
    "ad", "ads", "adbox", "adslot", "adsense", "advert", "adverts", "advertisement", "advertising",
    "author-box", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist",
    "consent", "cookie", "cookies", "disclaimer", "disqus", "dropdown", "footer", "gdpr", "header",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notification", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promotion",
    "recommended", "related", "replies", "reply", "responses", "rss", "share", "sharing", "sidebar", "signup",
    "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar",
    "widget"}
_KEEP_NAMES = {"article", "content", "main", "post", "story", "entry", "body"}
#: Words that may stand beside furniture in a compound name without changing what it says.
_LAYOUT_NAMES = {
    "area", "articles", "bar", "block", "bottom", "box", "btn", "button", "buttons", "col", "column",
    "container", "content", "div", "entries", "form", "global", "group", "id", "inner", "item", "items",
    "js", "left", "link", "links", "list", "main", "media", "nav", "outer", "page", "panel", "post",
    "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "stories", "top", "unit",
    "user", "wrap", "wrapper"}
_PASSING = {"p", "pre", "blockquote", "li", "dt", "dd", "td", "th"}
#: How sure it is that a subtree is furniture: a name may also describe a whole layout.
_BY_NAME = 2
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an opening tag closes implicitly, up to the nearest element of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPE = {"article", "section", "main", "body", "div", "td", "th", "li", "blockquote", "table",
          "aside", "header", "footer", "nav", "form", "figure", "dd", "button"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value only after an equals sign
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*?)(?:/?>|\Z)",
    re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[a-z]+")
_COMMAS = re.compile("[,\u060c\u3001\uff0c]")


class Node:
    __slots__ = ("tag", "parent", "children", "names", "skip", "score", "length", "linked")

    def __init__(self, tag: str, parent: "Node | None", names: frozenset = frozenset(),
                 skip: int = 0):
        self.tag, self.parent, self.names, self.skip = tag, parent, names, skip
        self.children: list = []
        self.score, self.length, self.linked = 0.0, 0, 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html_module.unescape(m[2] or m[3] or m[4] or "")
            for m in _ATTR.finditer(text)}


def _names(value: str) -> list[str]:
    """Class names or identifiers, in lower case, their parts separated by hyphens."""
    return re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().replace("_", "-").split()


def _says_furniture(name: str) -> bool:
    if name in _SKIP_NAMES:
        return True
    parts = _PART.findall(name)
    return any(p in _SKIP_NAMES for p in parts) and all(
        p in _SKIP_NAMES or p in _LAYOUT_NAMES for p in parts)


def _furniture(tag: str, attrs: dict[str, str], parent: Node) -> tuple[frozenset, int]:
    given = _names(f"{attrs.get('class', '')} {attrs.get('id', '')}")
    names = frozenset(p for n in given for p in _PART.findall(n))
    skip = tag in _SKIP or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
    skip = skip or bool(_HIDDEN_STYLE.search(attrs.get("style", "")))
    skip = skip or bool(_SKIP_ROLES & set(attrs.get("role", "").lower().split()))
    if tag == "header" and not skip:             # an article's own header holds its title
        node = parent
        while node is not None and node.tag not in ("article", "main"):
            node = node.parent
        skip = node is None
    if not skip and tag not in ("html", "body", "article", "main") and tag not in _HEADINGS:
        found = {n for n in given if _says_furniture(n)}
        of_header = all(not (set(_PART.findall(n)) & _SKIP_NAMES) - {"header"} for n in found)
        if found and not (of_header and names & _KEEP_NAMES):
            return names, _BY_NAME
    return names, skip


def parse(page: str) -> Node:
    """The element tree of a page; text is decoded, raw-text elements are empty."""
    root = node = Node("html", None)
    opened: Counter[str] = Counter()               # open elements by tag

    def climb(target: Node) -> Node:
        up = node
        while up is not target:
            opened[up.tag] -= 1
            up = up.parent
        return target

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            node.children.append(html_module.unescape(page[at:]))
            break
        if found.start() > at:
            node.children.append(html_module.unescape(page[at:found.start()]))
        at = found.end() if found.end() > found.start() else found.start() + 1
        tag = found["tag"]
        if tag is None:
            if found["cdata"]:
                node.children.append(found["cdata"])
            continue
        tag = tag.lower()
        if found["end"]:
            if opened[tag] and (tag in _INLINE or tag not in _VOID):
                up = node
                while up.tag != tag or up is root:
                    if tag in _INLINE and up.tag not in _INLINE:
                        up = None                # a stray inline end never closes a block
                        break
                    up = up.parent
                if up is not None:
                    node = climb(up.parent)
            continue
        if tag in ("html", "body") and node.tag == tag:
            continue
        if (tag not in _INLINE and tag not in _VOID or tag == "hr") and (
                opened["p"] or any(opened[h] for h in _HEADINGS)):
            node = climb(_close_paragraph(node))
        if tag in _CLOSES and any(opened[t] for t in _CLOSES[tag][0]):
            node = climb(_close(node, *_CLOSES[tag]))
        attrs = _attributes(found["attrs"]) if found["attrs"] else {}
        names, skip = _furniture(tag, attrs, node)
        child = Node(tag, node, names, skip)
        node.children.append(child)
        if tag in _RAW:
            child.skip = True
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in _VOID and not page.endswith("/>", found.start(), found.end()) \
                or tag not in _VOID and tag not in ("path", "use"):
            node = child
            opened[tag] += 1
    return root


def _close_paragraph(node: Node) -> Node:
    up = node
    while up is not None and up.tag not in _SCOPE and up.tag not in ("html",):
        if up.tag == "p" or up.tag in _HEADINGS:
            return up.parent
        up = up.parent
    return node


def _close(node: Node, closed: set, stops: set) -> Node:
    up, last = node, None
    while up is not None and up.tag not in stops:
        if up.tag in closed:
            last = up
        up = up.parent
    return last.parent if last is not None else node


def blocks(top: Node, names_count: bool = True) -> list[tuple[Node, str, int]]:
    """(block element, its text, how much of it is link text) in page order.

    Without ``names_count`` class names leave nothing out.
    """
    found: list[tuple[Node, str, int]] = []
    text: list[str] = []
    linked = 0
    owner = top

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            found.append((owner, joined, min(linked, len(joined))))
        text.clear()
        linked = 0

    # an explicit stack: (node, next child, was the text inside a link)
    stack: list[list] = [[top, 0, False]]
    while stack:
        entry = stack[-1]
        node, i, in_link = entry
        if i == len(node.children):
            stack.pop()
            if node.tag not in _INLINE:
                flush()
                up = node.parent
                while up is not None and up.tag in _INLINE:
                    up = up.parent
                owner = up or node
            continue
        entry[1] += 1
        child = node.children[i]
        if isinstance(child, str):
            text.append(child)
            if in_link:
                linked += len(" ".join(child.split()))
        elif child.tag in ("br", "wbr", "img", "input"):
            text.append(" " if child.tag == "br" else "")
        elif not child.skip or (child.skip == _BY_NAME and not names_count):
            if child.tag not in _INLINE:
                flush()
                owner = child
            stack.append([child, 0, in_link or child.tag == "a"])
    flush()
    return found


def main_text(page: str) -> str:
    """The main text of a page, blocks joined by an empty line."""
    if not page:
        return ""
    root = parse(page)
    found = blocks(root) or blocks(root, names_count=False)
    if not found:
        return ""
    scored: list[Node] = []
    for owner, text, linked in found:
        points = 1.0 + len(_COMMAS.findall(text)) + min(len(text) / 100.0, 3.0)
        if owner.tag in _HEADINGS or owner.tag in ("li", "dt", "td", "th"):
            points *= 0.5
        node, share = owner, 1.0
        if owner.tag in _PASSING or owner.tag in _HEADINGS:
            node = owner.parent or owner         # paragraphs pass their points on
            owner.length += len(text)
            owner.linked += linked
        while node is not None:
            if not node.length:
                scored.append(node)
            node.length += len(text)
            node.linked += linked
            node.score += points * share
            share /= 2.0
            node = node.parent
    def value(node: Node) -> float:
        bonus = 1.25 if node.tag in ("article", "main") or node.names & _KEEP_NAMES else 1.0
        return node.score * bonus * (1.0 - node.linked / node.length)

    best = max(scored, key=value)
    # a block-level ancestor that is marked as the article holds all of it
    up = best
    while up is not None:
        if up.tag == "article":
            best = up
            break
        up = up.parent
    kept = {id(best)}
    if best.tag == "article" and best.parent is not None:
        kept |= {id(s) for s in best.parent.children if isinstance(s, Node) and s.tag == "article"
                 and not s.skip and s.score and 2 * value(s) >= value(best)}
    if best.tag not in ("article", "main", "body", "html") and best.parent is not None:
        least = 0.2 * value(best)
        for sibling in best.parent.children:
            if isinstance(sibling, str) or sibling.skip or sibling is best:
                continue
            density = sibling.linked / sibling.length if sibling.length else 0.0
            if (sibling.score and value(sibling) >= least) or (
                    sibling.length and density < 0.25 and
                    (sibling.tag in _HEADINGS or sibling.tag in ("p", "pre", "blockquote"))):
                kept.add(id(sibling))
    out = []
    for owner, text, _ in found:
        node = owner
        while node is not None and id(node) not in kept:
            node = node.parent
        if node is not None:
            out.append(text)
    return "\n\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page or "") for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row of ``pages``."""
    return pages.selectExpr("CAST(page_id AS bigint) AS page_id", "CAST(url AS string) AS url",
                            "CAST(html AS string) AS html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
