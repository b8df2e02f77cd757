"""Main text of web pages by composite text density.

A tolerant scanner builds the element tree: void elements, implied end tags, unclosed and stray tags, raw-text elements.
Elements that are never content (menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) are left out, as told below. For every other node the link-adjusted density is

    D = (C / T) * log(C T / (LC LT)) / log(log(C / (C - LC) * LC + LC / B * C + e))

with C characters, T tags, LC link characters and LT link tags of its subtree and C and LC of the body in B. A node's
density sum adds its children's densities. The threshold is the least density on the path from the node of the largest
sum up to the body; every node that reaches it marks the subtree of the largest sum below it. Where the node of the largest
sum lies in an ``article`` or ``main`` element the choice is widened to that whole element, so that no paragraph of it is lost.

Defined results: a null or empty page, or one without content, gives an empty text. Character references are decoded,
white space inside a block becomes one space, blocks are trimmed and joined by two line feeds in page order. Other
columns are ignored; repeated rows give repeated rows. The scan is one pass, holds one page at a time and takes time linear
in its length, however many elements are nested, unclosed or ended without a start.

A class name or id drops an element where every part of it is a noise word or a word for a frame around one, so ``comments`` and
``share-buttons`` go while ``page-with-sidebar``, ``side-effects`` and ``related-work`` stay. Outside an article one that only
holds a noise word drops an element if a third of its text is links. A form, or an element with such a name or role, that holds
nearly all of the page's remaining text is its wrapper and stays. Headings inside an article always stay.

Sibling articles of comparable density are kept together, and a choice without a heading takes the block with the title just before it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIP = frozenset("head nav footer aside form script style noscript template textarea title iframe object svg canvas button select dialog menu noembed noframes xmp".split())
#: What can lie in a head; anything else that starts, text too, ends an open one.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: An open element of the key's kind ends where one of its values starts.
ENDS = {
    "p": BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary", "figcaption", "li", "dd", "dt"},
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
#: Words that a class or id holds somewhere where it may mark what is not the article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscribe|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebars?|side|aside|footer|header|masthead|toolbar|share|sharing|social|related|recommend\w*|"
    r"comments?|disqus|replies|respond|reactions|search\w*|login|signup|widget\w*|pagination|pager|tags)(?:$|[\s_-])",
    re.I,
)
#: Where the search for an implied end stops, and where that for an inline end tag does.
BOUNDS = frozenset("article main section div td table ul ol body blockquote".split())
SCOPES = frozenset("article main td table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Inside an article a class name is noise only as a whole: noise words, and words for a frame around them.
NOISE_PART = re.compile(
    r"ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscribe|nav\w*|menu\w*|"
    r"breadcrumbs?|sidebars?|aside|footer|toolbar|share|sharing|social|related|recommend\w*|comments?|disqus|replies|respond|"
    r"reactions|search\w*|login|signup|widget\w*|pagination|pager|tags",
    re.I,
)
FRAME = re.compile(
    r"box|lists?|section|area|block|container|wrapper|wrap|bar|items?|links?|panel|inner|outer|content|main|top|bottom|left|right|"
    r"posts?|page|site|articles?|stories|entry|module|row|col|form|buttons?|icons?|text|inline|js|is|unit|slot|\w?\d+",
    re.I,
)
#: Outside an article a name is noise as a whole by these too.
OUTER_PART = re.compile(r"header|masthead|side|sharing|replies", re.I)
#: Reader comments are never the page's wrapper, as long as there is other text.
READERS = re.compile(r"comments?|disqus|replies|respond|reactions", re.I)
#: What an element's tag, name or role says of it: to be kept, dropped if it is mostly links, dropped unless it is the page's
#: wrapper, the same for reader comments, or dropped with all that is in it.
KEEP, LINKS, WRAPPER, COMMENTS, DROP = range(5)
#: A wrapper has so many times the text that is left of the page without it.
WRAPS = 10
#: Sibling articles are kept down to this part of the chosen one's density.
COMPARABLE = 1 / 4
#: Elements that can hold an article; the node of the largest density sum is one of them.
CONTAINERS = frozenset("#root article blockquote body center div form html main section table tbody td tr".split())
#: A quotation mark opens a value only after an equals sign; one that never closes does not hide the rest of the page.
_PIECES = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*)(?:>|\Z)", re.S)
#: One attribute: its name, then a quoted or bare value. A quoted value that never closes takes the rest of the tag.
_ATTRIBUTE = re.compile(r"([^\s/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|(\S+)))?")
_WHITE = re.compile(r"\s+")


class Node:
    """An element. ``stop``, ``scope`` and ``article`` are its nearest ancestors, itself included, where a search for an
    implied end looks, where an inline end tag stops looking, and that are an article or main element; ``open`` counts
    the open inline elements of a scope by tag."""

    __slots__ = ("article", "chars", "children", "density", "doubt", "link_chars", "link_tags", "open", "parent", "parts", "scope", "skip", "stop", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, skip: bool, doubt: int = KEEP):
        self.doubt = doubt
        self.tag, self.parent, self.skip = tag, parent, skip
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.open: dict[str, int] = {}
        self.stop: Node = self if parent is None or tag in ENDS or tag in BOUNDS else parent.stop
        self.scope: Node = self if parent is None or tag in SCOPES else parent.scope
        self.article: Node | None = self if tag in ("article", "main") else parent.article if parent is not None else None


def _framed_noise(name: str, inside_article: bool = True) -> int:
    """WRAPPER or COMMENTS if every part of a class name or id is a noise word or a word for a frame, and one is a noise word; else KEEP."""
    found = KEEP
    for part in re.split(r"[_-]+", name):
        if NOISE_PART.fullmatch(part) or not inside_article and OUTER_PART.fullmatch(part):
            found = max(found, COMMENTS if READERS.fullmatch(part) else WRAPPER)
        elif part and not FRAME.fullmatch(part):
            return KEEP
    return found


def _noise(tag: str, attributes: str, inside_article: bool) -> int:
    """What an element's start tag says of it."""
    if tag == "form":
        found = WRAPPER
    elif tag in SKIP:
        return DROP
    elif tag == "header":
        return KEEP if inside_article else DROP
    elif not attributes or tag in ("html", "body", "article", "main"):
        return KEEP
    else:
        found = KEEP
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return DROP
        if name == "role" and (value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog") or value == "alert" and not inside_article):
            found = max(found, WRAPPER)
        elif inside_article:
            if tag not in HEADINGS and (name == "class" or name == "id" and tag in ("div", "ul", "ol")):
                found = max(found, *map(_framed_noise, value.split()), KEEP)
        elif name in ("class", "id"):
            found = max(found, *(_framed_noise(token, False) for token in value.split()), LINKS if NOISE.search(value) else KEEP)
    return found


def parse(html: str) -> Node:
    """The tree of a page; nodes that are never content are marked ``skip``, and so are those below them."""
    root = Node("#root", None, False)
    node, at, size = root, 0, len(html)
    opened: dict[str, int] = {}  # open elements by tag

    def text(raw: str) -> None:
        while node.tag == "head" and raw.strip():
            close(node)
        if raw and not node.skip:
            node.parts.append(raw)

    def begin(child: Node) -> None:
        nonlocal node
        for counts in (opened, child.parent.scope.open):
            counts[child.tag] = counts.get(child.tag, 0) + 1
        node = child

    def close(up: Node) -> None:
        """End ``up`` and all that is open inside it; an element is ended once, so all ends together take linear time."""
        nonlocal node
        while True:
            opened[node.tag] -= 1
            node.parent.scope.open[node.tag] -= 1
            last, node = node, node.parent
            if last is up:
                break

    while at < size:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        match = _PIECES.match(html, start)
        if match is None:  # a lone <
            text(html[at : start + 1])
            at = start + 1
            continue
        text(html[at:start])
        at = match.end()
        tag = match[2]
        if tag is None:
            if html.startswith("<![CDATA[", start):
                text(html[start + 9 : at].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if match[1]:
            # a stray end tag ends nothing, and one of an inline element nothing outside its scope
            if (opened if tag in BLOCK else node.scope.open).get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                close(up)
            elif tag == "br":
                text(" ")
            continue
        while node.tag == "head" and tag not in HEAD:
            close(node)
        if tag in VOID or match[3].endswith("/") and tag not in BLOCK:
            if tag == "hr":
                child = Node(tag, node, node.skip)
                node.children.append(child)
                node.parts.append(child)
            else:
                text(" " if tag == "br" else "")
                node.tags += 1
            continue
        up = node.stop  # one of each kind at most is open below a bound, so this looks at a few nodes
        while up.parent is not None:
            if tag in ENDS.get(up.tag, ()):
                close(up)
                break
            if up.tag in BOUNDS:
                break
            up = up.parent.stop
        doubt = _noise(tag, match[3], node.article is not None)
        child = Node(tag, node, node.skip or doubt == DROP, doubt)
        node.children.append(child)
        node.parts.append(child)
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(tag)}[\s/>]|</{re.escape(tag)}\Z", re.I).search(html, at)
            stop = end.start() if end else size
            if not child.skip:
                child.parts.append(html[at:stop])
            after = html.find(">", stop) if end else -1
            at = after + 1 if after >= 0 else size
            continue
        begin(child)
    return root


def settle(root: Node) -> None:
    """Mark the doubtful elements that are not content ``skip``, with all that is in them."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(n.children)
    if not any(KEEP < n.doubt < DROP and not n.skip for n in order):
        return
    size = {id(n): [0, 0, 0] for n in order}  # characters, those in links, and those outside doubtful elements
    for n in reversed(order):
        if n.skip:
            continue
        own = size[id(n)]
        more = sum(len(_WHITE.sub("", p)) for p in n.parts if isinstance(p, str))
        own[0], own[2] = own[0] + more, own[2] + more
        if n.tag == "a":
            own[1] = own[0]
        if n.doubt == LINKS and 3 * own[1] >= own[0]:
            n.skip = True
        elif n.parent is not None:
            up = size[id(n.parent)]
            up[0], up[1] = up[0] + own[0], up[1] + own[1]
            up[2] += own[2] if n.doubt in (KEEP, LINKS) else 0
    left = size[id(root)][2]
    for n in order:  # from the outside in
        if n.parent is not None and n.parent.skip:
            n.skip = True
        elif not n.skip and n.doubt in (WRAPPER, COMMENTS):
            own = size[id(n)][2]
            if own > WRAPS * left and (n.doubt == WRAPPER or not left):
                left += own
            else:
                n.skip = True


def measure(root: Node) -> list[Node]:
    """Set every node's counts, density and density sum; gives the nodes in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(reversed(n.children))
    for n in reversed(order):
        if n.skip:
            continue
        n.chars += sum(len(_WHITE.sub("", p)) for p in n.parts if isinstance(p, str))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if (up := n.parent) is not None:
            up.chars += n.chars
            up.tags += n.tags + 1
            up.link_chars += n.link_chars
            up.link_tags += n.link_tags
    total, linked = max(root.chars, 1), root.link_chars
    for n in order:
        if n.skip or not n.chars:
            continue
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, max(n.link_tags, 1)
        base = math.log(c / max(c - lc, 1) * lc + linked / total * c + math.e)
        n.density = max(0.0, c / t * math.log(max(c * t / (max(lc, 1) * lt), 1.0 + 1e-9)) / base)
    for n in order:
        n.sum = sum(k.density for k in n.children if not k.skip) or (n.density if not n.children else 0.0)
    return order


def select(root: Node, widen: bool = True) -> list[Node]:
    """The roots of the subtrees that hold the main text, in page order; ``widen`` extends them to an article element around them."""
    settle(root)
    order = [n for n in measure(root) if not n.skip]
    if not root.chars:
        return []
    best = max((n for n in order if n.tag in CONTAINERS), key=lambda n: n.sum)
    below: dict[int, Node] = {}
    for n in reversed(order):  # the node of the largest sum in every subtree, the outermost of equals
        own = n
        for k in n.children:
            if not k.skip and k.tag in CONTAINERS and below[id(k)].sum > own.sum:
                own = below[id(k)]
        below[id(n)] = own
    threshold, up = best.density, best
    while up is not None and up.tag not in ("html", "#root"):
        threshold, up = min(threshold, up.density), up.parent
    marked = {id(below[id(n)]) for n in order if n.density >= threshold and n.tag in CONTAINERS}
    if widen and best.article is not None:
        whole = best.article
        while whole.parent.article is not None:
            whole = whole.parent.article
        beside = [n for n in whole.parent.children if n is whole or n.tag == "article" and not n.skip and n.density >= COMPARABLE * whole.density]
        return _titled(beside)
    chosen, inside = [], set()
    for n in order:
        if n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
        elif id(n) in marked:
            inside.add(id(n))
            chosen.append(n)
    return _titled(chosen)


def _title(node: Node) -> bool:
    """Whether a node is or holds a heading of the first two ranks."""
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag in ("h1", "h2") and n.chars and not n.skip:
            return True
        stack.extend(n.children)
    return False


def _titled(chosen: list[Node]) -> list[Node]:
    """``chosen``, behind the title block that stands just before it if none of it has a title itself.

    That is the nearest text before it, which holds a heading, more text outside links than in them, and less text than the choice.
    """
    if not chosen or any(map(_title, chosen)):
        return chosen
    n = chosen[0]
    while n.parent is not None and n.tag != "body":
        before = [k for k in n.parent.children[: n.parent.children.index(n)] if not k.skip and k.chars]
        if before:
            k = before[-1]
            return [k, *chosen] if _title(k) and 2 * k.link_chars < k.chars <= sum(c.chars for c in chosen) else chosen
        n = n.parent
    return chosen


def blocks(node: Node) -> Iterator[str]:
    """The texts of the blocks below a node, in page order."""
    held: list[str] = []
    stack: list[tuple[Node, int]] = [(node, 0)]
    flush = lambda: _WHITE.sub(" ", unescape("".join(held))).strip()
    while stack:
        n, k = stack.pop()
        if k < len(n.parts):
            stack.append((n, k + 1))
            part = n.parts[k]
            if isinstance(part, str):
                held.append(part)
            elif not part.skip:
                if part.tag in BLOCK:
                    if out := flush():
                        yield out
                    held.clear()
                stack.append((part, 0))
        elif n.tag in BLOCK:
            if out := flush():
                yield out
            held.clear()
    if out := flush():
        yield out


def main_text(html: str | None, widen: bool = True) -> str:
    """The main text of one page."""
    if not html:
        return ""
    return "\n\n".join(text for node in select(parse(html), widen) for text in blocks(node))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) with the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(html) for html in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    columns = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return columns.mapInArrow(run, "page_id long, url string, text string")
