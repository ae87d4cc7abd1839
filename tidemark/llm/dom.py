"""Web pages as trees of blocks, and what is measured of each block.

A block is a block-level element, with its text if no other block is in it, or a run of text and inline
markup between block elements. Left out while parsing are scripts, styles, drawings, lists of choices and
what a page's head holds; all else is for the trees to judge. Open tags that HTML closes by itself
(paragraphs, list items, cells) are closed; stray end tags are ignored. The time to parse is in proportion
to the page, however its tags are nested.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SKIP = frozenset("head svg template select datalist".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header footer nav aside form fieldset legend details summary address center menu hgroup dialog ins".split()
)
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SCOPE = frozenset("table td th caption html".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
STOPS = re.compile(r"[.!?,;:。](?:\s|$)")

#: Words in class names and the like, by what they say of a block.
GROUPS = {
    "advert": "ad ads advert adverts advertisement adsense adsbygoogle sponsor sponsored promo promoted promotion banner dfp",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pager pagination paging skip links tags",
    "head": "header masthead topbar top logo branding brand site",
    "foot": "footer foot bottom copyright colophon legal credits",
    "side": "sidebar side aside widget related recommended recommendations more popular trending rail complementary",
    "reader": "comment comments commentlist reply replies respond discussion disqus feedback reviews",
    "notice": "notice cookie cookies consent gdpr alert warning message popup modal overlay paywall announcement",
    "form": "form search subscribe subscription newsletter signup login register share sharing social contact",
    "prose": "article content main post entry story body text prose page articlebody maincontent blog news",
}
GROUP_OF = {word: k for k, words in enumerate(GROUPS.values()) for word in words.split()}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "nav", "header", "footer", "aside", "form", "td", "blockquote", "pre", "figure", "#text")
TAG_OF = {t: k for k, t in enumerate(TAGS)} | {"ol": TAGS.index("ul"), "menu": TAGS.index("ul"), "h4": TAGS.index("h3"), "h5": TAGS.index("h3"), "h6": TAGS.index("h3"), "th": TAGS.index("td"), "fieldset": TAGS.index("form")}
N_FEATURES = 2 * len(TAGS) + 2 * len(GROUPS) + 15


class Block:
    __slots__ = ("tag", "attrs", "up", "kids", "text", "links")

    def __init__(self, tag: str, attrs: str, up: int, text: str = "", links: int = 0) -> None:
        self.tag, self.attrs, self.up, self.text, self.links, self.kids = tag, attrs, up, text, links, 0


class _Open:
    """The open elements: a stack, and by name the places of those not ended, so that none is searched for."""

    def __init__(self) -> None:
        self.stack: list[list] = [["#root", 0, True]]  # name, the block that its text belongs to, not ended yet
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def push(self, name: str, block: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append([name, block, True])

    def pop(self) -> str:
        """End the innermost; its name, or nothing if it had ended."""
        name, _, open_ = self.stack.pop()
        if not open_:
            return ""
        self.places[name].pop()
        if name in BLOCK:
            self.blocks.pop()
        return name

    def last(self, *names: str) -> int:
        """The place of the innermost of these names, 0 if none is open."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def end_inline(self, name: str) -> None:
        """End an element within the innermost block (links wherever they began), others inside it staying open."""
        k = self.last(name)
        if k and (k > self.blocks[-1] or name == "a"):
            self.places[name].pop()
            self.stack[k][2] = False


def blocks(html: str) -> list[Block]:
    """The blocks in page order, the root first; up is a block's place of its parent."""
    out = [Block("#root", "", -1)]
    open_ = _Open()
    stack, places = open_.stack, open_.places
    run: list[str] = []
    links = hidden = 0
    ignored: dict[str, int] = {}  # block elements begun where nothing is read

    def flush(leaf: bool = False) -> None:
        """End a run of text; leaf: its element ends too, and takes the text if it holds no other block."""
        nonlocal links
        if text := " ".join("".join(run).split()):
            up, many = stack[-1][1], min(links, len(text))
            if leaf and len(out) == up + 1:
                out[up].text, out[up].links = text, many
            else:
                out.append(Block("#text", "", up, text, many))
        run.clear()
        links = 0

    def pop_to(k: int) -> None:
        """End the elements from place k on."""
        nonlocal hidden
        while len(stack) > k:
            if stack[-1][0] in BLOCK:
                flush(leaf=True)
            hidden -= open_.pop() in SKIP
        if not hidden:
            ignored.clear()

    def begin(name: str, attrs: str) -> None:
        flush()
        out.append(Block(name, attrs, stack[-1][1]))
        open_.push(name, len(out) - 1)

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at and not hidden:
            run.append(text := unescape(html[at:end]))
            if places.get("a"):
                links += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if not m[1]:
            if name in RAW:
                close = _end_of(name).search(html, at)
                at = close.end() if close else n
            elif name in VOID:
                if name in ("br", "hr") and not hidden:
                    run.append(" ")
            elif name in SKIP:
                open_.push(name, stack[-1][1])
                hidden += 1
            elif hidden:
                if name == "body":  # a head that was never closed
                    pop_to(min(places[x][0] for x in SKIP if places.get(x)))
                    begin(name, m[3])
                elif name in BLOCK:
                    ignored[name] = ignored.get(name, 0) + 1
            elif name in BLOCK:
                k = open_.last("p")
                if k and k > open_.last(*SCOPE):
                    pop_to(k)
                if name in CLOSES:
                    these, within = CLOSES[name]
                    k = open_.last(*these)
                    if k and k > open_.last(*within):
                        pop_to(k)
                begin(name, m[3])
            else:
                open_.push(name, stack[-1][1])
        elif name in SKIP:
            if k := open_.last(name):
                pop_to(k)
        elif name in BLOCK:
            if ignored.get(name):
                ignored[name] -= 1
            elif k := open_.last(name):  # ends what is hidden inside it too
                pop_to(k)
        else:
            open_.end_inline(name)
    pop_to(1)
    flush()
    return out


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


@lru_cache(maxsize=8192)
def groups_of(attrs: str) -> tuple[int, ...]:
    words = (w.lower() for m in ATTRIBUTE.finditer(attrs) for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", m[1] or m[2] or m[3] or ""))
    return tuple({GROUP_OF[w] for w in words if w in GROUP_OF})


def features(page: list[Block]) -> np.ndarray:
    """A row for each block: tags and attribute words, of it and of those above it; sizes, densities, depth, siblings."""
    n, g, t = len(page), len(GROUPS), len(TAGS)
    x = np.zeros((n, N_FEATURES), np.float32)
    chars, words, links, stops, inner, paragraphs, heads = (np.zeros(n) for _ in range(7))
    depth, order, longest = np.zeros(n), np.zeros(n), np.zeros(n)
    before = np.zeros(n)
    total = 0
    for i, b in enumerate(page):
        before[i] = total
        total += len(b.text)
        if i:
            depth[i] = depth[b.up] + 1
            order[i] = page[b.up].kids
            page[b.up].kids += 1
        tag = TAG_OF.get(b.tag)
        if tag is not None:
            x[i, tag] = 1
        for k in groups_of(b.attrs) if b.attrs else ():
            x[i, 2 * t + k] = 1
        if i:
            up = x[b.up]
            x[i, t : 2 * t] = np.maximum(up[:t], up[t : 2 * t])
            x[i, 2 * t + g : 2 * t + 2 * g] = np.maximum(up[2 * t : 2 * t + g], up[2 * t + g : 2 * t + 2 * g])
        chars[i], links[i] = len(b.text), b.links
        longest[i] = len(b.text)
        if b.text:
            words[i], stops[i] = b.text.count(" ") + 1, len(STOPS.findall(b.text))
        paragraphs[i], heads[i] = b.tag in ("p", "#text"), b.tag in ("h1", "h2")
    for i in range(n - 1, 0, -1):
        up = page[i].up
        inner[up] += inner[i] + 1
        for a in (chars, words, links, stops, paragraphs, heads):
            a[up] += a[i]
        longest[up] = max(longest[up], longest[i])
    ups = np.array([max(b.up, 0) for b in page])
    kids = np.array([b.kids for b in page])
    some, own = np.maximum(chars, 1), 2 * t + 2 * g
    x[:, own:] = np.stack([
        np.log1p(chars), np.log1p(words), links / some, stops / np.maximum(words, 1), inner / some * 100, depth, order,
        kids[ups], kids, chars / max(total, 1), before / max(total, 1), chars / np.maximum(chars[ups], 1), np.log1p(paragraphs), np.minimum(heads, 3), np.log1p(longest),
    ], 1)
    return x
