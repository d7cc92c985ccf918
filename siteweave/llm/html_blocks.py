"""Blocks of a web page, from one linear scan of its markup."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import xxhash

# How elements of HTML behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas".split())
#: Elements of RAW whose content is text up to their own end tag or the end of the page.
RAW_TEXT = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav header footer aside menu dialog button select fieldset head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
#: Elements that end an open one of the same kind or of these kinds.
ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HOLDERS = frozenset("ul ol dl table div article section main body".split())

# Names that pages give to what is no article, alone or with these words before and after.
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promos promotion banner nav navbar navigation navigator menu menus "
    "breadcrumb breadcrumbs header masthead footer sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist disqus reply replies respond related recommend recommended recommendations share sharing social toolbar pagination pager copyright skiplink".split()
)
BEFORE = frozenset("site page main top bottom left right global post article entry primary secondary blog web user reader inline text display google header footer cookie ad nav sub mobile social share skip".split())
AFTER = frozenset("area list section wrap wrapper container box bar inner outer block left right top bottom form links link menu item items content body thread notice banner slot unit space row column col group buttons button policy consent icons panel text nav primary secondary".split())

#: Levels of open elements; deeper ones count as lying in the last.
DEEPEST = 512

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


def tidy(text: str) -> str:
    return " ".join(unescape(text).split())


def hashed(*x: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(x).encode("utf-8", "replace")) - (1 << 63)


def odd(value: str) -> bool:
    """Whether a class, id or role names something that is no article: a name of NAMES, with words of BEFORE and AFTER around it.

    So site-header, ad_box and commentList are such names; has-sidebar, header-image and comments-open are not.
    """
    for name in value.split():
        parts = [p.lower() for p in _PARTS.split(_DIGITS.sub("", name)) if p]
        for i, p in enumerate(parts):
            if p in NAMES and all(x in BEFORE or x in NAMES for x in parts[:i]) and all(x in AFTER or x in NAMES for x in parts[i + 1 :]):
                return True
    return False


@dataclass
class Page:
    """Elements by number (parents come before their children; 0 is the root) and blocks in page order.

    outside: the element's kind is no article. named: its class, id or role says so.
    A block is (element, its text, the share of it that is link text).
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])
    label: list[str] = field(default_factory=lambda: [""])
    outside: list[bool] = field(default_factory=lambda: [False])
    named: list[bool] = field(default_factory=lambda: [False])
    role: list[str] = field(default_factory=lambda: [""])
    blocks: list[tuple[int, str, float]] = field(default_factory=list)


def parse(html: str) -> Page:
    """One pass over the markup; unclosed comments, quotes and elements end with the page or with what encloses them."""
    page = Page()
    stack: list[tuple[str, int, bool, bool]] = []  # element, number (inline: -1), link, advert in a line
    parts: list[str] = []
    links = adverts = link_size = at = 0
    node = 0
    missing: set[str] = set()  # strings known not to follow any more

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        k = html.find(what, start)
        if k < 0:
            missing.add(what)
        return k

    def tag_end(start: int) -> int:
        while m := _STOP.search(html, start):
            if m[1] is None:
                return m.end()
            k = find(m[1], m.end())
            if k < 0:
                k = html.find(">", m.end())
                return k + 1 if k >= 0 else len(html)
            start = k + 1
        return len(html)

    def block():
        nonlocal link_size
        if parts:
            text = tidy("".join(parts))
            if text:
                page.blocks.append((node, text, link_size / len(text)))
            parts.clear()
        link_size = 0

    def cut(k: int):
        nonlocal links, adverts, node
        for name, number, link, advert in stack[k:]:
            links -= link
            adverts -= advert
        del stack[k:]
        node = next((n for _, n, _, _ in reversed(stack) if n >= 0), 0)

    def close_inline(name: str):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][1] >= 0:
                return
            if stack[k][0] == name:
                cut(k)
                return

    def close(name: str):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                cut(k)
                return
            if stack[k][0] in MAIN and name in ENDS:
                return

    def close_open(name: str, until: frozenset):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                cut(k)
                return
            if stack[k][1] >= 0 and stack[k][0] in until:
                return

    def text(start: int, end: int):
        nonlocal link_size
        if start < end and not adverts:
            piece = html[start:end]
            parts.append(piece)
            if links:
                link_size += len(piece)

    while m := _OPEN.search(html, at):
        text(at, m.start())
        at = m.end()
        if m[1]:
            k = find("-->", max(m.end() - 2, 0))
            at = k + 3 if k >= 0 else len(html)
            continue
        if m[2]:
            k = find(">", at)
            at = k + 1 if k >= 0 else len(html)
            continue
        name, closing = m[4].lower(), bool(m[3])
        start, at = at, tag_end(at)
        attributes = html[start:at]
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if not closing and "=" in attributes else {}
        if name in INLINE:
            if name in ("br", "img"):
                parts.append(" ")
            elif closing:
                close_inline(name)
            elif name != "wbr" and len(stack) < DEEPEST:
                advert = any(odd(v) for v in found.values())
                stack.append((name, -1, name == "a", advert))
                links += name == "a"
                adverts += advert
            continue
        block()
        if closing:
            close(name)
            continue
        if name in CLOSE_P:
            close_open("p", HOLDERS)
        for other in ENDS.get(name, ()):
            close_open(other, HOLDERS)
        if name in VOID:
            continue
        if name in RAW:
            if not attributes.rstrip("> ").endswith("/") and "</" + name not in missing:
                if end := re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at):
                    at = end.end()
                else:
                    missing.add("</" + name)
                    if name in RAW_TEXT:
                        at = len(html)
            continue
        if name in ("html", "body"):
            cut(0)
        if len(stack) >= DEEPEST:
            continue
        role = "article" if name == "article" else "main" if name == "main" or found.get("role", "").lower() == "main" else ""
        label = name + "".join(f"[{k}={_DIGITS.sub('', v)}]" for k, v in found.items())
        outside = name in OUTSIDE and not (name == "header" and any(page.role[n] for _, n, _, _ in stack if n >= 0))
        named = name == "form" or role != "main" and name not in ("html", "body") and any(odd(v) for v in found.values())
        page.parent.append(node)
        page.tag.append(name)
        page.label.append(label)
        page.path.append(hashed(str(page.path[node]), label))
        page.outside.append(outside)
        page.named.append(named)
        page.role.append(role)
        node = len(page.parent) - 1
        stack.append((name, node, False, False))
    text(at, len(html))
    block()
    return page


@dataclass
class Block:
    """A block with what is known of its place: path (a hash of the elements around it), whether the main content or something else encloses it."""

    path: int
    text: str
    main: bool
    outside: bool
    links: bool


def blocks(html: str) -> list[Block]:
    """The blocks of a page. Names say nothing of elements around the main content (see around_content)."""
    page = parse(html)
    ignored = around_content(page)
    n = len(page.parent)
    outside, main = [False] * n, [False] * n
    for i in range(1, n):
        up = page.parent[i]
        outside[i] = outside[up] or page.outside[i] or page.named[i] and i not in ignored
        main[i] = main[up] or bool(page.role[i])
    return [Block(page.path[i], text, main[i], outside[i], links >= 0.8 and page.tag[i] != "p" and page.tag[i] not in HEADINGS) for i, text, links in page.blocks]


def around_content(page: Page) -> set[int]:
    """The elements whose name says nothing, as they enclose the main content.

    That is the main element, or else the article, that holds the most text; articles labelled as
    the longest one count with it, others (a comment, say) by their names. On a page with neither,
    an element counts as enclosing it if it holds the page's heading and more than half of the text,
    or, without a heading, all the text that no element's kind puts outside.
    """
    n = len(page.parent)
    out = [False] * n
    for i in range(1, n):
        out[i] = out[page.parent[i]] or page.outside[i]
    held, headed = [0] * n, [0] * n
    for i, text, _ in page.blocks:
        if not out[i]:
            held[i] += len(text)
            headed[i] += page.tag[i] == "h1"
    for i in range(n - 1, 0, -1):
        held[page.parent[i]] += held[i]
        headed[page.parent[i]] += headed[i]
    above = lambda i: _ancestors(page.parent, i)
    mains = [i for i in range(1, n) if page.role[i] and held[i]]
    if mains:
        content = max(mains, key=lambda i: (page.role[i] == "main", held[i], -i))
        longest = max((i for i in mains if page.role[i] == "article"), key=lambda i: (held[i], -i), default=None)
        alike = {i for i in mains if longest is not None and page.role[i] == "article" and page.label[i] == page.label[longest]}
        return alike | set(above(content))
    if headed[0]:
        return {i for i in range(1, n) if headed[i] and 2 * held[i] > held[0]}
    return {i for i in range(1, n) if held[i] == held[0]}


def _ancestors(parent: list[int], i: int):
    while (i := parent[i]) > 0:
        yield i
