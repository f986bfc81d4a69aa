"""HTML to leaf blocks: pieces of text between block borders, each with what its ancestors say about it."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea title svg iframe select option head".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template".split())  # do not end an open head
RAW = frozenset("script style textarea title iframe noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr img nobr ruby rt rp".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)
SELF_CLOSING = {  # an opening tag ends an open element of these names, up to the nearest of the second
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
PLAIN = frozenset("html body div span p br b i".split())  # say nothing about what is inside

_TOKEN = re.compile(
    r"<!--(?:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PART = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    above: tuple[str, ...]  # features of all ancestors, from the outermost
    tag: str  # the nearest element that isn't inline
    linked: int  # characters inside links


def _marks(tag: str, attrs: str) -> tuple[str, ...]:
    """What an element says: its name, and the words of class, id and role."""
    out = [] if tag in PLAIN else [f"in={tag}"]
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "aria-label"):
            out += [f"has={w}" for w in dict.fromkeys(_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))]
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            out.append("hidden")
    if re.search(r"(^|\s)hidden(\s|$)", attrs):
        out.append("hidden")
    return tuple(out)


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in order, character references decoded and white space made single.

    An inline element and a single line break stay inside their block; two line breaks in a row end it.  Scripts,
    styles, comments and other elements without running text give nothing.  A head that is left open ends at the first
    text or tag that cannot stand in it.  A tag that the end of the page cuts off is
    dropped.
    """
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # (name, features of it and of all above)
    pieces: list[tuple[str, bool]] = []
    silent = links = breaks = 0

    def flush() -> None:
        nonlocal breaks
        breaks = 0
        if pieces:
            text = " ".join(unescape("".join(t for t, _ in pieces)).split())
            if text:
                linked = sum(len(" ".join(unescape(t).split())) for t, in_link in pieces if in_link)
                tag = next((n for n, _ in reversed(stack) if n not in INLINE), "")
                out.append(Block(text, stack[-1][1] if stack else (), tag, linked))
            pieces.clear()

    def close_to(depth: int) -> None:
        nonlocal silent, links
        for name, _ in stack[depth:]:
            silent -= name in SILENT
            links -= name == "a"
        del stack[depth:]

    def opened(names: tuple[str, ...], within: tuple[str, ...]) -> int | None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in within:
                return None
        return None

    def leave_head() -> None:
        if (i := opened(("head",), ())) is not None:
            close_to(i)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if stack and stack[-1][0] == "head" and html[at : m.start() if m else n].strip():
            leave_head()
        if m is None:
            if not silent:
                pieces.append((html[at:], links > 0))
            break
        if m.start() > at and not silent:
            text = html[at : m.start()]
            if text.strip():
                breaks = 0
            pieces.append((text, links > 0))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name or not html[at - 1] == ">":
            continue
        if m[1] or m[4]:  # an end tag
            if name not in INLINE:
                flush()
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if i is not None:
                close_to(i)
            continue
        attrs = m[3] if m[3] is not None else m[6] or ""
        if name not in IN_HEAD:
            leave_head()
        if name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            elif not silent:
                pieces.append((" ", False))
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P and (i := opened(("p",), ("td", "th", "button", "object", "table"))) is not None:
                close_to(i)
            if name in SELF_CLOSING and (i := opened(*SELF_CLOSING[name])) is not None:
                close_to(i)
        elif name == "a" and (i := opened(("a",), ("td", "th", "table"))) is not None:
            close_to(i)
        if attrs.endswith("/") and name in ("svg", "math", "path"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            at = n if end is None else (html.find(">", end.start()) + 1 or n)
            continue
        stack.append((name, (stack[-1][1] if stack else ()) + _marks(name, attrs)))
        silent += name in SILENT
        links += name == "a"
    flush()
    return out


def text_features(b: Block) -> list[str]:
    """Shape of a block's text, in coarse steps."""
    text, n = b.text, len(b.text)
    words = text.count(" ") + 1
    share = b.linked / n
    last = text[-1]
    letters = sum(map(str.isalpha, text))
    out = [
        f"tag={b.tag}" if b.tag not in ("div", "body", "html") else "tag=",
        f"words={min(words, 100).bit_length()}",
        f"link={0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.9 else 3}",
        f"end={'stop' if last in '.!?…。\"”»' else 'colon' if last in ':;,' else 'none'}",
        f"stops={min(3, len(re.findall(r'[.!?] ', text)))}",
    ]
    if "©" in text or "(c)" in text.lower():
        out.append("copyright")
    if text.count("|") + text.count("·") + text.count("»") + text.count("›") >= 1 and words < 40:
        out.append("separators")
    if letters * 2 < n:
        out.append("few-letters")
    if re.match(r"(?i)(home|menu|search|login|log in|sign (in|up)|subscribe|share|tweet|reply|read more|next|previous|advert|sponsored|cookies?)\b", text):
        out.append("command")
    return out
