"""HTML pages as sequences of leaf blocks: tag path, text, link share."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Tags that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open one of these (up to the nearest container of the second set).
CLOSES = {
    "p": ({"p"}, {"article", "div", "section", "td", "li", "body", "aside", "main", "form", "footer", "header", "nav", "blockquote"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: These also end an open paragraph.
ENDS_P = frozenset("article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    """The tag and the word parts of its class, id, role and itemprop."""
    if not attrs or "=" not in attrs:
        return (tag,)
    parts = [tag]
    for _, value in _ATTR.findall(attrs):
        parts += ["." + x for x in _PART.findall(_CAMEL.sub("-", value).lower())]
    return tuple(parts)


def _close(stack: list, names: set[str], stop: set[str]) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in names:
            del stack[i:]
            return
        if stack[i][0] in stop:
            return


def blocks(page: str) -> list[Block]:
    """All leaf blocks with text, in page order.

    White space is one space, character references are decoded.  Comments and
    the content of scripts, styles and embedded objects are not text.
    """
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    text: list[str] = []
    links: list[str] = []
    anchors = 0

    def flush(path: list) -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                inside = sum(len(x.strip()) for x in links)
                out.append(Block(tuple(x for names in path for x in names), joined, min(1.0, inside / len(joined))))
            text.clear()
        links.clear()

    for m in _TOKEN.finditer(page):
        tag = m["tag"]
        if tag is None:
            piece = m[0]
            if m["raw"] or (piece[0] == "<" and len(piece) > 1):
                if m["raw"]:
                    text.append(" ")
                continue
            text.append(piece)
            if anchors:
                links.append(piece)
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in BLOCK:
                flush(stack)
            elif tag == "a":
                anchors = max(0, anchors - 1)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush(stack)
            anchors = 0
            if tag in CLOSES:
                _close(stack, *CLOSES[tag])
            if tag in ENDS_P:
                _close(stack, {"p"}, CLOSES["p"][1])
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        stack.append(_names(tag, m["attrs"]))
        if tag == "a":
            anchors += 1
    flush(stack)
    return out
