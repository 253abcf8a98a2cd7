"""HTML to text blocks, in one pass over the markup with a regular expression."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<(?P<cut>/?[a-zA-Z][^>]*)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Elements whose contents are not text of the page.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "button", "head", "title", "canvas", "audio", "video", "map", "datalist"}
#: Of those, the ones in which < does not begin a tag.
RAW = {"script", "style", "textarea", "title", "iframe"}
#: Of those, the ones that go on to the end of the page where they have no end tag; of others, only the tag is skipped then.
ENDLESS = {"script", "style"}
#: Elements that can be in a head.
IN_HEAD = {"title", "meta", "link", "base", "basefont", "bgsound", "script", "style", "noscript", "noframes", "template", "head", "html"}
CONTAINERS = set("html body article main section nav aside header footer div form ul ol dl menu table thead tbody tfoot tr figure fieldset details dialog blockquote address center hgroup search".split())
#: Elements that begin and end blocks besides containers.
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre caption figcaption legend summary hr option".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What follows one of these in a class or id is something that the element has or lacks, not what it is.
QUALIFIERS = {"has", "have", "no", "not", "with", "without", "hide", "show"}
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")


@dataclass(slots=True)
class Container:
    name: str
    marks: frozenset[str]
    parent: int
    hidden: bool = False


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    box: int  # its container
    linked: int  # characters within links


@dataclass(slots=True)
class Page:
    boxes: list[Container] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _marks(rest: str) -> tuple[frozenset[str], bool]:
    marks, hidden = [], False
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop"):
            for one in value.split():
                words = [x.lower() for x in CAMEL.split(one) if x]
                marks += words[: next((k for k, x in enumerate(words) if x in QUALIFIERS), None)]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return frozenset(marks), hidden


def parse(source: str) -> Page:
    """Blocks of text in page order, each with its innermost container; unclosed and stray tags are tolerated."""
    page = Page([Container("", frozenset(), -1)])
    boxes, stack, at, parts, tag, links, linked, marked = page.boxes, [0], 0, [], "", 0, 0, False

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            page.blocks.append(Block(text, tag, stack[-1], linked))
        parts.clear()
        linked = 0

    def leave() -> None:
        """End the block, and the box of a marked leaf if one is open."""
        nonlocal marked
        end()
        if marked:
            stack.pop()
            marked = False

    def say(chunk: str) -> None:
        nonlocal linked
        if chunk:
            chunk = html.unescape(chunk) if "&" in chunk else chunk
            parts.append(chunk)
            if links:
                linked += len(chunk.strip())

    size = len(source)
    ends: dict[str, dict[int, int]] = {}
    open_head = False
    while at < size:
        to = source.find("<", at)
        if to < 0:
            say(source[at:])
            break
        say(source[at:to])
        m = TOKEN.match(source, to)
        if not m:
            say("<")
            at = to + 1
            continue
        at = m.end()
        if m[0].startswith("<![CDATA["):
            say(m[0][9:].removesuffix("]]>"))
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if marked and (name in CONTAINERS or name in LEAVES):
                leave()
                tag = ""
            if name in CONTAINERS:
                depth = next((k for k in range(len(stack) - 1, 0, -1) if boxes[stack[k]].name == name), 0)
                if depth:
                    end()
                    tag = ""
                    links = 0
                    del stack[depth:]
            elif name in LEAVES:
                end()
                tag = ""
            elif name == "a":
                links = 0
        elif name in SILENT:
            if m["rest"].endswith("/") and name == "svg":
                continue
            if name not in ("button", "select", "textarea", "option"):
                parts.append(" ")
            if name == "head":
                at, open_head = _head_end(source, at, open_head, ends)
            else:
                at = _silent_end(source, name, at, ends)
        elif name in CONTAINERS:
            leave()
            tag = ""
            links = 0
            marks, hidden = _marks(m["rest"]) if m["rest"] else (frozenset(), False)
            boxes.append(Container(name, marks, stack[-1], hidden or boxes[stack[-1]].hidden))
            stack.append(len(boxes) - 1)
        elif name in LEAVES:
            leave()
            tag = name
            marks, hidden = _marks(m["rest"]) if m["rest"] else (frozenset(), False)
            if marks or hidden:  # a marked leaf is a box of its own until the next container or leaf
                boxes.append(Container(name, marks, stack[-1], hidden or boxes[stack[-1]].hidden))
                stack.append(len(boxes) - 1)
                marked = True
        elif name == "br" or name == "img":
            parts.append(" ")
        elif name == "a":
            links = 1
    end()
    return page


def _silent_end(source: str, name: str, at: int, ends: dict[str, dict[int, int]]) -> int:
    """Where an element whose start tag ends at `at` has its end; `at` itself if it has no end tag.

    ends keeps the ends of all elements of a name, so that the page is searched once for each name.
    """
    if name not in ends:
        found = ends[name] = {}
        begun: list[int] = []
        for m in re.compile(rf"<(/?){name}(?=[\s/>])(?:((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|[^>]*(?:>|\Z))", re.I).finditer(source):
            if m[2] is None:  # cut within a quote, so TOKEN sees no name
                continue
            if m[1]:
                if begun and name in RAW and name != "iframe":  # the first begins it, what looks like more of them is its text
                    found.update(dict.fromkeys(begun, m.end()))
                    begun.clear()
                elif begun:
                    found[begun.pop()] = m.end()
            elif not (m[2].endswith("/") and name in ("svg", "math")):
                begun.append(m.end())
    return ends[name].get(at, len(source) if name in ENDLESS else at)


def _head_end(source: str, at: int, early: bool, ends: dict[str, dict[int, int]]) -> tuple[int, bool]:
    """Where a head ends: after its end tag, before the body, or else before the first thing that cannot be in a head.

    Also whether neither tag follows; with early that is known, and the search ends at the first such thing.
    """
    first, size = None, len(source)
    while at < size and not (early and first is not None):
        to = source.find("<", at)
        if first is None and source[at : to if to >= 0 else size].strip():
            first = at
        if to < 0:
            break
        m = TOKEN.match(source, to)
        at = m.end() if m else to + 1
        name = (m["name"] or "").lower() if m else ""
        if m and name == "head" and m["close"]:
            return at, False
        if name == "body" and not m["close"]:
            return to, False
        if first is None and (not m or name and name not in IN_HEAD and not m["close"]):
            first = to
        if name in SILENT and name != "head" and not m["close"]:
            at = _silent_end(source, name, at, ends)
    return size if first is None else first, True
