"""Leaf blocks of an HTML page: the texts between block-level tags, in page order, with the path of their elements.

A small reader for pages as they are: unknown and stray tags, unclosed elements, cut-off pages. Text of scripts,
styles and of other elements that show no text of the page is left out.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Elements inside a line of text, elements without content, elements whose content is not text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video select datalist title head noframes noembed textarea".split())
#: Elements whose content ends only at their own end tag, whatever it looks like.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Which open elements a start tag closes, and the elements beyond which it closes nothing.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = frozenset("ul ol dl table article section div main nav aside body html td th form blockquote".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

# a quoted value may hold ">", up to a length; a tag whose quotes do not end is read up to its first ">"
QUOTED = r"(?:[^>\"']++|\"[^\"]{0,4096}\"|'[^']{0,4096}')*+"
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)(?:({QUOTED})>|([^>]*)>)|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


class Element(NamedTuple):
    tag: str
    names: str  # class and id, as written
    role: str
    main: str  # the annotation of labelled pages


class Block(NamedTuple):
    text: str  # character references decoded, white space as one space, trimmed
    path: tuple[Element, ...]  # open block-level elements, outermost first
    linked: int  # characters of links in it


def _attributes(text: str, annotation: str) -> tuple[str, str, str]:
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(text)} if "=" in text else {}
    return f"{found.get('class', '')} {found.get('id', '')}".strip(), found.get("role", ""), found.get(annotation, "")


def blocks(page: str, annotation: str = "data-main") -> list[Block]:
    """The blocks of a page that have text."""
    out: list[Block] = []
    path: list[Element] = []
    silent: list[str] = []  # open elements without text
    pieces: list[str] = []
    linked, links, at, size = 0, 0, 0, len(page)

    def add(text: str) -> None:
        nonlocal linked
        if not silent and text:
            pieces.append(text)
            if links:
                linked += len(text)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, tuple(path), linked))
            pieces.clear()
        linked = 0

    def close(tags: tuple[str, ...] | frozenset[str], stop: frozenset[str]) -> None:
        """Closes the innermost of tags that stands inside no element of stop, and all in it."""
        for k in range(len(path) - 1, -1, -1):
            if path[k].tag in tags:
                del path[k:]
                return
            if path[k].tag in stop:
                return

    while at < size:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name, given, end = (m[1] or "").lower(), m[2] if m[2] is not None else m[3], (m[4] or "").lower()
        if name:
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if name not in SILENT:
                    add(page[at : stop.start() if stop else size])
                at = stop.end() if stop else size
                continue
            if name in SILENT:
                if name == "head" or not given.endswith("/"):
                    silent.append(name)
                continue
            if name == "body" or silent == ["head"] and name not in VOID:  # a head ends where the body begins
                silent.clear()
            if name in INLINE:
                if name == "br":
                    add(" ")
                elif name == "a":
                    links = 1
                continue
            flush()
            if name in ENDS_P:
                close(("p",), SCOPE)
            if name in CLOSES:
                close(CLOSES[name], SCOPE - frozenset(CLOSES[name]))
            links = 0
            if name not in VOID:
                path.append(Element(name, *_attributes(given, annotation)))
        elif end:
            if end in SILENT:
                if end in silent:
                    del silent[silent.index(end) :]
            elif end == "a":
                links = 0
            elif end not in INLINE and any(e.tag == end for e in path):
                flush()
                close((end,), frozenset())
    flush()
    return out
