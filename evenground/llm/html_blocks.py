"""HTML pages as trees of block elements with the text blocks between them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Inline elements whose end tag closes them across block elements, too.
FORMATTING = frozenset("a b big code em font i s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "thead tr td th", "tfoot": "tbody tr td th"}
#: As in browsers' parsers: elements nested deeper hang side by side under the last one, each with the keys of the deeper ones that hold it.
MAX_DEPTH = 512
_BARRIERS = frozenset("ul ol dl table article section div main body html menu select".split())


@dataclass
class Block:
    """A text block: its text (white space made single, trimmed), and how many of its code points stand in links."""

    text: str
    linked: int


@dataclass
class Element:
    key: str  # name, then class, id (with @ before) and role words
    children: list[Element | Block] = field(default_factory=list)


@dataclass
class _Open:
    """An open element; a hidden inline one keeps the text that it interrupts. While one is open, open inline elements are counted."""

    name: str
    element: Element
    interrupted: tuple[list[str], int] | None = None
    inline: dict[str, int] = field(default_factory=dict)


def _key(name: str, attributes: str) -> str:
    words = []
    for attribute, value in _ATTRIBUTE.findall(attributes):
        attribute, value = attribute.lower(), html.unescape(value.strip("\"'"))
        if attribute in ("class", "id", "role", "itemprop"):
            value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
            if attribute == "id":  # numbers in ids, and long ones in classes, count the page, not the template
                words += ["@" + w for w in re.findall(r"[a-z]+(?:[-_][a-z]+)*", value)]
            else:
                words += re.findall(r"[a-z]+[0-9]*(?:[-_]+[a-z0-9]+)*", re.sub(r"[-_]?[0-9]{3,}", "", value))
        elif attribute == "hidden" or attribute == "aria-hidden" and value == "true" or attribute == "style" and re.search(r"display\s*:\s*none", value):
            words.append("hidden")
    return ".".join([name, *dict.fromkeys(words)])


def _hides(key: str) -> bool:
    """Whether a class, id or role word says hidden."""
    return any("hidden" in re.split("[-_]", word) for word in key.replace("@", "").split(".")[1:])


def parse_page(page: str) -> Element:
    """The tree of a page's block elements. Inline elements are transparent but for hidden ones, which are elements beside the text that they stand in; scripts, styles, comments and other raw text are left
    out; missing end tags are supplied where the next tag implies them; stray end tags are ignored."""
    root = Element("html")
    stack, parts, linked, links, hiding = [_Open("html", root)], [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text := " ".join("".join(parts).split()):
            stack[-1].element.children.append(Block(text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def close(height: int) -> None:
        nonlocal linked, hiding
        while len(stack) > height:
            flush()
            if (kept := stack.pop().interrupted) is not None:
                parts[:], linked = kept
                hiding -= 1

    def end_inline(name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            entry = stack[i]
            if entry.inline.get(name):
                entry.inline[name] -= 1
                return
            if entry.interrupted is not None and entry.name == name:
                close(i)
                return
            if entry.interrupted is None and name not in FORMATTING:
                return

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if links:
                linked += len(text.strip())

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if found is None:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        ending, attributes = found[1] or found[4], found[3] or found[6] or ""
        hidden = name in INLINE and not ending and name not in VOID and not attributes.rstrip().endswith("/") and _hides(_key(name, attributes))
        if name in INLINE and not hidden:
            if hiding and ending:
                end_inline(name)
            elif hiding and name not in VOID:
                stack[-1].inline[name] = stack[-1].inline.get(name, 0) + 1
            if name == "a":
                links = 0 if ending else 1
            elif name == "br":
                parts.append(" ")
            continue
        if hidden:
            kept = (parts[:], linked)
            parts.clear()
            linked = 0
        else:
            flush()
        if ending:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
            links = 0
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or name in ("html", "body", "head"):
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in _BARRIERS or stack[i].name in ("td", "th", "li"):
                    break
        if name in CLOSES:
            closed = CLOSES[name].split()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in closed:
                    close(i)
                elif stack[i].name in _BARRIERS:
                    break
        element = Element(_key(name, attributes))
        if len(stack) > MAX_DEPTH:
            if len(stack) > MAX_DEPTH + 1:
                element.key = ".".join(dict.fromkeys(f"{stack[-1].element.key}.{element.key}".split(".")))
            stack[MAX_DEPTH].element.children.append(element)
        else:
            stack[-1].element.children.append(element)
        if hidden:
            stack.append(_Open(name, element, kept))
            hiding += 1
        elif not attributes.rstrip().endswith("/") or name in CLOSES_P:
            stack.append(_Open(name, element))
    close(1)
    flush()
    return root
