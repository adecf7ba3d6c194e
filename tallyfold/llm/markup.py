"""HTML as a tidy tree of block elements and text.

Inline markup leaves no trace but the text and how much of it is linked; scripts,
styles, comments and other content that is never shown is skipped; end tags that
authors leave out are implied. Elements carry a signature: the tag, and the words of
class, id and role.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: What elements deeper than this hold belongs to the one above; an end tag is matched within so many open elements.
DEEPEST, OPEN_ELEMENTS = 48, 512
#: Words of a signature.
SIGNATURE_WORDS = 6

_NAME = r"[a-zA-Z][^\s/>]*"
_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*"[^"]{0,65536}"|=\s*'[^']{0,65536}'|[="'])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({_NAME})({_ATTRIBUTES})>|<[!?/][^>]*>", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|itemprop|style|aria-hidden|hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

SKIPPED = frozenset("script style noscript template iframe noembed noframes textarea title svg math object canvas audio video select datalist head".split())
_SKIP_TO = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in SKIPPED} | {"head": re.compile(r"</head(?=[\s/>])[^>]*>|(?=<body[\s/>])", re.I)}
#: These swallow the rest of a page that doesn't end them.
RAW = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What an opening tag ends, and within which element.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split()
)
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
ENDS |= {"tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


@dataclass(slots=True)
class Element:
    signature: str
    kids: list = field(default_factory=list)


@dataclass(slots=True)
class Text:
    """Text between two block boundaries; ``linked`` of its characters are inside links."""

    text: str
    linked: int


def signature(tag: str, attributes: str) -> str:
    """The tag and the words of class, id and role, without digits; ``hidden`` for what is not shown."""
    if not attributes or attributes.isspace():
        return tag
    words: list[str] = []
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
            words.append("hidden")
        elif name in ("class", "id", "role") or name == "itemprop" and value.lower() == "articlebody":
            words += [w.lower() for w in _WORD.findall(value)]
    return ".".join([tag, *list(dict.fromkeys(words))[:SIGNATURE_WORDS]])


def parse(html: str | None, is_noise) -> list:
    """Elements and texts of a page; inline elements whose signature ``is_noise`` are skipped with all they hold."""
    root = Element("#page")
    tags, holders, pieces = ["#page"], [root], []
    linked = link_depth = 0
    skipping, skipped_same, skipped_blocks = "", 0, 0  # an inline element that is noise, and what is open inside it
    source = html or ""

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            holders[-1].kids.append(Text(text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not skipping:
            text = unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if link_depth:
                linked += len(text.strip())

    def close(names, within=()) -> None:
        """Ends the innermost open element of ``names``, unless one of ``within`` lies between."""
        nonlocal link_depth
        for depth in range(len(tags) - 1, max(0, len(tags) - OPEN_ELEMENTS), -1):
            if tags[depth] in names:
                flush()
                del tags[depth:], holders[depth:]
                link_depth = link_depth if link_depth <= len(tags) else 0
                return
            if tags[depth] in within:
                return

    at = 0
    while found := _TOKEN.search(source, at):
        say(source[at : found.start()])
        at, tag = found.end(), (found[2] or "").lower()
        if not tag:
            continue
        inline = tag in INLINE or tag in VOID
        if found[1]:
            if skipping and not inline and skipped_blocks:
                skipped_blocks -= 1
            elif tag == skipping:
                skipped_same -= 1
                skipping = skipping if skipped_same else ""
            elif tag == "a":
                link_depth = 0
            elif not inline:
                skipping = ""  # the block around the inline element ends, and it with it
                close({tag}, () if tag in ("body", "html", "table") else ("table",))
        elif tag in SKIPPED:
            if end := _SKIP_TO[tag].search(source, at):
                at = end.end()
            elif tag in RAW:
                at = len(source)
        elif skipping:
            skipped_same += tag == skipping
            skipped_blocks += not inline
        elif tag == "br":
            say(" ")
        elif tag in INLINE:
            if tag not in VOID and is_noise(signature(tag, found[3])):
                skipping, skipped_same, skipped_blocks = tag, 1, 0
            elif tag == "a":
                link_depth = len(tags)
        else:
            if tag in ENDS_P:
                close({"p"}, {"td", "th", "table", "button"})
            if tag in ENDS:
                close(*ENDS[tag])
            flush()
            if tag not in VOID and tag not in ("html", "body"):
                tags.append(tag)
                if len(tags) <= DEEPEST:
                    made = Element(signature(tag, found[3]))
                    holders[-1].kids.append(made)
                    holders.append(made)
                else:
                    holders.append(holders[-1])
    say(source[at:])
    flush()
    return root.kids
