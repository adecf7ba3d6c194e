"""Main text of web pages by union-free wrappers of their hosts.

The pages of a host are aligned one after the other into one regular expression
without alternatives: equal tokens stay, text that differs becomes a slot, runs of
like elements become repeated groups, and what only some pages have is optional. A
level of a page that no short sequence describes becomes a repeated group of optional
parts, so that an expression stays small whatever the pages hold. Wrappers align with
wrappers as pages do: each task makes one for every host it reads, and these are
merged in two rounds, so that no task gets the pages of a host together.

Each slot counts text and links over all pages of the host, and the host decides once
which slots are main text. A page is then read through its host's wrapper.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from ..scratch import Scratch
from .markup import Element, Text, parse

#: Parts of one level before it is put as a repeated group of optional ones.
LEVEL_PARTS = 24
#: Longest repeated group looked for in a sequence of parts.
LONGEST_PERIOD = 6
#: Distinct pages that must agree on a text, all of the host's, before it counts as part of the template.
TEMPLATE_PAGES = 5
#: Hosts a task holds wrappers of before it hands them on.
HOSTS_HELD = 2000
#: Groups that a host's partial wrappers are merged in first.
MERGE_GROUPS = 64
#: Bytes of wrappers that are broadcast; beyond, pages and wrappers are joined by host.
BROADCAST_BYTES = 8 << 20

# Tags and words of class, id and role that mark what is not main text, and what is.
NOISE_TAGS = frozenset("nav footer aside form button menu dialog fieldset search".split())
NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu
    breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay
    newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond disqus
    replies widget widgets toolbar pagination pager search copyright legal hidden complementary contentinfo skip notification notifications disclaimer
    announcement paywall adslot adbox adsense sidemenu topnav sitenav mainnav discussion responses""".split()
)
MAIN_WORDS = frozenset("article articlebody content main post entry story".split())
NEVER_MAIN = frozenset("hidden comment comments commentlist respond disqus replies discussion responses".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAF_TAGS = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 figcaption caption hr br option".split())
LIST_TAGS = frozenset("ul ol dl table div section".split())


@lru_cache(maxsize=4096)
def is_noise(signature: str) -> bool:
    """Whether a tag or a word of its class, id or role says that it is not main text."""
    tag, *words = signature.split(".")
    return tag in NOISE_TAGS or any(w in NOISE_WORDS for w in words)


class Part:
    """A part of a wrapper: an element ("e"), a text ("t") or a repeated group ("g"), perhaps optional or repeated.

    A text has its literal while all instances agree, the smallest hashes of the
    pages it is on (up to TEMPLATE_PAGES), and its characters, linked ones apart.
    ``refs`` names the texts of a page that it stands for; ``main`` is the decision.
    """

    __slots__ = ("kind", "sign", "optional", "repeated", "kids", "literal", "seen", "chars", "linked", "refs", "main")

    def __init__(self, kind, sign, kids=(), literal=None, seen=(), chars=0, linked=0, refs=(), optional=False, repeated=False, main=False):
        self.kind, self.sign, self.kids, self.literal, self.seen = kind, sign, list(kids), literal, seen
        self.chars, self.linked, self.refs = chars, linked, list(refs)
        self.optional, self.repeated, self.main = optional, repeated, main

    def absorb(self, other: Part) -> Part:
        """Both in one, in place: of texts that differ, a slot is left."""
        if self.kind == "t":
            if self.literal != other.literal:
                self.literal = None
            if self.seen != other.seen:
                self.seen = tuple(sorted({*self.seen, *other.seen})[:TEMPLATE_PAGES])
            self.chars, self.linked = self.chars + other.chars, self.linked + other.linked
            self.refs += other.refs
        else:
            self.kids = align(self.kids, other.kids)
        self.optional |= other.optional
        self.repeated |= other.repeated
        return self

    def as_optional(self, sign: str = "") -> Part:
        self.optional, self.sign = True, sign or self.sign
        return self


def like(a: Part, b: Part) -> bool:
    """Whether neighbours are instances of one repeated part; containers must hold like things."""
    if a.sign != b.sign or a.kind == "t":
        return False
    if a.sign.split(".", 1)[0] in LEAF_TAGS or a.kind == "g":
        return True
    mine, theirs = {k.sign for k in a.kids}, {k.sign for k in b.kids}
    return 2 * len(mine & theirs) >= len(mine | theirs)


def fold(parts: list[Part]) -> list[Part]:
    """Runs of like parts as repeated ones, then runs of like sequences as repeated groups."""
    out: list[Part] = []
    for part in parts:
        if out and like(out[-1], part):
            out[-1].absorb(part).repeated = True
        else:
            out.append(part)
    for period in range(2, LONGEST_PERIOD + 1):
        if len(out) < 2 * period:
            break
        out = _grouped(out, period)
    return generalised(out) if len(out) > LEVEL_PARTS else out


def _grouped(parts: list[Part], period: int) -> list[Part]:
    out, i, signs = [], 0, [p.sign for p in parts]
    while i < len(parts):
        times = 1
        while signs[i : i + period] == signs[i + times * period : i + (times + 1) * period] and len(signs) >= i + (times + 1) * period:
            times += 1
        if times == 1:
            out.append(parts[i])
            i += 1
            continue
        kids = parts[i : i + period]
        for t in range(1, times):
            kids = [a.absorb(b) for a, b in zip(kids, parts[i + t * period : i + (t + 1) * period])]
        out.append(Part("g", f"({' '.join(signs[i : i + period])})", kids, repeated=True))
        i += times * period
    return out


def flattened(parts: list[Part]) -> list[Part]:
    return [k for p in parts for k in (p.kids if p.kind == "g" else (p,))]


def generalised(parts: list[Part]) -> list[Part]:
    """One repeated group of optional parts, each sign once; where signs are too many, tags alone count."""
    flat = flattened(parts)
    plain = len({p.sign for p in flat}) > LEVEL_PARTS
    kinds: dict[str, Part] = {}
    for p in flat:
        one = p.as_optional(p.sign.split(".", 1)[0] if plain else "")
        kinds[one.sign] = kinds[one.sign].absorb(one) if one.sign in kinds else one
    return [Part("g", "(*)", kinds.values(), repeated=True)]


def _is_general(parts: list[Part]) -> bool:
    return len(parts) == 1 and parts[0].sign == "(*)"


def _wrapped(parts: list[Part], others: list[Part]) -> list[Part]:
    """``parts`` with single runs of what is a repeated group among ``others`` put as that group."""
    groups = [g for g in others if g.kind == "g" and g.sign != "(*)" and all(p.sign != g.sign for p in parts)]
    for g in groups:
        signs, wanted = [p.sign for p in parts], [k.sign for k in g.kids]
        for i in range(len(parts) - len(wanted) + 1):
            if signs[i : i + len(wanted)] == wanted:
                parts = parts[:i] + [Part("g", g.sign, parts[i : i + len(wanted)], repeated=True)] + parts[i + len(wanted) :]
                break
    return parts


def pairing(a: list[Part], b: list[Part]) -> list[tuple[int | None, int | None]]:
    """Places of both sequences in a common order, equal signs beside each other as often as possible."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below, sign = table[i], table[i + 1], a[i].sign
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if sign == b[j].sign else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i].sign == b[j].sign:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out + [(k, None) for k in range(i, len(a))] + [(None, k) for k in range(j, len(b))]


def opened_out(a: list[Part], b: list[Part]) -> tuple[list[Part], list[Part]]:
    """Both levels with the same groups."""
    if any(p.kind == "g" for p in a) or any(p.kind == "g" for p in b):
        return _wrapped(a, b), _wrapped(b, a)
    return a, b


def align(a: list[Part], b: list[Part]) -> list[Part]:
    """The expression of both: mismatches become slots and optional parts."""
    if len(a) == len(b) and all(x.sign == y.sign for x, y in zip(a, b)) and not _is_general(a):
        return [x.absorb(y) for x, y in zip(a, b)]
    if _is_general(a) or _is_general(b):
        return generalised(a + b)
    a, b = opened_out(a, b)
    out = [a[i].absorb(b[j]) if i is not None and j is not None else (a[i] if j is None else b[j]).as_optional() for i, j in pairing(a, b)]
    return generalised(out) if len(out) > LEVEL_PARTS else out


def wrapper_of(nodes: list, page: int, texts: list[Text]) -> list[Part]:
    """The wrapper of one page; its texts are appended to ``texts`` in page order, and named by their place there."""
    parts = []
    for node in nodes:
        if isinstance(node, Element):
            parts.append(Part("e", node.signature, wrapper_of(node.kids, page, texts)))
        else:
            texts.append(node)
            code = zlib.crc32(node.text.encode("utf-8", "replace"))
            parts.append(Part("t", "#", (), code, (page,), len(node.text), node.linked, (len(texts) - 1,)))
    return fold(parts)


def page_wrapper(html: str | None) -> tuple[list[Part], list[Text]]:
    texts: list[Text] = []
    nodes = parse(html, is_noise)
    return wrapper_of(nodes, zlib.crc32((html or "").encode("utf-8", "replace")), texts), texts


# -- which slots are main text ---------------------------------------------------


def decide(parts: list[Part]) -> list[Part]:
    """Marks the main texts of a wrapper, from what its slots count over all pages of the host."""
    pages = {h for p in _texts(parts) for h in p.seen}
    regions = _regions(parts, _weight(parts)) or [_dense(parts)]
    for region in regions:
        varies = any(p.literal is None for p in _texts(region))
        _mark(region, _weight(region), varies and len(pages) >= TEMPLATE_PAGES)
    return parts


def _texts(parts: list[Part]) -> Iterator[Part]:
    for p in parts:
        if p.kind == "t":
            yield p
        else:
            yield from _texts(p.kids)


def _weight(parts: list[Part]) -> int:
    """Characters outside links."""
    return sum(p.chars - p.linked for p in _texts(parts))


def _open(parts: list[Part], whole: int, inside: bool = False) -> list[Part]:
    """Without the parts whose tag or names are noise, groups opened.

    A form, or a part that is noise by its names only, stays if it holds most of the
    ``whole`` text; ``inside`` a region it must be named as content too, and headers stay.
    """
    out = []
    for p in parts:
        if p.kind == "g":
            out += _open(p.kids, whole, inside)
            continue
        tag, *words = p.sign.split(".")
        if p.kind == "t" or not is_noise(p.sign) and (inside or tag != "header"):
            out.append(p)
        elif (tag == "form" or tag not in NOISE_TAGS and tag != "header") and not NEVER_MAIN.intersection(words):
            if (not inside or MAIN_WORDS.intersection(words)) and 10 * _weight(p.kids) > 7 * whole:
                out.append(p)
    return out


def _open_weight(parts: list[Part], whole: int) -> int:
    """Characters outside links and noise at any depth."""
    return sum(p.chars - p.linked if p.kind == "t" else _open_weight(p.kids, whole) for p in _open(parts, whole))


def _regions(parts: list[Part], whole: int) -> list[list[Part]]:
    """What the outermost article elements hold, else main ones or those named so."""
    for fits in (lambda tag, words: tag == "article", lambda tag, words: tag == "main" or "main" in words or "articlebody" in words):
        if found := list(_outermost(parts, whole, _open_weight(parts, whole), fits)):
            return found
    return []


def _outermost(parts: list[Part], whole: int, clear: int, fits) -> Iterator[list[Part]]:
    for p in _open(parts, whole):
        tag, *words = p.sign.split(".")
        if p.kind == "e" and fits(tag, words) and 20 * _open_weight(p.kids, whole) >= clear:
            yield p.kids
        else:
            yield from _outermost(p.kids, whole, clear, fits)


def _dense(parts: list[Part]) -> list[Part]:
    """Goes down while one container holds most of the unlinked text."""
    while True:
        all_, opened = _weight(parts), _open(parts, _weight(parts))
        whole = _open_weight(parts, all_)
        inner = [p for p in opened if p.kind == "e" and p.sign.split(".", 1)[0] not in LEAF_TAGS and 10 * _open_weight(p.kids, all_) >= 6 * whole > 0]
        if len(inner) != 1:
            return parts
        parts = inner[0].kids


def _mark(parts: list[Part], whole: int, template_known: bool) -> None:
    """Marks the texts inside a region, without noise, lists of links and the template's own texts."""
    for p in _open(parts, whole, inside=True):
        if p.kind == "t":
            p.main = True
            continue
        tag = p.sign.split(".", 1)[0]
        held = list(_texts(p.kids))
        if tag in LIST_TAGS and 5 * sum(t.linked for t in held) > 4 * sum(t.chars for t in held):
            continue
        fixed = template_known and tag != "h1" and not p.optional and not p.repeated and all(t.literal is not None and len(t.seen) == TEMPLATE_PAGES for t in held)
        if not fixed:
            _mark([k for k in p.kids if tag != "header" or k.sign.split(".", 1)[0] in HEADINGS], whole, template_known)


def read_page(wrapper: list[Part], own: list[Part], main: list[bool], above: bool = False) -> None:
    """Carries the decisions of ``wrapper`` over to the texts of a page; what it doesn't know follows the part around it."""
    if _is_general(wrapper) or _is_general(own):
        known = {p.sign: p for p in reversed(flattened(wrapper))}
        pairs = [(known.get(p.sign) or known.get(p.sign.split(".", 1)[0]), p) for p in flattened(own)]
    else:
        wrapper, own = opened_out(wrapper, own)
        pairs = [(None if i is None else wrapper[i], own[j]) for i, j in pairing(wrapper, own) if j is not None]
    for part, found in pairs:
        if part is None or found.kind == "t":
            for text in _texts([found]):
                for ref in text.refs:
                    main[ref] = above if part is None else part.main
        else:
            held = list(_texts(part.kids))
            read_page(part.kids, found.kids, main, bool(held) and all(t.main for t in held))


def main_text(html: str | None, wrapper: list[Part] | None) -> str:
    """Main blocks of a page joined by line breaks. Where the host's wrapper finds none, the page decides alone."""
    own, texts = page_wrapper(html)
    main = [False] * len(texts)
    if wrapper is not None:
        read_page(wrapper, own, main)
    if texts and not any(main):
        for slot in _texts(decide(page_wrapper(html)[0])):
            for ref in slot.refs:
                main[ref] = slot.main
    return "\n".join(t.text for t, m in zip(texts, main) if m)


# -- wrappers as text ------------------------------------------------------------


def packed(parts: list[Part], decided: bool = False) -> str:
    """JSON of a wrapper; of a decided one only what reading a page needs."""

    def row(p: Part) -> list:
        flags = p.optional + 2 * p.repeated + 4 * p.main
        if p.kind == "t":
            return ["t", flags] if decided else ["t", flags, p.literal, list(p.seen), p.chars, p.linked]
        return [p.kind, flags, p.sign, [row(k) for k in p.kids]]

    return json.dumps([row(p) for p in parts], separators=(",", ":"))


def unpacked(text: str) -> list[Part]:
    def part(row: list) -> Part:
        kind, flags, *rest = row
        state = {"optional": bool(flags & 1), "repeated": bool(flags & 2), "main": bool(flags & 4)}
        if kind == "t":
            literal, seen, chars, linked = rest or (None, (), 0, 0)
            return Part("t", "#", (), literal, tuple(seen), chars, linked, **state)
        return Part(kind, rest[0], [part(k) for k in rest[1]], **state)

    return [part(row) for row in json.loads(text)]


# -- over tables -------------------------------------------------------------------


def host_of(url: str = "url"):
    """The host of a URL in lower case; empty for null and for what has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_WRAPPERS = StructType().add("host", StringType()).add("part", LongType()).add("wrapper", StringType())


def _rows(made: list[tuple]) -> pa.RecordBatch:
    columns = zip(*made) if made else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, to_arrow_schema(_WRAPPERS))], schema=to_arrow_schema(_WRAPPERS))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A wrapper of every host of a partition."""
    number, held = TaskContext.get().partitionId(), {}
    for batch in batches:
        for host, html in zip(*(c.to_pylist() for c in batch.columns)):
            own = page_wrapper(html)[0]
            for slot in _texts(own):
                slot.refs = []
            held[host] = align(held[host], own) if host in held else own
        if len(held) > HOSTS_HELD:
            yield _rows([(h, number, packed(w)) for h, w in held.items()])
            held = {}
    yield _rows([(h, number, packed(w)) for h, w in held.items()])


def _merge(final: bool):
    """Merges wrappers that come sorted by host (and by group, unless it is the last round)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def done() -> tuple:
            return (*key, packed(decide(held), decided=True) if final else packed(held))

        for batch in batches:
            made = []
            for host, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                here, own = (host, 0 if final else part), unpacked(text)
                if key is not None and here != key:
                    made.append(done())
                    key = None
                held, key = own if key is None else align(held, own), here
            yield _rows(made)
        if key is not None:
            yield _rows([done()])

    return run


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper: a decided wrapper of every host of ``pages`` (host, html)."""
    parts = pages.select("host", "html").mapInArrow(_infer, _WRAPPERS).withColumn("part", F.col("part") % MERGE_GROUPS)
    some = parts.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").mapInArrow(_merge(False), _WRAPPERS)
    whole = some.repartition("host").sortWithinPartitions("host", "part").mapInArrow(_merge(True), _WRAPPERS)
    return whole.select("host", "wrapper")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` but html, with text and n_chars added (columns so named are replaced).

    Blocks of main text in page order, white space inside one made single spaces,
    joined by line breaks; null or empty html gives an empty text, a page without
    main text too. A null or odd url belongs to the host without a name; repeated
    rows are pages of their own; pages of any length are read whole; an empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "wrappers")
    wrappers = scratch.keep(host_wrappers(pages.select(host_of().alias("host"), "html")), "hosts")
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    known = wrappers.select(F.col("host").alias("h"), "wrapper")

    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    sent = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), host_of().alias("host"), F.col("html").alias("html"))
    joined = sent.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, F.col("host") == F.col("h"), "left").drop("host", "h")
    out = StructType([joined.schema[f"c{i}"] for i in range(len(kept))]).add("text", StringType()).add("n_chars", LongType())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[str, list[Part]] = {}
        for batch in batches:
            texts = []
            for html, plan in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()):
                if plan is not None and plan not in plans:
                    if len(plans) > HOSTS_HELD:
                        plans.clear()
                    plans[plan] = unpacked(plan)
                texts.append(main_text(html, None if plan is None else plans[plan]))
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=to_arrow_schema(out))

    done = joined.mapInArrow(read, out)
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "text", "n_chars")
