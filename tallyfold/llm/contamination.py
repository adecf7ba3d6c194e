"""Benchmark decontamination with one Aho-Corasick automaton over normalised items."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

from .rows import with_computed
from .words import alnum_words

WINDOW = 13
#: Words before A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HIT_SHARE = 20
#: Words of the windows in one automaton. Items beyond it get an automaton of their own, in another pass over the same batch.
AUTOMATON_WORDS = 4_000_000

REPORT = (
    StructType()
    .add("n_words", LongType())
    .add("n_hit", LongType())
    .add("items", ArrayType(StringType()))
    .add("spans", ArrayType(StructType().add("first", LongType()).add("last", LongType()).add("start", LongType()).add("stop", LongType())))
    .add("contaminated", BooleanType())
)



def item_windows(words: list[bytes], width: int = WINDOW) -> list[str]:
    """Each run of ``width`` words, or the whole of a shorter item, between single spaces."""
    if not words:
        return []
    width = min(width, len(words))
    return [f" {b' '.join(words[i : i + width]).decode()} " for i in range(len(words) - width + 1)]


def shards(items: list[tuple[str, str]], limit: int = AUTOMATON_WORDS) -> list[dict[str, list[str]]]:
    """Windows with the ids of their items, cut where a shard reaches ``limit`` words."""
    out: list[dict[str, list[str]]] = [{}]
    size = 0
    for item_id, text in items:
        for window in item_windows(alnum_words(text)):
            ids = out[-1].setdefault(window, [])
            if item_id not in ids:
                ids.append(item_id)
            size += window.count(" ")
        if size >= limit:
            out.append({})
            size = 0
    return [x for x in out if x]


def automaton(windows: dict[str, list[str]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for window, ids in windows.items():
        made.add_word(window, (len(window), window.count(" ") - 1, ids))
    made.make_automaton()
    return made


def scan(text: str | None, automata: list[ahocorasick.Automaton]) -> tuple[int, int, list[str], list[dict], bool]:
    """Words, hit words, matched item ids, merged word spans and the verdict on one text."""
    words = alnum_words(text)
    if not words or not automata:
        return len(words), 0, [], [], False
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    found = [(end, hit) for machine in automata for end, hit in machine.iter(joined)]
    if not found:
        return len(words), 0, [], [], False
    gaps = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 0x20)
    ends = np.searchsorted(gaps, [end for end, _ in found])
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, ends - [n for _, (_, n, _) in found], 1)
    np.add.at(edges, ends, -1)
    covered = np.cumsum(edges[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    # Only texts with hits are looked through again, for where their words stand in the original.
    places = [m.span() for m in WORD.finditer(text)]
    spans = [{"first": int(a), "last": int(b) - 1, "start": places[a][0], "stop": places[b - 1][1]} for a, b in turns.reshape(-1, 2)]
    hit = int(covered.sum())
    return len(words), hit, sorted({i for _, (_, _, ids) in found for i in ids}), spans, HIT_SHARE * hit >= len(words)


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, items, spans and contaminated.

    A word is hit when it lies in an occurrence of 13 consecutive words of an
    item, or of a whole shorter item. A document is contaminated when hit words
    are at least a twentieth of its words. Null texts and items have no words;
    items of null id are named ''; spans are word positions (first and last,
    included) and code points of the original text (start and stop, excluded).
    The benchmark is the only thing sent to every executor; its windows are held
    in automata of at most AUTOMATON_WORDS words each.
    """
    items = [(("" if r[0] is None else str(r[0])), r[1]) for r in benchmark.select("item_id", "text").distinct().toLocalIterator()]
    parts = docs.sparkSession.sparkContext.broadcast(shards(items))

    def start():
        machines = [automaton(x) for x in parts.value]
        return lambda texts: [scan(text, machines) for text in texts]

    return with_computed(docs, REPORT, start, keep_text)
