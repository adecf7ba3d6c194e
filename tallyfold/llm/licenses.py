"""License scans: license phrases, and blocks of text that contain a license template.

A template is contained in a block when at least CONTAINMENT of the template's
word pairs occur in the block. The join of block sets with template sets is exact.
Sets are ordered by the pairs' number in the whole corpus, rarest first; for an
overlap of o, the first common pair must be among the first n - o + 1 of each side
(prefix filter on both), a block must have o of the templates' pairs (length
filter), and from a common pair at place i of the template and j of the block on,
at most the shorter rest can still agree (positional filter). What remains is
counted in full.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import alnum_words

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Openings of public license texts.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2-text": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}
#: Whole texts of short public licenses.
FULL_TEXTS = {
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
CONTAINMENT = 0.7
#: Blocks are windows of so many words, half of it apart, and at least twice as long as the longest template; a shorter text is one block.
LEAST_BLOCK = 200


Pair = tuple[bytes, bytes]


def pairs(words: list[bytes]) -> list[Pair]:
    return list(zip(words, words[1:]))


@dataclass
class Template:
    label: str
    #: Places of its distinct pairs in the global order, rarest first.
    ordered: list[int]
    needed: int


@dataclass
class TemplateIndex:
    """Templates, the global order of their pairs, and where a pair stands in a template's prefix."""

    rank: dict[Pair, int]
    templates: list[Template]
    block: int

    def __post_init__(self) -> None:
        pair_of = {r: p for p, r in self.rank.items()}
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, template in enumerate(self.templates):
            for i, r in enumerate(template.ordered[: len(template.ordered) - template.needed + 1]):
                self.postings.setdefault(r, []).append((t, i))
        self.rare = {pair_of[r] for r in self.postings}
        self.least = min((t.needed for t in self.templates), default=0)

    @staticmethod
    def of(templates: dict[str, str], counts: dict[Pair, int], containment: float = CONTAINMENT) -> TemplateIndex:
        texts = {label: alnum_words(text) for label, text in sorted(templates.items())}
        order = sorted({p for words in texts.values() for p in pairs(words)}, key=lambda p: (counts.get(p, 0), p))
        rank = {p: i for i, p in enumerate(order)}
        made = []
        for label, words in texts.items():
            own = sorted({rank[p] for p in pairs(words)})
            if own:
                made.append(Template(label, own, max(1, int(np.ceil(containment * len(own) - 1e-9)))))
        return TemplateIndex(rank, made, max([LEAST_BLOCK, *(2 * len(w) for w in texts.values())]))

    def candidates(self, block: list[int]) -> set[int]:
        """Templates that pass the prefix, length and positional filters on a block's pairs (in global order)."""
        shared: dict[int, int] = {}
        lost: set[int] = set()
        for j, r in enumerate(block[: len(block) - self.least + 1]):
            for t, i in self.postings.get(r, ()):
                needed = self.templates[t].needed
                if t in lost or j > len(block) - needed:
                    continue
                shared[t] = shared.get(t, 0) + 1
                if shared[t] + min(len(self.templates[t].ordered) - 1 - i, len(block) - 1 - j) < needed:
                    lost.add(t)
        return shared.keys() - lost

    def blocks(self, words: list[bytes]) -> Iterator[list[int]]:
        """The pairs, in global order, of every block that holds a pair of a prefix."""
        if self.rare.isdisjoint(zip(words, words[1:])):
            return
        found = [(i, r) for i, p in enumerate(zip(words, words[1:])) if (r := self.rank.get(p)) is not None]
        step = self.block // 2
        windows: dict[int, set[int]] = {}
        for i, r in found:
            for start in {max(0, (i // step - 1) * step), i // step * step}:
                if i + 2 <= start + self.block:
                    windows.setdefault(start, set()).add(r)
        for held in windows.values():
            if not self.postings.keys().isdisjoint(held):
                yield sorted(held)

    def matching(self, words: list[bytes]) -> dict[str, float]:
        """Containment of each template that a block of the text meets."""
        out: dict[str, float] = {}
        for block in self.blocks(words):
            held = set(block)
            for t in self.candidates(block):
                template = self.templates[t]
                overlap = sum(r in held for r in template.ordered)
                if overlap >= template.needed:
                    out[template.label] = max(out.get(template.label, 0.0), overlap / len(template.ordered))
        return out


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Word positions at which the words of a phrase stand, with its label."""
    found = []
    for phrase, label in phrases.items():
        parts = alnum_words(phrase)
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                found.append((at, label))
    return sorted(found)


def template_counts(docs: DataFrame, templates: dict[str, str]) -> dict[Pair, int]:
    """How often each pair of the templates stands in the whole corpus."""
    wanted = {p for text in templates.values() for p in pairs(alnum_words(text))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[Pair] = Counter()
        for batch in batches:
            for text in batch.column(0):
                words = alnum_words(text.as_py())
                seen.update(filter(wanted.__contains__, zip(words, words[1:])))
        columns = [[a for a, _ in seen], [b for _, b in seen], list(seen.values())]
        kinds = [pa.binary(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "b", "n"])

    rows = docs.select("text").mapInArrow(count, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return {(bytes(r["a"]), bytes(r["b"])): r["n"] for r in rows}


ADDED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES | FULL_TEXTS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of docs (doc_id, text).

    n_base counts the places of all phrases; first_word and last_word are the
    smallest and largest start, null without one. labels has the templates' too.
    score is 1 with a phrase, else the largest containment of a template, else 0.
    Null and empty texts have no words and no labels; repeated rows each have
    their row; long texts are taken whole, block by block; other columns of
    ``docs``, whatever their names, are left out. The templates' index goes to
    every worker: its size is that of the templates given.
    """
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex.of(templates, template_counts(docs, templates)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                words = alnum_words(cell.as_py())
                places, extra = phrase_places(words, phrases), index.value.matching(words)
                base = {label for _, label in places}
                rows.append(
                    (
                        len(words),
                        len(places),
                        places[0][0] if places else None,
                        places[-1][0] if places else None,
                        ",".join(sorted(base)),
                        ",".join(sorted(base | set(extra))),
                        1.0 if places else max(extra.values(), default=0.0),
                    )
                )
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {ADDED}")
