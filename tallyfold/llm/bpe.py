"""Byte-level BPE by a contiguous rank array.

A word is held as its part boundaries and, beside them, the merge rank of each
adjacent pair of parts. The smallest rank is looked for again and again; its
inner boundary goes, and the two neighbouring ranks are looked up anew. The scan
costs the square of a word's length, so words beyond SHORT bytes keep the same
arrays as linked parts with a heap of ranks.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from itertools import pairwise
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from .rows import with_computed

NO_RANK = 1 << 30
SHORT = 128
#: Words whose ids a worker remembers; all are forgotten when there are so many.
MEMO_WORDS = 400_000
MEMO_BYTES = 64

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where visible, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankArrayBPE:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, vocabulary: dict):
        to_byte = byte_alphabet()
        raw = lambda token: bytes(to_byte[c] for c in token)
        model = vocabulary["model"]
        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        sides = [(raw(a), raw(b)) for a, b in pairs]
        self.ranks = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in enumerate(sides)}
        self.joined = [self.ids[a + b] for a, b in sides]
        self.special = {t["content"]: t["id"] for t in vocabulary.get("added_tokens", [])}
        self.tokens = {i: token for token, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.memo: dict[str, bytes] = {}

    def _short(self, word: bytes) -> list[int]:
        """parts[i] is the token from the i-th boundary to the next, ranks[i] its rank with the next part; deleting an entry deletes that boundary."""
        rank_of, joined = self.ranks.get, self.joined
        parts = [self.byte_ids[b] for b in word]
        ranks = [rank_of(a << 32 | b, NO_RANK) for a, b in pairwise(parts)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            del parts[at + 1], ranks[at]
            parts[at] = merged = joined[least]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 32 | merged, NO_RANK)
            if at < len(ranks):
                ranks[at] = rank_of(merged << 32 | parts[at + 1], NO_RANK)
        return parts

    def _long(self, word: bytes) -> list[int]:
        size, rank_of = len(word), self.ranks.get
        parts = [self.byte_ids[b] for b in word]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))

        def pair_rank(left: int) -> int:
            right = after[left]
            return rank_of(parts[left] << 32 | parts[right], NO_RANK) if right < size else NO_RANK

        ranks = [pair_rank(i) for i in range(size)]
        heap = [(rank, i) for i, rank in enumerate(ranks) if rank != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, left = heapq.heappop(heap)
            if ranks[left] != rank:
                continue
            right = after[left]
            parts[left], after[left], ranks[right] = self.joined[rank], after[right], NO_RANK
            if after[left] < size:
                before[after[left]] = left
            for i in (left, before[left]):
                if i >= 0:
                    ranks[i] = pair_rank(i)
                    if ranks[i] != NO_RANK:
                        heapq.heappush(heap, (ranks[i], i))
        out, at = [], 0
        while at < size:
            out.append(parts[at])
            at = after[at]
        return out

    def word_ids(self, word: bytes) -> list[int]:
        return self._short(word) if len(word) <= SHORT else self._long(word)

    def _packed(self, piece: str) -> bytes:
        word = piece.encode("utf-8", "replace")
        ids = self.word_ids(word)
        packed = pack(f"<{len(ids)}I", *ids)
        if len(word) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        out, known, fresh = [], self.memo.get, self._packed
        for i, part in enumerate(self.special_split.split(text) if self.special_split else [text]):
            if i % 2:
                out.append(pack("<I", self.special[part]))
            else:
                out += [known(piece) or fresh(piece) for piece in SPLIT.findall(part)]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        tokens = self.tokens.get
        return b"".join([tokens(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def parsed(vocabulary_json: str) -> RankArrayBPE:
    return RankArrayBPE(json.loads(vocabulary_json))


CODED = StructType().add("ids", BinaryType()).add("n_tokens", LongType()).add("decoded", StringType())


def encode_documents(docs: DataFrame, vocabulary_path: str, keep_text: bool = True) -> DataFrame:
    """``docs`` with ids (binary, little-endian unsigned 32-bit), n_tokens and decoded.

    A null text encodes as an empty one. Columns named like an added one are
    replaced. The vocabulary is read once by the driver; its size is fixed.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def start():
        bpe = parsed(shared.value)

        def encode(texts: list[str | None]) -> list[tuple]:
            packed = [bpe.encode_packed(t or "") for t in texts]
            return [(p, len(p) // 4, bpe.decode(np.frombuffer(p, "<u4").tolist())) for p in packed]

        return encode

    return with_computed(docs, CODED, start, keep_text)
