"""The byte model of context mixing: hashed bit predictors, a gated mixer, an adaptive map.

A byte is told by its rank among the bytes that follow the two before it in training
text, and the rank by the bits of a prefix code, so that a byte takes about three
decisions instead of eight; 0xFF, no byte of UTF-8, ends a text. Two kinds of
predictors look back over word boundaries, LOOK_BACK bytes at most:

* counting ones hold how often each decision of the code went either way under a
  hashed context (NODES: so many bytes, or the word so far);
* following ones hold, under a longer context (RUNS: bytes, or the word before and
  the word so far), the byte that mostly came next, beside a check of the context.
  What their guesses are worth is learned per number of sightings and depth.

``Learner`` runs along training text: every block is predicted from what was seen
before it, the mixer takes an online Newton step, and only then the block enters
the tables. Learners of several tasks are summed (``merged``, ``Model.of``).
``Scorer`` prices texts: the weights of each group of predictors follow a text
online from its first bit on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np

from .words import _powers, scramble

END = 0xFF
LOOK_BACK, WORD_BACK = 32, 24
NODES = (4, 6, "word")
RUNS = (16, "words")
INPUTS = len(NODES) + len(RUNS) + 1
#: Which group of predictors an input belongs to: near bytes (and the bias), more bytes, the word, long contexts.
GROUP_OF = np.array([0, 1, 2, 3, 3, 0])
GROUPS = int(GROUP_OF.max()) + 1
#: Gates: place in the word, the first following predictor that knows its context (or none), and whether it is sure.
DEPTHS, PLACES, SURE = 8, 7, 3
GATES = PLACES * (1 + 2 * len(RUNS))
MAP_STEPS = 33
#: Bounds of the tables: at most 2**MOST_BITS slots, of two bytes in a counting table and of four in a following one.
MOST_BITS, FREE_RUN_BITS = 24, 22
SEGMENTS = 32
BLOCK_BYTES, LEAST_BLOCK = 128_000, 1_000
#: Bytes whose decisions are made at once, so that they fit the caches; nothing else depends on them.
SCORED_BYTES, LEARNED_BYTES = 32_000, 48_000
#: Mixer: weights that learning starts from, how firmly, and how much of its past a block keeps.
FIRST_WEIGHTS, FIRMNESS, KEPT = np.array([0.2, 0.4, 0.4, 0.3, 0.3, 0.0]), 20.0, 0.995
#: Texts: how firmly their groups' weights start from one; bits after which they are adapted, the last one over and over.
TEXT_FIRMNESS, STEPS = 25.0, (512, 1_024, 2_048)
RUN_BIN = np.searchsorted([1, 2, 3, 4, 6, 9, 16, 32, 64, 128], np.arange(256), side="right").astype(np.uint8)
RUN_BINS = int(RUN_BIN.max()) + 1
_RUN_BIN = RUN_BIN.tobytes()
#: What a slot of a counting table (times the second branch was taken in the high byte, the first in the low one) says: log odds.
MOST = 255
ODDS = (np.log(np.arange(65_536) // 256 + 0.2) - np.log(np.arange(65_536) % 256 + 0.2)).astype(np.float32)
#: The same in sixteenths, as a model holds it.
ROUND_ODDS = ((np.arange(256) - 128) / 16).astype(np.float32)
_ROUNDED = (np.rint(ODDS * 16) + 128).astype(np.uint8)
_BLANK = np.isin(np.arange(256), list(b" \n\t\r\x0b\x0c\xff")).tobytes()
_ONE, _SPREAD = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


#: Kinds of bytes: letters (whatever their case), blanks, digits, ends of sentences, other marks, beyond ASCII, the rest.
_KIND = np.full(256, 31)
for _k, _members in ((27, b"0123456789"), (28, b".!?"), (29, b",;:"), (26, b" \n\t\r\x0b\x0c\xff")):
    _KIND[list(_members)] = _k
_KIND[0x80:0xFF] = 30
_KIND[0x61:0x7B] = _KIND[0x41:0x5B] = np.arange(26)
_KINDS = _KIND.astype(np.uint8).tobytes()
BEFORE = 256 * 32


def after(joined: bytes) -> np.ndarray:
    """What ranks behind each byte depend on: that byte and the kind of the one before it."""
    out = np.frombuffer(joined, np.uint8).astype(np.int64)
    out <<= 5
    out[1:] += np.frombuffer(joined.translate(_KINDS), np.uint8)[:-1]
    return out


def follower_counts(texts: Iterable[bytes], counts: np.ndarray) -> None:
    """Adds how often each byte, and the end of a text, stands behind what ``after`` tells of the bytes before it."""
    parts = [part for raw in texts for part in units(raw)]
    if not parts:
        return
    joined = b"".join(parts)
    at = _told(parts, len(joined))
    keys = after(joined).take(at - 1)
    keys <<= 8
    keys += np.frombuffer(joined, np.uint8).take(at)
    if len(keys) < counts.size // 16:
        keys, many = _summed(keys)
        counts.reshape(-1)[keys] += many
    else:
        counts += np.bincount(keys, minlength=counts.size).reshape(counts.shape)


def _told(parts: list[bytes], size: int) -> np.ndarray:
    """Where in the joined parts the bytes stand that are to be told."""
    keep = np.ones(size, bool)
    begin = 0
    for part in parts:
        keep[begin : begin + LOOK_BACK] = False
        begin += len(part)
    return np.flatnonzero(keep)


@dataclass
class Code:
    """The rank of each byte behind each ``before``; for every rank the length of its code, and at each depth the inner node and the bit."""

    rank: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    #: How many first bits two ranks share.
    common: np.ndarray

    def __post_init__(self) -> None:
        """The decisions of all codes one after another: where those of a rank begin, their depths, nodes and bits."""
        self.begin = np.cumsum(self.length) - self.length
        rank = np.repeat(np.arange(len(self.length)), self.length)
        depth = np.arange(len(rank)) - self.begin[rank]
        self.depths = depth.astype(np.int8)
        self.nodes, self.bits = self.node[depth, rank], self.bit[depth, rank]
        self.levels = np.minimum(depth, DEPTHS - 1) * GATES

    @staticmethod
    def of(followers: np.ndarray) -> Code:
        """Ranks by follower counts (bytes not seen there by their number anywhere) and Huffman's code for the ranks.

        Rare ranks count as one in 2**14 bytes, which bounds the length of a code.
        """
        anywhere = followers.sum(axis=0)
        order = np.argsort(-(followers + (anywhere + 0.5) / (anywhere.sum() + 256)), axis=1, kind="stable")
        rank = np.empty(followers.shape, np.uint8)
        np.put_along_axis(rank, order, np.arange(256, dtype=np.uint8)[None], axis=1)
        counts = np.take_along_axis(followers, order, axis=1).sum(axis=0)
        weight = np.maximum(counts.astype(float), max(1.0, counts.sum() / (1 << 14)))
        heap: list[tuple] = [(w, s, s) for s, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        made = 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], made, (b[2], a[2])))
            made += 1
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        # The heavier branch comes first, so that nodes of one path mostly have neighbouring numbers.
        stack, number = [(heap[0][2], [])], 0
        while stack:
            tree, path = stack.pop()
            if isinstance(tree, int):
                paths[tree] = path
                continue
            node, number = number, number + 1
            stack += [(tree[1], [*path, (node, 1)]), (tree[0], [*path, (node, 0)])]
        deepest = max(map(len, paths))
        node, bit = np.zeros((deepest, 256), np.uint8), np.full((deepest, 256), 2, np.int8)
        for s, path in enumerate(paths):
            for j, (n, b) in enumerate(path):
                node[j, s], bit[j, s] = n, b
        common = np.cumprod(bit[:, :, None] == bit[:, None, :], axis=0).sum(axis=0)
        return Code(rank, np.array(list(map(len, paths))), node, bit, common.astype(np.int8))


@dataclass
class Sizes:
    """Binary logarithms of the slots of counting and following tables."""

    node: int
    run: int

    @staticmethod
    def of(training_bytes: int) -> Sizes:
        """Slots in proportion to the training text, up to 2**MOST_BITS; following tables, whose contexts mostly stand once, grow slower."""
        bits = max(1, int(training_bytes)).bit_length()
        return Sizes(min(MOST_BITS, max(bits - 1, 10)), min(MOST_BITS, max(min(FREE_RUN_BITS, bits - 3), bits - 7, 10)))


def units(raw: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text and its end, cut every ``size`` bytes, each part behind the LOOK_BACK bytes before it (ends of text before the first)."""
    raw = bytes([END]) * LOOK_BACK + raw + bytes([END])
    for begin in range(LOOK_BACK, len(raw), size):
        yield raw[begin - LOOK_BACK : begin + size]


def _grouped(parts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Parts in groups of at least ``size`` bytes, but for the last."""
    held, total = [], 0
    for part in parts:
        held.append(part)
        total += len(part)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


class Batch:
    """The bytes of several units with their contexts, and the bits of their codes."""

    def __init__(self, parts: list[bytes], code: Code):
        self.code = code
        joined = b"".join(parts)
        data = np.frombuffer(joined, np.uint8)
        self.bytes_of = np.array([len(p) for p in parts], np.int64) - LOOK_BACK
        at = _told(parts, len(data))
        self.symbol = data.take(at)
        self.before = after(joined).take(at - 1)
        self.rank = code.rank.take((self.before << 8) + self.symbol)
        blank = np.arange(1, len(data) + 1)
        blank *= np.frombuffer(joined.translate(_BLANK), bool)
        begins = np.zeros(len(data) + 1, np.int64)
        np.maximum.accumulate(blank, out=begins[1:])
        # Where the word at a place begins, and the word before it.
        word = begins.take(at)
        last = begins.take(np.maximum(word - 1, 0))
        self.place = np.minimum((at - word + 1) >> 1, PLACES - 1).astype(np.uint8)
        # The eight bytes before, as one number.
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).take(at - 8)
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        folded = np.frombuffer(joined.lower(), np.uint8).astype(np.uint64)
        folded += _ONE
        folded *= up[:-1]
        np.cumsum(folded, out=sums[1:])
        till = sums.take(at)

        def hashed(kind: int | str) -> np.ndarray:
            if kind in range(9):
                return (eight >> np.uint64(64 - 8 * kind)) * _SPREAD
            if kind == "word":
                # What a node means depends on the bytes before; at the start of a word, they tell the end of a sentence.
                since, salt = np.maximum(word, at - WORD_BACK), self.before.view(np.uint64)
            else:
                since, salt = np.maximum(last, at - LOOK_BACK) if kind == "words" else at - kind, np.uint64(0)
            h = till - sums.take(since)
            h *= down.take(since)
            h += salt
            h ^= h >> np.uint64(31)
            h *= _SPREAD
            return h

        self.node_hash = [hashed(k) for k in NODES]
        self.run_hash = [hashed(k) for k in RUNS]

    def follow(self, runs: list[np.ndarray], bits: int) -> None:
        """Looks up what the following predictors say, and with it the gates."""
        self.run_slot = [(h >> np.uint64(64 - bits)).view(np.int64) for h in self.run_hash]
        self.run_check = [(h >> np.uint64(48 - bits)).astype(np.uint16) | np.uint16(1) for h in self.run_hash]
        self.run_held = [table.take(slot, mode="clip") for table, slot in zip(runs, self.run_slot)]
        self.agree, self.bins = [], []
        gate, before = np.zeros(len(self.place), np.uint8), self.before << 8
        for r, (entry, check) in reversed(list(enumerate(zip(self.run_held, self.run_check)))):
            low, checks = entry.view(np.uint8).reshape(-1, 4), entry.view(np.uint16)[1::2]
            seen = low[:, 0] * (checks == check)
            guess = self.code.rank.take(before + low[:, 1], mode="clip").astype(np.int64)
            guess <<= 8
            guess += self.rank
            known = seen > 0
            self.agree.insert(0, np.where(known, self.code.common.take(guess, mode="clip"), np.int8(-1)))
            self.bins.insert(0, np.frombuffer(seen.tobytes().translate(_RUN_BIN), np.uint8))
            gate = np.where(known, np.uint8(2 * r + 1) + (seen >= SURE).view(np.uint8), gate)
        self.gate = gate * np.uint8(PLACES) + self.place
        self.length = self.code.length.take(self.rank)

    def by_gate(self) -> None:
        """Puts what decisions are made of in the order of gates, in which learning needs it; the slots of followers stay in text order."""
        order = np.argsort(self.gate, kind="stable")
        self.gate, self.rank, self.length = self.gate.take(order), self.rank.take(order), self.length.take(order)
        self.node_hash, self.agree, self.bins = ([a.take(order) for a in arrays] for arrays in (self.node_hash, self.agree, self.bins))

    def in_text_order(self) -> tuple[np.ndarray, np.ndarray]:
        """The byte of every bit, and its place among the decisions of all codes."""
        self.until = np.cumsum(self.length)
        byte = np.zeros(int(self.until[-1]), np.int64)
        byte[self.until[:-1]] = 1
        np.cumsum(byte, out=byte)
        at = (self.code.begin.take(self.rank) - (self.until - self.length)).take(byte, mode="clip")
        at += np.arange(len(at))
        return byte, at

    def in_order_of_depth(self) -> tuple[np.ndarray, np.ndarray]:
        """The same, first the first bits of all bytes, then the second ones."""
        short = self.length.astype(np.uint8)
        bytes_at, left = [], np.arange(len(short))
        while len(left):
            bytes_at.append(left)
            left = left.take(np.flatnonzero(short.take(left) > len(bytes_at)))
        byte = np.concatenate(bytes_at)
        at = self.code.begin.take(self.rank).take(byte, mode="clip")
        at += np.repeat(np.arange(len(bytes_at)), [len(b) for b in bytes_at])
        return byte, at

    def decisions(self, states: list[np.ndarray], sizes: Sizes, byte: np.ndarray, at: np.ndarray) -> Decisions:
        """The bits in the order given; those of a byte, whose slots are neighbours, best come together."""
        code = self.code
        depth, bit = code.depths.take(at, mode="clip"), code.bits.take(at, mode="clip")
        gate = code.levels.take(at, mode="clip")
        gate += self.gate.take(byte, mode="clip")
        salt = _salts(sizes.node)[code.nodes].take(at, mode="clip")
        slots, held = [], []
        for table, h in zip(states, self.node_hash):
            slot = (h >> np.uint64(64 - sizes.node)).view(np.int64).take(byte, mode="clip")
            slot ^= salt
            slots.append(slot)
            held.append(table.take(slot, mode="clip"))
        guesses = []
        for agree, bins in zip(self.agree, self.bins):
            same = agree.take(byte, mode="clip")
            key = gate * RUN_BINS
            # A guess speaks up to the first bit in which it differs.
            key += bins.take(byte, mode="clip") * (same >= depth)
            key <<= 1
            key += bit ^ (same == depth)
            guesses.append(key)
        return Decisions(gate, bit, slots, held, guesses)


@dataclass
class Decisions:
    #: Level (depth up to DEPTHS) and gate in one number.
    gate: np.ndarray
    bit: np.ndarray
    #: For each counting predictor the slot and what stands there.
    slots: list[np.ndarray]
    held: list[np.ndarray]
    #: For each following predictor gate, bin of sightings (0: no guess) and the guessed bit in one number.
    guesses: list[np.ndarray]


def _said(worth: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By ``Decisions.guesses`` what a following predictor of this worth (level, bin) says, times a weight for each level and gate."""
    said = worth[:, None, :] * weights.reshape(DEPTHS, GATES, 1)
    said[..., 0] = 0
    return np.stack([-said, said], axis=-1).astype(np.float32).ravel()


_SALTS: dict[int, np.ndarray] = {}


def _salts(bits: int) -> np.ndarray:
    """A change of slot for every node; eight nodes of neighbouring numbers share a cache line."""
    if bits not in _SALTS:
        node = np.arange(256, dtype=np.uint64)
        _SALTS[bits] = ((scramble((node >> np.uint64(3)) + np.uint64(77)) >> np.uint64(64 - bits)) & ~np.uint64(7) | node & np.uint64(7)).astype(np.int64)
    return _SALTS[bits]


def probability(logit: np.ndarray) -> np.ndarray:
    p = np.minimum(logit, 12)
    np.maximum(p, -12, out=p)
    np.negative(p, out=p)
    np.exp(p, out=p)
    p += 1
    return np.reciprocal(p, out=p)


def _map_places(logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
    step = np.minimum(logit, 8)
    np.maximum(step, -8, out=step)
    step *= 2
    step += 16.5
    return gate * MAP_STEPS + step.astype(np.int32)


def run_worth(right: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """Log odds that a guessed bit is right, per following predictor, depth and bin of sightings."""
    return np.log((right + 0.3 + 0.4 * np.arange(RUN_BINS)) / (wrong + 0.4)).astype(np.float32)


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each stands, or the sum of its counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    if counts is not None:
        return keys[first], np.add.reduceat(counts, first)
    many = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=many[:-1])
    many[-1:] = len(keys) - first[-1:]
    return keys.take(first), many


def _best_runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each slot the triple (slot, check, byte) seen most, with its sightings less those of other bytes of that context."""
    of_context = keys >> np.uint64(8)
    contexts = np.flatnonzero(np.concatenate([[True], of_context[1:] != of_context[:-1]]))
    in_context = np.add.reduceat(counts, contexts)
    slot = keys >> np.uint64(24)
    slots = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    rank = (counts.astype(np.uint64) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64)
    best = (np.maximum.reduceat(rank, slots) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    others = in_context[np.searchsorted(contexts, best, side="right") - 1] - counts[best]
    left = np.clip(counts[best] - others, 1, 255).astype(np.uint32)
    entry = (keys[best] & np.uint64(0xFFFFFF)).astype(np.uint32)
    return slot[slots].astype(np.int64), entry << 8 | left


def _add_runs(table: np.ndarray, slot: np.ndarray, held: np.ndarray, check: np.ndarray, symbol: np.ndarray) -> None:
    """One more sighting each: it strengthens its own guess, or weakens what the slot holds (``held``) and replaces it at last.

    Sightings that meet in a slot within one block count as the last of them.
    """
    count = held & np.uint32(0xFF)
    own = check.astype(np.uint32) << np.uint32(16) | symbol.astype(np.uint32) << np.uint32(8)
    same = held ^ count == own
    weaker = np.where(count > 1, held - np.uint32(1), own | np.uint32(1))
    table[slot] = np.where(same, np.where(count < MOST, held + np.uint32(1), held), weaker)


def _states(pairs: np.ndarray) -> np.ndarray:
    """Pairs of counts in two bytes; both are halved until they fit, so that their ratio stays."""
    while len(over := np.flatnonzero(np.maximum(pairs[:, 0], pairs[:, 1]) > MOST)):
        pairs[over] >>= 1
    return (pairs[:, 1] << 8 | pairs[:, 0]).astype(np.uint16)


def _add_counts(table: np.ndarray, keys: np.ndarray) -> None:
    """Counts the keys 2 * slot + way."""
    keys, many = _summed(keys)
    # A slot's two bytes, the first of which is the low one, are the counts of its keys.
    ways = table.view(np.uint8)
    keys = keys.astype(np.int64)
    many += ways.take(keys, mode="clip")
    over = np.flatnonzero(many > MOST)
    if len(over):
        slots = np.unique(keys[over] >> 1)
        pairs = ways.reshape(-1, 2)[slots].astype(np.int64)
        for way in (0, 1):
            at = np.minimum(np.searchsorted(keys, 2 * slots + way), len(keys) - 1)
            pairs[:, way] = np.where(keys[at] == 2 * slots + way, many[at], pairs[:, way])
    ways[keys] = many.astype(np.uint8)
    if len(over):
        table[slots] = _states(pairs)


class Learner:
    """Tables, mixer and maps of one task."""

    def __init__(self, code: Code, sizes: Sizes):
        self.code, self.sizes = code, sizes
        self.nodes = [np.zeros(1 << sizes.node, np.uint16) for _ in NODES]
        self.runs = [np.zeros(1 << sizes.run, np.uint32) for _ in RUNS]
        self.weights = np.broadcast_to(FIRST_WEIGHTS, (DEPTHS, GATES, INPUTS)).copy()
        self.curvature = np.broadcast_to(FIRMNESS * np.eye(INPUTS), (DEPTHS, GATES, INPUTS, INPUTS)).copy()
        self.right, self.wrong = np.zeros((2, len(RUNS), DEPTHS, RUN_BINS))
        self.maps = np.zeros(2 * DEPTHS * GATES * MAP_STEPS)
        self.held: list[bytes] = []
        self.waiting = self.bytes = 0

    def learn(self, texts: Iterable[bytes], last: bool = False) -> None:
        """Runs along whole texts; the first blocks are short, for the weights to settle. What doesn't fill a block waits, unless it is the last."""
        for raw in texts:
            for part in units(raw):
                self.held.append(part)
                self.waiting += len(part) - LOOK_BACK
                if self.waiting >= min(BLOCK_BYTES, max(LEAST_BLOCK, self.bytes / 8)):
                    self._block()
        if last and self.held:
            self._block()

    def _block(self) -> None:
        worth = run_worth(self.right, self.wrong)
        said = [_said(w, np.ones(DEPTHS * GATES)) for w in worth]
        weights = self.weights.reshape(-1, INPUTS).astype(np.float32)
        sums = np.zeros((DEPTHS * GATES, INPUTS + 1, INPUTS + 1))
        keys: list[list[np.ndarray]] = [[] for _ in NODES]
        seen = []
        for parts in _grouped(self.held, LEARNED_BYTES):
            batch = Batch(parts, self.code)
            batch.follow(self.runs, self.sizes.run)
            self._weigh(batch, weights, said, sums, keys)
            seen.append((batch.run_slot, batch.run_held, batch.run_check, batch.symbol))
            self.bytes += len(batch.symbol)
        self.held, self.waiting = [], 0
        upper = sums[:, :-1, :-1]
        slope, new = sums[:, :-1, -1].reshape(self.weights.shape), (upper + np.triu(upper, 1).transpose(0, 2, 1)).reshape(self.curvature.shape)
        start = FIRMNESS * np.eye(INPUTS)
        self.curvature = start + KEPT * (self.curvature - start) + new
        self.weights += np.linalg.solve(self.curvature, slope[..., None])[..., 0]
        for table, own in zip(self.nodes, keys):
            _add_counts(table, np.concatenate(own))
        for r, table in enumerate(self.runs):
            _add_runs(table, *(np.concatenate(c) for c in zip(*((slots[r], held[r], checks[r], symbols) for slots, held, checks, symbols in seen))))

    def _weigh(self, batch: Batch, weights: np.ndarray, said: list[np.ndarray], sums: np.ndarray, keys: list[list[np.ndarray]]) -> None:
        """Predicts the decisions of a batch; adds to ``sums`` what a step needs and to ``keys`` what enters the tables after it."""
        batch.by_gate()
        d = batch.decisions(self.nodes, self.sizes, *batch.in_order_of_depth())
        bit = d.bit
        x = np.empty((INPUTS + 1, len(bit)), np.float32)
        for i, held in enumerate(d.held):
            ODDS.take(held, out=x[i], mode="clip")
        for r, guesses in enumerate(d.guesses):
            said[r].take(guesses, out=x[len(NODES) + r], mode="clip")
            # By level, bin, guessed bit and bit.
            guesses <<= 1
            guesses += bit
            outcome = np.bincount(guesses, minlength=4 * RUN_BINS * DEPTHS * GATES).reshape(DEPTHS, GATES, RUN_BINS, 2, 2).sum(axis=1)
            outcome[:, 0] = 0
            self.right[r] += outcome[..., 0, 0] + outcome[..., 1, 1]
            self.wrong[r] += outcome[..., 0, 1] + outcome[..., 1, 0]
        x[-2] = 1
        logit = np.empty(len(bit), np.float32)
        # Runs of bits of one gate (those beyond DEPTHS have several), short enough for caches and for one thread of the matrix library.
        short = d.gate.astype(np.int16)
        begins = np.append(0, np.flatnonzero(short[1:] != short[:-1]) + 1)
        gates = d.gate.take(begins)
        for g, begin, end in zip(gates.tolist(), begins.tolist(), [*begins[1:].tolist(), len(bit)]):
            for b in range(begin, end, 1_024):
                e = min(b + 1_024, end)
                np.matmul(weights[g], x[:-1, b:e], out=logit[b:e])
        p = probability(logit)
        root = np.sqrt(p * (1 - p))
        # Products of rows hold both the curvature (of inputs times root) and the slope (of these with the error below).
        x[:-1] *= root
        np.divide(bit - p, root, out=x[-1])
        for i, j in combinations_with_replacement(range(INPUTS + 1), 2):
            sums[:, i, j] += np.bincount(gates, np.add.reduceat(np.multiply(x[i], x[j], out=p), begins), minlength=len(sums))
        self.maps += np.bincount(_map_places(logit, d.gate) * 2 + bit, minlength=len(self.maps))
        for own, slot in zip(keys, d.slots):
            slot <<= 1
            slot += bit
            own.append(slot.astype(np.uint32))

    def segments(self) -> Iterator[tuple[int, int, bytes]]:
        """(table, segment, content) rows, the tables cut into ranges of slots; last a row of all sums."""
        for t, table in enumerate([*self.nodes, *self.runs]):
            for k, part in enumerate(np.split(table, SEGMENTS)):
                yield t, k, part.tobytes()
        weighed = (self.curvature @ self.weights[..., None])[..., 0]
        sums = [self.curvature, weighed, self.right, self.wrong, self.maps]
        yield -1, 0, np.concatenate([s.ravel() for s in sums]).tobytes()


def merged(table: int, contents: list[bytes]) -> bytes:
    """The sum of one segment of several learners."""
    if table < 0:
        return np.sum([np.frombuffer(c) for c in contents], axis=0).tobytes()
    if table < len(NODES):
        states = [np.frombuffer(c, np.uint16) for c in contents]
        return _states(np.stack([sum((x & 0xFF).astype(np.int64) for x in states), sum((x >> 8).astype(np.int64) for x in states)], axis=1)).tobytes()
    keys, counts = [], []
    for c in contents:
        entries = np.frombuffer(c, np.uint32)
        slot = np.flatnonzero(entries).astype(np.uint64)
        held = entries[slot.astype(np.int64)].astype(np.uint64)
        keys.append(slot << np.uint64(24) | held >> np.uint64(8))
        counts.append((held & np.uint64(0xFF)).astype(np.int64))
    out = np.zeros(len(contents[0]) // 4, np.uint32)
    if sum(map(len, keys)):
        slots, entries = _best_runs(*_summed(np.concatenate(keys), np.concatenate(counts)))
        out[slots] = entries
    return out.tobytes()


def finished(table: int, content: bytes) -> bytes:
    """A merged segment as a model holds it."""
    return _ROUNDED[np.frombuffer(content, np.uint16)].tobytes() if 0 <= table < len(NODES) else content


@dataclass
class Model:
    code: Code
    sizes: Sizes
    tables: list[np.ndarray]
    weights: np.ndarray
    worth: np.ndarray
    maps: np.ndarray

    @staticmethod
    def of(code: Code, sizes: Sizes, segments: dict[tuple[int, int], bytes]) -> Model:
        """From merged and finished segments; each learner's weights count by its curvature."""
        tables = []
        for t in range(len(NODES) + len(RUNS)):
            parts = sorted(k for k in segments if k[0] == t)
            content = b"".join(segments.pop(k) for k in parts)
            tables.append(np.frombuffer(content, np.uint8 if t < len(NODES) else np.uint32))
        shapes = [(DEPTHS, GATES, INPUTS, INPUTS), (DEPTHS, GATES, INPUTS), *[(len(RUNS), DEPTHS, RUN_BINS)] * 2, (DEPTHS * GATES * MAP_STEPS, 2)]
        sums, at, arrays = np.frombuffer(segments[-1, 0]), 0, []
        for shape in shapes:
            size = int(np.prod(shape))
            arrays.append(sums[at : at + size].reshape(shape))
            at += size
        curvature, weighed, right, wrong, seen = arrays
        weights = np.linalg.solve(curvature, weighed[..., None])[..., 0]
        centre = 1 / (1 + np.exp(-(np.arange(MAP_STEPS) / 2 - 8)))
        maps = (seen[:, 1] + np.tile(8 * centre, DEPTHS * GATES)) / (seen.sum(axis=1) + 8)
        return Model(code, sizes, tables, weights.astype(np.float32), run_worth(right, wrong), maps.astype(np.float32))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        weights = model.weights.reshape(DEPTHS * GATES, INPUTS)
        #: Weights of what counting tables hold (see ROUND_ODDS) and of the bias, and what following predictors say, weighed.
        self.node_weights = [np.ascontiguousarray(weights[:, i]) / 16 for i in range(len(NODES))]
        self.bias = np.ascontiguousarray(weights[:, -1])
        self.said = [_said(w, weights[:, len(NODES) + r]) for r, w in enumerate(model.worth)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        out, held, owners, size = np.zeros(len(texts)), [], [], 0
        for i, raw in enumerate(texts):
            parts = list(units(raw))
            if len(parts) > 1:
                follower = Follower(1)
                out[i] = sum(self._batch([part], follower, part is not parts[-1])[0] for part in parts)
                continue
            held += parts
            owners.append(i)
            size += len(raw)
            if size >= SCORED_BYTES:
                out[owners] = self._batch(held, Follower(len(held)))
                held, owners, size = [], [], 0
        if held:
            out[owners] = self._batch(held, Follower(len(held)))
        return out

    def _batch(self, parts: list[bytes], follower: Follower, more: bool = False) -> np.ndarray:
        """Prices of units; ``more`` of their texts may follow."""
        model = self.model
        batch = Batch(parts, model.code)
        batch.follow(model.tables[len(NODES) :], model.sizes.run)
        d = batch.decisions(model.tables, model.sizes, *batch.in_text_order())
        # The bias belongs to the first group.
        logits = np.zeros((GROUPS, len(d.bit)), np.float32)
        self.bias.take(d.gate, out=logits[0], mode="clip")
        x = np.empty(len(d.bit), np.float32)
        for group, held, weights in zip(GROUP_OF.tolist(), d.held, self.node_weights):
            weights.take(d.gate, out=x, mode="clip")
            x *= held.astype(np.float32) - np.float32(128)
            logits[group] += x
        for group, guesses, said in zip(GROUP_OF[len(NODES) :].tolist(), d.guesses, self.said):
            logits[group] += said.take(guesses, out=x, mode="clip")
        ends = batch.until[np.cumsum(batch.bytes_of) - 1]
        logit, p = follower.follow(logits, d.bit, ends, more)
        p += (model.maps.take(_map_places(logit, d.gate), mode="clip") - p) / 4
        # What the bit that came was given.
        p -= 1 - d.bit
        np.abs(p, out=p)
        np.maximum(p, np.float32(1e-6), out=p)
        return np.add.reduceat(np.log(p, out=p), np.append(0, ends[:-1]), dtype=float) / np.log(10)


class Follower:
    """The weights of the groups along texts that are followed side by side."""

    def __init__(self, texts: int) -> None:
        self.weights = np.ones((texts, GROUPS), np.float32)
        self.curvature = np.broadcast_to(TEXT_FIRMNESS * np.eye(GROUPS), (texts, GROUPS, GROUPS)).copy()
        self.steps = 0

    def follow(self, logits: np.ndarray, bit: np.ndarray, ends: np.ndarray, more: bool) -> tuple[np.ndarray, np.ndarray]:
        """Mixes the next bits of the texts, each step with weights that know the bits before it: log odds and probabilities.

        None are learned behind a text's last bits, so the texts that go on all have a step of one length.
        """
        out, told = np.empty((2, len(bit)), np.float32)
        begins, texts = np.append(0, ends[:-1]), np.arange(len(ends))
        while len(texts):
            step = STEPS[min(self.steps, len(STEPS) - 1)]
            self.steps += 1
            stops = np.minimum(begins + step, ends)
            on = more | (stops < ends)
            for text, b, e in zip(texts[~on].tolist(), begins[~on].tolist(), stops[~on].tolist()):
                out[b:e] = _mixed(self.weights[text], logits[:, b:e])
                told[b:e] = probability(out[b:e])
            texts, begins, ends, stops = texts[on], begins[on], ends[on], stops[on]
            if not len(texts):
                break
            spans = [slice(b, e) for b, e in zip(begins.tolist(), stops.tolist())]
            x = np.stack([logits[:, s] for s in spans], axis=1)
            own = _mixed(self.weights[texts].T[..., None], x)
            p = probability(own)
            for s, mixed, chance in zip(spans, own, p):
                out[s], told[s] = mixed, chance
            error, bend = np.stack([bit[s] for s in spans]) - p, p * (1 - p)
            slope, new = np.empty((len(texts), GROUPS)), np.empty((len(texts), GROUPS, GROUPS))
            for i in range(GROUPS):
                slope[:, i] = np.multiply(x[i], error, out=p).sum(axis=1)
                bent = x[i] * bend
                for j in range(i, GROUPS):
                    new[:, i, j] = new[:, j, i] = np.multiply(bent, x[j], out=p).sum(axis=1)
            self.curvature[texts] += new
            self.weights[texts] += np.linalg.solve(self.curvature[texts], slope[..., None])[..., 0].astype(np.float32)
            texts, begins, ends = (a[stops < ends] for a in (texts, stops, ends))
        return out, told


def _mixed(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The weighed sum of the rows, always in their order, so that it doesn't depend on where a text lies in its batch."""
    out = rows[0] * weights[0]
    for row, weight in zip(rows[1:], weights[1:]):
        out += row * weight
    return out
