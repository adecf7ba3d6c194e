"""Word splitting on UTF-8 bytes.

Both word classes of the contracts treat every non-ASCII character as part of a
word, and only A-Z change case, so they can be decided byte by byte.
"""

from __future__ import annotations

import numpy as np

_SPLIT_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty, lone surrogates become '?'."""
    return text.encode("utf-8", "replace") if text else b""


def spaced_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) maximal runs of ``[^\\x20\\x09-\\x0D]``."""
    return utf8(text).lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    return utf8(text).translate(_SPLIT_ALNUM).split()


_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the factor and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < length:
        size = 1 << max(16, (length - 1).bit_length())
        for name, base in (("up", _FACTOR), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:length], _POWERS["down"][:length]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words (the whole sequence, if shorter), sorted, distinct."""
    if not words:
        return np.empty(0, np.uint64)
    text = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    up, down = _powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[text] * up[:-1], out=sums[1:])
    width = min(width, len(words))
    first, last = starts[: len(words) - width + 1], ends[width - 1 :]
    return np.unique(scramble((sums[last] - sums[first]) * down[first]))
