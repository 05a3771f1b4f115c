"""Vectorised work on batches of texts: code points, character classes, pieces, hashes."""

from __future__ import annotations

import ctypes
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER, EDGE = 0, 1, 2, 3, 4
#: Code points that Unicode calls White_Space (fixed values).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points worked on at a time, unless one text is longer.
CHUNK = 250_000


@lru_cache(1)
def char_class() -> np.ndarray:
    """The class of each code point; NUL is EDGE, which stands between texts."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE] = SPACE
    table[0] = EDGE
    return table


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK code points in all; a longer text stands alone."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield start, k
            start, held = k, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with NUL before each and at the end, and the index of each text's first code point.

    A NUL inside a text is replaced by U+FFFF, a noncharacter of the same class as other symbols.
    """
    joined = "\0" + "\0".join(t.replace("\0", "￿") if "\0" in t else t for t in texts) + "\0"
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1] if texts else np.zeros(0, dtype=np.int64)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts.astype(np.int64)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on, beside others on the same executor."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Hasher:
    """64-bit hashes of slices of a code point array: sum of mix[c] * B ** k modulo 2 ** 64, finished by a mixer."""

    def __init__(self) -> None:
        r = np.random.default_rng(20_240_229)
        self.mix = r.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(m - 1, self.base))), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(m - 1, self.inverse))), dtype=np.uint64)

    def slices(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(codes) + 1)
        with np.errstate(over="ignore"):
            high = codes >> np.uint32(16)
            vals = self.mix[codes & np.uint32(0xFFFF)]
            if high.any():
                vals = vals + self.mix[high] * np.uint64(0xD6E8FEB86659FD93) * (high > 0)
            run = np.concatenate(([np.uint64(0)], np.cumsum(vals * self.up[: len(codes)], dtype=np.uint64)))
            return mixed((run[ends] - run[starts]) * self.down[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return h ^ (h >> np.uint64(32))


def bpe_pieces(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that byte-level BPE encodes apart: contractions, an optional space before letters,
    numbers or symbols, and white space, whose last character goes with what follows if it is a space."""
    kind = char_class()[codes]
    before, after = np.concatenate(([EDGE], kind[:-1])), np.concatenate((kind[1:], [EDGE]))
    first = kind != before
    space = codes == 32
    glued = np.concatenate(([False], space[:-1])) & (kind != SPACE) & (kind != EDGE)
    first &= ~glued
    # the last white space before something else stands alone, or leads the next piece
    first |= (kind == SPACE) & (after != SPACE) & (after != EDGE)
    for p in np.flatnonzero((codes == 39) & first & (after == LETTER)):
        word = "".join(map(chr, codes[p + 1 : p + 3]))
        n = 2 if word[:1] in ("s", "t", "m", "d") else 3 if word in ("re", "ve", "ll") else 0
        if n:
            first[p + 1] = False
            first[p + n] = True
    starts = np.flatnonzero(first)
    ends = np.concatenate((starts[1:], [len(codes)]))
    own = kind[starts] != EDGE
    return starts[own], ends[own]
