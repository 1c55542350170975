"""Hashes of words and word windows over whole blocks of texts, in numpy.

A hash is a polynomial over the bytes of a word (or the hashes of the words in a window) modulo 2**64, read off running
sums, and mixed at the end. Two seeds give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at a time; one longer text is a block of its own.
BLOCK = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, n)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        have = _powers[base] = (made[0], made[1])
        if size > 4 * BLOCK:
            del _powers[base]  # a very long text; not kept
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


class Words:
    """The words of a block of texts: byte bounds, the text each belongs to, and hashes."""

    def __init__(self, texts: list[bytes], seed: int = 1):
        self.n_texts = len(texts)
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = ~SPACE[raw]
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[::2], edges[1::2]
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        text_ends = np.cumsum(lengths)
        self.text = np.searchsorted(text_ends, self.starts, side="right")
        #: First word of each text, and one more.
        self.first = np.searchsorted(self.text, np.arange(self.n_texts + 1))
        self.raw = raw
        self.hashes = self.hashed(seed)

    def hashed(self, seed: int) -> np.ndarray:
        """One hash per word."""
        table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        base = int(table[0]) | 1
        sums, down = _sums(table[self.raw], base)
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def windows(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of k words that stays in one text."""
        h = self.hashes if hashes is None else hashes
        n = len(h)
        if n < k:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        sums, down = _sums(h, 0x9E3779B97F4A7C15)
        at = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1 :])
        return at, mix((sums[at + k] - sums[at]) * down[at] + np.uint64(k))


def blocks(texts: Iterable[bytes], most: int = BLOCK) -> Iterator[list[bytes]]:
    """Texts in order, in lists of about `most` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
