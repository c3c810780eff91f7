"""Vectorised word, window and shingle hashes over whole texts.

A text is UTF-8 bytes; a word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Prefix sums of
table[byte] * base**position (mod 2**64) give the hash of any run of bytes as one subtraction, which is the
Rabin-Karp idea; the same sums over word hashes give the hash of any window of words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
WINDOW_BASE = U(0xD1342543DE82EF95)


def fmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser of a public hash)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def inverse(odd: np.uint64) -> np.uint64:
    return U(pow(int(odd), -1, 1 << 64))


class Powers:
    """Powers of an odd base and of its inverse mod 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base = base
        self.clear()

    def clear(self) -> None:
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (self.base, inverse(self.base)))
        return self.up, self.down


BYTES, WORDS = Powers(BASE), Powers(WINDOW_BASE)
TABLE = fmix(np.arange(1, 257, dtype=U) * BASE)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, each text's first word (one more at the end), and byte bounds of the words in b' '.join(texts)."""
    a = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        a = LOWER[a]
    space = SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = BYTES.get(len(a) + 1)
    sums = np.zeros(len(a) + 1, U)
    np.cumsum(TABLE[a] * up[: len(a)], out=sums[1:])
    hashes = fmix((sums[ends] - sums[starts]) * down[starts])
    bounds = np.cumsum([0] + [len(x) + 1 for x in texts])
    return hashes, np.searchsorted(starts, bounds), starts, ends


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position of one text; of all words together where there are fewer."""
    n = len(hashes)
    if not n:
        return np.zeros(0, U)
    k = min(k, n)
    out = np.full(n - k + 1, U(k * int(BASE) % (1 << 64)), U)
    for j in range(k):
        out = (out ^ hashes[j : n - k + 1 + j]) * WINDOW_BASE
        out ^= out >> U(32)
    return fmix(out)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each window of width words of one text; empty if the text is shorter."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U)
    up, down = WORDS.get(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return fmix((sums[width:] - sums[: n - width + 1]) * down[: n - width + 1])
