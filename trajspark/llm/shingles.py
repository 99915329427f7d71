"""Word hashes and rolling hashes over words, for many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: An odd multiplier for rolling hashes modulo 2^64, and the constants of a 64-bit finaliser.
BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and return, as bytes."""
    return text.encode("utf-8", "surrogatepass").split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of the `length` words from every position on; the last length - 1 positions have none."""
    with np.errstate(over="ignore"):
        doubled, size, out, done = hashes, 1, None, 0
        power = BASE
        while True:
            if length & size:
                if out is None:
                    out, done = doubled, size
                else:
                    n = len(hashes) - done - size + 1
                    out = out[: max(n, 0)] * power + doubled[done : done + max(n, 0)]
                    done += size
            if done == length:
                return out[: max(len(hashes) - length + 1, 0)]
            n = max(len(hashes) - 2 * size + 1, 0)
            doubled = doubled[:n] * power + doubled[size : size + n]
            power = power * power
            size *= 2


def in_chunks(texts: list[str], chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters each; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
