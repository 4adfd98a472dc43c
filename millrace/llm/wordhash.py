"""Words of whole texts as 64-bit hashes, in numpy over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SLICE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _random_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
EXACT = _random_table(20)
EXACT[SPACES] = 0
#: A-Z hash like a-z.
LOWER = EXACT.copy()
LOWER[65:91] = LOWER[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(texts: Sequence[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a space after each text, and where each text starts (plus the end)."""
    raw = [b"" if x is None else x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw], dtype=np.int64)])
    return np.frombuffer(b" ".join(raw) + b" ", np.uint8) if raw else np.zeros(0, np.uint8), offsets


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers from 0 on below n, modulo 2^64, as products: the i-th is high[i // 1024] * low[i % 1024]."""
    low = np.full(1025, base, np.uint64)
    low[0] = 1
    np.multiply.accumulate(low, out=low)
    high = np.full(n // 1024 + 1, low[1024], np.uint64)
    high[0] = 1
    np.multiply.accumulate(high, out=high)
    return low[:1024], high


def _slice_words(buf: np.ndarray, table: np.ndarray, kinds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~SPACES[buf]
    first, last = np.empty(len(buf) + 1, bool), np.empty(len(buf) + 1, bool)
    first[0], first[-1], last[0], last[-1] = inside[0], False, False, inside[-1]
    np.greater(inside[1:], inside[:-1], out=first[1:-1])
    np.less(inside[1:], inside[:-1], out=last[1:-1])
    if kinds is not None:  # a word also ends between bytes of kinds 1 and 2
        kind = kinds[buf]
        cut = kind[1:] + kind[:-1] == 3
        first[1:-1] |= cut
        last[1:-1] |= cut
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    # powers count from the slice's first word; each word's sum is then divided by the power at its start
    at = starts - starts[0]
    terms = table[buf[starts[0] :]]  # spaces are 0
    low, high = _powers(_ODD, len(terms))
    whole = len(terms) // len(low) * len(low)
    terms[:whole].reshape(-1, len(low))[:] *= high[: whole // len(low), None] * low
    terms[whole:] *= high[whole // len(low)] * low[: len(terms) - whole]
    low, high = _powers(_INVERSE, len(terms))
    h = np.add.reduceat(terms, at) * low[at % len(low)] * high[at // len(low)]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * _ODD)


def words(buf: np.ndarray, table: np.ndarray = LOWER, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in the buffer, in order; works slice by slice to bound memory. kinds: of
    each byte; words are also cut between neighbours of kinds 1 and 2 (all other bytes: 0 or 3 and more)."""
    found, a = [], 0
    while a < len(buf):
        b = min(len(buf), a + SLICE)
        while b < len(buf):  # a slice ends after a space
            gap = np.flatnonzero(SPACES[buf[b : b + 4096]])
            if len(gap):
                b += int(gap[0]) + 1
                break
            b += 4096
        b = min(b, len(buf))
        s, e, h = _slice_words(buf[a:b], table, kinds)
        found.append((s + a, e + a, h))
        a = b
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of each text's words in the word arrays."""
    return np.searchsorted(starts, offsets)


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles; fewer words than width make one shingle."""
    n = len(hashes)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + hashes[k : n - width + 1 + k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for x in hashes[a:b]:
                whole = mix(whole * np.uint64(3) + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
