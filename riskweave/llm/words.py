"""Words and word hashes of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Everything in ASCII but letters and digits; bytes of longer characters count as letters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Words(NamedTuple):
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # one past its last byte
    bounds: np.ndarray  # text i has words bounds[i] to bounds[i + 1]


def find_words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes outside ``gap``; a word never crosses the end of a text."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(len(offsets), np.int64))
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = inside[at[:-1]]
    starts, ends = at[:-1][keep], at[1:][keep]
    return Words(starts, ends, np.searchsorted(starts, offsets))


#: Bytes that one pass of the word hashes covers: the tables of powers have this length.
SPAN = 1 << 21


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(SPAN, _BASE), np.full(SPAN, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial by differences of running sums, then mixed.
    Of a word longer than ``SPAN`` the hashes of its parts are mixed in turn, so memory is bounded."""
    out = np.zeros(len(words.starts), np.uint64)
    up, down = _powers()
    at = 0
    while at < len(out):
        low = int(words.starts[at])
        to = int(np.searchsorted(words.ends, low + SPAN, "right"))
        if to == at:  # longer than the span
            parts = [low + k for k in range(0, int(words.ends[at]) - low, SPAN)]
            for s, e in zip(parts, [*parts[1:], int(words.ends[at])]):
                part = np.sum((data[s:e].astype(np.uint64) + np.uint64(1)) * down[: e - s], dtype=np.uint64)
                out[at] = mix(out[at : at + 1] * _BASE + part)[0]
            at += 1
            continue
        high = int(words.ends[to - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * down[: high - low], out=total[1:])
        starts, ends = words.starts[at:to] - low, words.ends[at:to] - low
        out[at:to] = mix((total[ends] - total[starts]) * up[starts] + (ends - starts).astype(np.uint64))
        at = to
    return out


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row and their bounds by text; a shorter text is one shingle."""
    counts = np.diff(bounds)
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(counts)), n)
    first = bounds[text] + np.arange(at[-1]) - at[text]
    last = bounds[text + 1]
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        inside = first + k < last
        step = np.where(inside, hashes[np.minimum(first + k, len(hashes) - 1)], np.uint64(k)) if len(hashes) else out
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + step
    return mix(out), at


def majority_bits(hashes: np.ndarray, bounds: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """SimHash: bit i is 1 if set in over half of a text's hashes; zero for none."""
    n = np.diff(bounds)
    ones = np.zeros((len(n), 64), np.int64)
    full = np.flatnonzero(n)
    for low in range(0, len(hashes), step):  # few hashes at a time: 64 bytes each
        part = hashes[low : low + step]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = full[(bounds[full + 1] > low) & (bounds[full] < low + len(part))]
        ones[rows] += np.add.reduceat(bits, np.maximum(bounds[rows] - low, 0), axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little")
    return packed.view("<u8").ravel().astype(np.uint64)
