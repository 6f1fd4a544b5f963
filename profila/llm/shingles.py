"""Word and shingle hashes of whole texts, vectorised over the UTF-8 bytes.

Words are runs of bytes other than space and tab to carriage return; A-Z count as a-z. A word's
hash is the wrapped sum of a random number per byte times an odd power per place, finally mixed.
"""

from __future__ import annotations

import numpy as np

# Fixed: multipliers of the 64-bit finaliser and of places and words.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
PLACE = np.uint64(0x9E3779B97F4A7C15)
WORD = np.uint64(0xD6E8FEB86659FD93)
BLOCK = 1 << 22

_BYTES = np.random.default_rng(20_240_611).integers(0, 1 << 64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * MIX[0]
    x = (x ^ x >> np.uint64(27)) * MIX[1]
    return x ^ x >> np.uint64(31)


def _place_powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers), 64), PLACE)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def _block_hashes(raw: np.ndarray) -> np.ndarray:
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    codes = _BYTES[raw[place + np.repeat(starts, lengths)]]
    sums = np.add.reduceat(codes * _place_powers(int(lengths.max()))[place], first)
    return mixed(sums + lengths.astype(np.uint64) * WORD)


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word; long texts are read in blocks cut at white space."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= BLOCK:
        return _block_hashes(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw):
            ahead = np.flatnonzero(_SPACE[raw[end : end + BLOCK]])
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(end + BLOCK, len(raw))
        out.append(_block_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words; fewer words form one shingle, none an empty set."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        out = mixed(out * PLACE + words[i : len(words) - width + 1 + i])
    return np.unique(out)
