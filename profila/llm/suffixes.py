"""Suffix arrays by induced sorting, and permuted common prefixes.

A suffix is S if it is smaller than the one after it, else L; an S right of an L is leftmost-smaller
(LMS). The substrings from one LMS place to the next are sorted by inducing and named; where names
repeat, the suffixes of the string of names are sorted by doubling. The LMS suffixes' order then
induces that of all suffixes. Bytes are induced a bucket at a time, in time linear in the text; the names,
at most half as many, are sorted once per doubling of the longest repeat.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 1


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of ``parts``, a separator after each and a last 0; and the place where each part begins.

    Bytes are renumbered from 2 in their order.
    """
    raw = np.frombuffer(b"".join(parts), np.uint8)
    present = np.unique(raw)
    number = np.zeros(256, np.int32)
    number[present] = np.arange(2, 2 + len(present))
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.full(len(raw) + len(parts) + 1, SEPARATOR, np.int32)
    text[np.arange(len(raw)) + np.repeat(np.arange(len(parts)), sizes)] = number[raw]
    text[-1] = 0
    return text, begin


def _smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are S; the last one counts as S."""
    sign = np.append(np.sign(text[1:] - text[:-1]), 1)
    decided = np.where(sign != 0, np.arange(len(text)), len(text))
    return sign[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def _dealt(found: np.ndarray, text: np.ndarray, wanted: np.ndarray, edge: np.ndarray, step: int, out: np.ndarray) -> None:
    """Put the ``wanted`` predecessors of ``found`` at the edges of their buckets, in order."""
    before = found[found > 0] - 1
    before = before[wanted[before]]
    if not len(before):
        return
    symbols = text[before]
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    before, symbols = before[order], symbols[order]
    counts = np.bincount(symbols, minlength=len(edge))
    within = np.arange(len(symbols)) - (np.cumsum(counts) - counts)[symbols]
    out[edge[symbols] + step * within - (step < 0)] = before
    edge += step * counts


def _induced(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, from LMS places whose order within each bucket is given."""
    counts = np.bincount(text)
    end = np.cumsum(counts)
    begin = end - counts
    large_end = begin + np.bincount(text[~small], minlength=len(counts))
    out = np.full(len(text), -1, np.int32)
    symbols = text[lms]
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    lms, symbols = lms[order], symbols[order]
    lms_counts = np.bincount(symbols, minlength=len(counts))
    lms_begin = end - lms_counts
    out[lms_begin[symbols] + np.arange(len(lms)) - (np.cumsum(lms_counts) - lms_counts)[symbols]] = lms
    edge = begin.copy()
    for c in range(len(counts)):
        at = begin[c]
        while at < edge[c]:
            at, before = edge[c], at
            _dealt(out[before:at], text, ~small, edge, 1, out)
        _dealt(out[lms_begin[c] : end[c]], text, ~small, edge, 1, out)
    edge = end.copy()
    for c in reversed(range(len(counts))):
        at = end[c]
        while at > edge[c]:
            at, before = edge[c], at
            _dealt(out[at:before][::-1], text, small, edge, -1, out)
        _dealt(out[begin[c] : large_end[c]][::-1], text, small, edge, -1, out)
    out[0] = len(text) - 1
    return out


def _named(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in the order of the text; ``ranked`` has the places by substring."""
    size = np.zeros(len(text), np.int64)
    size[lms] = np.append(np.diff(lms) + 1, 1)
    one, two = ranked[:-1], ranked[1:]
    differs = size[one] != size[two]
    asked = np.flatnonzero(~differs)
    for at in range(int(size.max())):
        asked = asked[size[one[asked]] > at]
        if not len(asked):
            break
        other = text[one[asked] + at] != text[two[asked] + at]
        differs[asked[other]] = True
        asked = asked[~other]
    name = np.zeros(len(text), np.int64)
    name[ranked] = np.concatenate(([0], np.cumsum(differs)))
    return name[lms], int(differs.sum()) + 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``text`` in order; its last symbol is its only 0."""
    small = _smaller(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(text) == 1 or not len(lms):
        return np.arange(len(text))[::-1]
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    ranked = _induced(text, small, lms)
    names, different = _named(text, lms, ranked[is_lms[ranked]])
    order = np.argsort(names) if different == len(names) else _sorted_names(names)
    return _induced(text, small, lms[order])


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Places of the suffixes of a string of names in order, by the ranks of 1, 2, 4 ... names; the last is the only 0."""
    n, width, rank = len(names), 1, names.astype(np.int64)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        differs = np.diff(key[order]) > 0
        if differs.all():
            return order
        rank[order] = np.concatenate(([0], np.cumsum(differs)))
        width = min(2 * width, n)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Per place of the order but the first: symbols in common with the one before, up to a separator.

    Prefixes are found by place in the text: where the symbols before two neighbours agree, the
    prefix is one shorter than that of the place before; only the others are compared.
    """
    n = len(text)
    before = np.zeros(n, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    held = (place > 0) & (before > 0) & (text[place - 1] == text[before - 1]) & (text[place - 1] > SEPARATOR)
    held[order[0]] = False
    asked = np.flatnonzero(~held)
    asked = asked[asked != order[0]]
    length = np.zeros(n, np.int64)
    size = 0
    while len(asked):
        here = text[asked + size]
        asked = asked[(here == text[before[asked] + size]) & (here > SEPARATOR)]
        size += 1
        length[asked] = size
    last = np.maximum.accumulate(np.where(held, 0, place))
    length = np.where(text > SEPARATOR, length[last] - (place - last), 0)
    return length[order[1:]]
