"""Long repeats from a Burrows-Wheeler transform by interval expansion bounded by a minimum length."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse by prefix doubling; symbols are below 2**32 - 1 and the last is unique."""
    n = len(text)
    width = 4 if text.max() < (1 << 16) - 1 else 2
    padded = np.concatenate([text, np.zeros(width - 1, text.dtype)]).astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = key << np.uint64(64 // width) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's first place is its rank
    rank = np.empty(n, np.int64)
    rank[order] = first
    while True:
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order, rank
        at = order[open_]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        k = np.argsort(rank[at] * np.int64(n + 1) + after, kind="stable")
        at, after = at[k], after[k]
        order[open_] = at
        own = rank[at]
        split = np.ones(len(at), bool)
        split[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        new[open_] = split
        rank[at] = np.maximum.accumulate(np.where(split, open_, 0))
        width *= 2


def repeated_starts(text: np.ndarray, least: int, whose: np.ndarray | None = None) -> np.ndarray:
    """Where a string of ``least`` symbols starts that also starts elsewhere in text; with whose, at a place of another.

    Breadth first from the empty string: the intervals of all strings of one length are extended to the
    left through the transform (the last-to-first map), and each new interval end that has no common
    prefix length yet gets that length, so the values come in increasing order. The search stops at
    ``least``: suffix neighbours without a value by then share at least so many symbols.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, bool)
    order, rank = suffix_order(text)
    lf = rank[order - 1]  # the suffix one symbol longer; the whole text's predecessor is its last symbol
    last = text[order - 1]
    unknown = np.ones(n + 1, bool)
    unknown[[0, n]] = False
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(least):
        one = low == high
        to = lf[low[one]]  # an interval of one suffix has one extension
        to = to[unknown[to + 1]]
        low, high = low[~one], high[~one]
        many = high - low + 1
        owner = np.repeat(np.arange(len(low)), many)
        inside = np.arange(len(owner)) + np.repeat(low - np.cumsum(many) + many, many)
        into = lf[inside]
        k = np.argsort(into, kind="stable")
        into, owner, symbol = into[k], owner[k], last[inside[k]]
        ends = np.ones(len(into), bool)
        ends[:-1] = (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        high = np.flatnonzero(ends)
        low = np.append(0, high[:-1] + 1) if len(high) else high
        low, high = into[low], into[high]
        fresh = unknown[high + 1]
        low, high = np.append(low[fresh], to), np.append(high[fresh], to)
        if not len(low):
            break
        unknown[high + 1] = False
    out = np.zeros(n, bool)
    if whose is None:
        out[order[unknown[:-1] | unknown[1:]]] = True
        return out
    first = np.flatnonzero(~unknown[:-1])  # suffixes from one of these to the next share ``least`` symbols
    own = whose[order]
    several = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
    out[order[np.repeat(several, np.diff(np.append(first, n)))]] = True
    return out


def repeated(flat: np.ndarray, sizes: np.ndarray, least: int, owners: np.ndarray | None = None) -> np.ndarray:
    """The masks of repeated_in, one after another, for pieces of the given sizes that follow each other in flat, as small numbers."""
    ends = np.cumsum(sizes + 1)
    inside = np.ones(ends[-1], bool)
    inside[ends - 1] = False
    text = np.empty(ends[-1], np.int64)
    text[inside] = flat.astype(np.int64) + len(sizes)
    text[~inside] = np.arange(len(sizes))
    return repeated_starts(text, least, None if owners is None else np.repeat(owners, sizes + 1))


def numbered(flat: np.ndarray) -> np.ndarray:
    """The symbols as small numbers; bytes are such already."""
    return flat if flat.dtype == np.uint8 else np.unique(flat, return_inverse=True)[1]


def repeated_in(pieces: list[np.ndarray], least: int, owners: np.ndarray | None = None) -> list[np.ndarray]:
    """For each piece, a mask of the places where a string of ``least`` symbols starts that starts elsewhere too.

    Elsewhere is another place of the same or of any other piece; with owners (a number per piece), a piece of
    another owner. Strings do not cross pieces, which end in marks of their own.
    """
    sizes = np.array([len(p) for p in pieces])
    return np.split(repeated(numbered(np.concatenate(pieces)), sizes, least, owners), np.cumsum(sizes + 1)[:-1])
