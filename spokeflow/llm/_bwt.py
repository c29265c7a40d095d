"""Common prefixes from a Burrows-Wheeler transform, in order of length, up to a bound."""

from __future__ import annotations

import numpy as np

PACKED = 7  # symbols of nine bits in a sort key


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, dense rank, and whether a place in the order starts a new rank."""
    order = np.argsort(key)
    s = key[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank, new


def repeated(symbols: np.ndarray, length: int) -> np.ndarray:
    """For each place of a cyclic text whether the `length` symbols from there also start elsewhere.

    Symbols are 0 to 511. Rotations are sorted by their first `length` symbols by doubling. Groups of equal
    first PACKED symbols are the first intervals. An interval of a string w, taken breadth first, yields
    the interval of cw for each symbol c before it; cw's end is a boundary of common prefix |w| if no shorter one
    was found there, and only then is cw extended further. So each boundary is set once, by increasing value,
    and extension stops at `length`: boundaries still unset have a common prefix of at least that.
    """
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for i in range(min(PACKED, length)):
        key = key << 9 | np.roll(symbols, -i)
    order, rank, new = _ranked(key)
    first = np.flatnonzero(new)
    depth = min(PACKED, length)
    known = np.ones(n + 1, bool)  # boundaries whose common prefix is below the strings' length
    known[:-1] = new
    if depth == length:
        return _beside(known, order)
    h = depth
    while h < length and len(first) < n:
        order, rank, new = _ranked(rank * n + np.roll(rank, -h))
        if new.all():
            break
        h *= 2
    bwt = symbols[order - 1]
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)
    lb, rb = first, np.append(first[1:], n)
    for _ in range(depth, length):
        size = rb - lb
        one = size == 1
        start = [lf[lb[one]]]
        end = [start[0] + 1]
        lb, size = lb[~one], size[~one]
        if len(lb):
            ahead = np.cumsum(size)
            at = np.repeat(lb - ahead + size, size) + np.arange(ahead[-1])
            code = np.repeat(np.arange(len(lb)) << 9, size) | bwt[at]
            by = np.argsort(code, kind="stable")
            s = code[by]
            cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            start.append(lf[at[by[cut]]])
            end.append(start[1] + np.diff(np.append(cut, len(s))))
        lb, rb = np.concatenate(start), np.concatenate(end)
        fresh = ~known[rb]
        lb, rb = lb[fresh], rb[fresh]
        if not len(lb):
            break
        known[rb] = True
    return _beside(known, order)


def _beside(known: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), bool)
    out[order] = ~known[:-1] | ~known[1:]
    return out
