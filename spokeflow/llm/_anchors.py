"""Anchors that cut a text's fixed-length windows into classes that can be compared apart.

Every window of `length` bytes has one anchor: among its runs of `k` bytes the one of the smallest hash, the
leftmost on ties. Windows with equal bytes have equal anchors at equal places, so comparing windows of
equal anchors loses no equal pair. The windows of one anchor start side by side and form a segment.
"""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse modulo 2^64, n of each at least."""
    size = 1 << max(10, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = _STEP, inverse
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def run_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k bytes."""
    n = len(raw)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= _ODD
    h ^= h >> np.uint64(32)
    return h


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every run of w values, by prefix and suffix minima of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Segments of the texts raw[starts[i]:ends[i]]: text, first window, windows, anchor hash, content hash.

    `raw` holds under 2^24 bytes, which is the room that positions have beside a hash; a longer text is
    taken by `long_segments`.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none
    h = run_hashes(raw, k)
    place = np.arange(len(h), dtype=np.uint64)
    packed = (h & ~np.uint64(0xFFFFFF)) | place
    anchor = (sliding_least(packed, length - k + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    # windows that lie in one text, then runs of windows with one anchor
    inside = np.maximum(ends - starts - length + 1, 0)
    text = np.repeat(np.arange(len(starts)), inside)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(inside)[:-1])), inside) + np.arange(len(text))
    a = anchor[first]
    if not len(a):
        return none, none, none, none, none
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (text[1:] != text[:-1]))))
    windows = np.diff(np.append(new, len(a)))
    at = first[new]
    data, digest = raw.tobytes(), xxhash.xxh3_64_intdigest
    stop = (at + windows + length - 1).tolist()
    content = np.array([digest(data[p:q]) for p, q in zip(at.tolist(), stop)], np.uint64).view(np.int64)
    return text[new], at - starts[text[new]], windows, h[a[new]].view(np.int64), content


def long_segments(raw: np.ndarray, length: int, k: int, piece: int = 1 << 23):
    """`segments` of one text of any length: overlapping pieces; a segment that a cut would split is taken whole.

    A cut window's anchor is found in any piece that holds the window, so segments of neighbouring
    pieces join where the anchors agree; their content hash is taken over the joined bytes.
    """
    found: list[list[int]] = []  # first window, windows, anchor hash, anchor position
    for lo in range(0, max(1, len(raw) - length + 1), piece):
        part = raw[lo : lo + piece + length - 1]
        h = run_hashes(part, k)
        packed = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        a = (sliding_least(packed, length - k + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        rows = zip((new + lo).tolist(), np.diff(np.append(new, len(a))).tolist(), h[a[new]].view(np.int64).tolist(), (a[new] + lo).tolist())
        for row in map(list, rows):
            if found and found[-1][3] == row[3]:
                found[-1][1] += row[1]
            else:
                found.append(row)
    data, digest = raw.tobytes(), xxhash.xxh3_64_intdigest
    content = np.array([digest(data[r[0] : r[0] + r[1] + length - 1]) for r in found], np.uint64).view(np.int64)
    cols = np.array(found, np.int64)
    return np.zeros(len(found), np.int64), cols[:, 0], cols[:, 1], cols[:, 2], content
