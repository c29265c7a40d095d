"""Signal and image routines without a relational form, in NumPy; DataFrame wrappers run them in Arrow batches."""

from __future__ import annotations

import math

import numpy as np

ROWS = 128  # windows that are taken at once
_R2 = 1 / math.sqrt(2)
_S3 = math.sqrt(3)
#: Low-pass reconstruction filters; the others follow from them.
FILTERS = {"haar": [_R2, _R2], "db2": [(1 + _S3) / (4 * math.sqrt(2)), (3 + _S3) / (4 * math.sqrt(2)), (3 - _S3) / (4 * math.sqrt(2)), (1 - _S3) / (4 * math.sqrt(2))]}


def _bank(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Low and high pass for decomposition, low and high pass for reconstruction."""
    lo = np.array(FILTERS[name])
    hi = lo[::-1] * (-1.0) ** np.arange(len(lo))
    return lo[::-1], hi[::-1], lo, hi


def max_level(n: int, name: str) -> int:
    """Levels until a signal is shorter than its filter less one."""
    f = len(FILTERS[name])
    return max(0, int(math.floor(math.log2(n / (f - 1))))) if n >= f - 1 and n > 0 else 0


def dwt(x: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """One level along the last axis; ends are mirrored with the edge repeated."""
    dlo, dhi, _, _ = _bank(name)
    f = len(dlo)
    pad = [(0, 0)] * (x.ndim - 1) + [(f - 1, f - 1)]
    e = np.pad(x, pad, mode="symmetric")
    n = x.shape[-1] + f - 1
    parts = []
    for h in (dlo, dhi):
        full = sum(h[k] * e[..., f - 1 - k : f - 1 - k + n] for k in range(f))
        parts.append(full[..., 1::2])
    return parts[0], parts[1]


def idwt(a: np.ndarray, d: np.ndarray, name: str) -> np.ndarray:
    """Inverse of dwt, of length 2 n - f + 2."""
    _, _, rlo, rhi = _bank(name)
    f, n = len(rlo), a.shape[-1]
    up = np.zeros((*a.shape[:-1], 2 * n + 2 * f))
    out = np.zeros((*a.shape[:-1], 2 * n + f - 1))
    for c, h in ((a, rlo), (d, rhi)):
        up[...] = 0
        up[..., f - 1 : f - 1 + 2 * n : 2] = c
        for k in range(f):
            out += h[k] * up[..., f - 1 - k : f - 1 - k + 2 * n + f - 1]
    return out[..., f - 2 : 2 * n]


def wavedec(x: np.ndarray, name: str = "haar", level: int | None = None) -> list[np.ndarray]:
    """Coefficients along the last axis, the coarsest approximation first, then details from coarse to fine."""
    out: list[np.ndarray] = []
    a = np.asarray(x, float)
    for _ in range(max_level(a.shape[-1], name) if level is None else level):
        a, d = dwt(a, name)
        out.insert(0, d)
    return [a, *out]


def waverec(coeffs: list[np.ndarray], name: str = "haar") -> np.ndarray:
    a = coeffs[0]
    for d in coeffs[1:]:
        a = idwt(a[..., : d.shape[-1]], d, name)
    return a


def degrouse(image: np.ndarray, name: str = "haar", level: int = 3) -> np.ndarray:
    """Images (the last two axes) rebuilt without the second detail (down the rows smooth, along them not) of any level."""
    stack, a = [], np.asarray(image, float)
    turned = lambda v: np.swapaxes(v, -1, -2)
    for _ in range(level):
        lo, hi = dwt(a, name)  # along columns, then along rows
        aa, da = map(turned, dwt(turned(lo), name))
        ad, dd = map(turned, dwt(turned(hi), name))
        stack.append((da, ad, dd))
        a = aa
    for da, ad, dd in reversed(stack):
        a = a[..., : da.shape[-2], : da.shape[-1]]
        up = lambda p, q: turned(idwt(turned(p), turned(q), name))
        a = idwt(up(a, da), up(ad * 0, dd), name)
    return a[..., : image.shape[-2], : image.shape[-1]]


def otsu(x: np.ndarray, bins: int = 256) -> float:
    """The threshold of the largest variance between classes over a histogram."""
    x = np.asarray(x, float).ravel()
    if not x.size or x.min() == x.max():
        return float(x[0]) if x.size else 0.0
    count, edge = np.histogram(x, bins)
    mid = (edge[:-1] + edge[1:]) / 2
    w1, w2 = count.cumsum().astype(float), count[::-1].cumsum()[::-1].astype(float)
    m1 = (count * mid).cumsum() / np.maximum(w1, 1)
    m2 = ((count * mid)[::-1].cumsum() / np.maximum(w2[::-1], 1))[::-1]
    return float(mid[int((w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2).argmax())])


def label(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Connected components, numbered from 1 in row order."""
    out = np.zeros(mask.shape, int)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    n = 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        out[start], stack = n, [start]
        while stack:
            r, c = stack.pop()
            for dr, dc in steps:
                y, x = r + dr, c + dc
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                    out[y, x] = n
                    stack.append((y, x))
    return out


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p)

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def convex_area(mask: np.ndarray) -> int:
    """Pixels whose centre lies in the hull of the midpoints of the region's pixel edges."""
    r, c = np.nonzero(mask)
    edges = np.concatenate([np.column_stack([r + dr, c + dc]) for dr, dc in ((-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5))])
    hull = _hull(edges)
    y, x = np.mgrid[r.min() : r.max() + 1, c.min() : c.max() + 1]
    inside = np.ones(y.shape, bool)
    for (r0, c0), (r1, c1) in zip(hull, np.roll(hull, -1, axis=0)):
        inside &= (r1 - r0) * (x - c0) - (c1 - c0) * (y - r0) >= -1e-9
    return int(inside.sum())


def perimeter(mask: np.ndarray) -> float:
    """Length of the line through the centres of border pixels (4-neighbourhood)."""
    m = np.pad(mask.astype(int), 1)
    core = m[1:-1, 1:-1] * m[:-2, 1:-1] * m[2:, 1:-1] * m[1:-1, :-2] * m[1:-1, 2:]
    border = np.pad(m[1:-1, 1:-1] - core, 1)
    side = border[:-2, 1:-1] + border[2:, 1:-1] + border[1:-1, :-2] + border[1:-1, 2:]
    corner = border[:-2, :-2] + border[:-2, 2:] + border[2:, :-2] + border[2:, 2:]
    value = border[1:-1, 1:-1] * (1 + 2 * side + 10 * corner)
    return float(_LENGTHS[value.ravel()].sum())


_LENGTHS = np.zeros(60)  # of the line at a border pixel, by the border pixels beside it
_LENGTHS[[5, 7, 15, 17, 25, 27]] = 1
_LENGTHS[[21, 33]] = math.sqrt(2)
_LENGTHS[[13, 23]] = (1 + math.sqrt(2)) / 2


PROPERTIES = [  # fixed values: names and order of region properties
    "area", "max_intensity", "solidity", "perimeter", "convex_area", "eccentricity", "orientation", "min_intensity", "major_axis_length",
    "minor_axis_length", "extent", "filled_area", "equivalent_diameter", "mean_intensity", "euler_number",
]


def _moments(r: np.ndarray, c: np.ndarray) -> tuple[float, float, float]:
    return r.var() + 1 / 12, c.var() + 1 / 12, ((r - r.mean()) * (c - c.mean())).mean()


def region(mask: np.ndarray, image: np.ndarray) -> list[float]:
    """PROPERTIES of one region."""
    r, c = np.nonzero(mask)
    n = len(r)
    box = mask[r.min() : r.max() + 1, c.min() : c.max() + 1]
    values = image[r, c]
    mu20, mu02, mu11 = _moments(r, c)
    root = math.sqrt((mu20 - mu02) ** 2 + 4 * mu11**2)
    l1, l2 = (mu20 + mu02 + root) / 2, max(0.0, (mu20 + mu02 - root) / 2)
    if mu20 == mu02:
        turn = -math.pi / 4 if mu11 < 0 else math.pi / 4
    else:
        turn = 0.5 * math.atan2(2 * mu11, mu20 - mu02)
    out = label(~np.pad(box, 1), diagonal=True)
    holes = out.max() - 1
    hull = convex_area(mask)
    return [
        float(n), float(values.max()), n / hull if hull else 0.0, perimeter(box), float(hull), math.sqrt(max(0.0, 1 - l2 / l1)) if l1 else 0.0, turn,
        float(values.min()), 4 * math.sqrt(l1), 4 * math.sqrt(l2), n / box.size, float((out != out[0, 0]).sum()), math.sqrt(4 * n / math.pi),
        float(values.mean()), float(1 - holes),
    ]


def image_geometry(image: np.ndarray, least: int = 10) -> dict[str, float]:
    """Mean PROPERTIES of regions above the Otsu threshold of a degrouse'd image; regions under `least` pixels are left out."""
    level = min(2, max_level(image.shape[1], "db2"))
    smooth = degrouse(image, "db2", level)
    found = label(smooth > otsu(smooth))
    rows = [region(found == i, smooth) for i in range(1, found.max() + 1) if (found == i).sum() >= least]
    if not rows:
        return dict.fromkeys(PROPERTIES, 0.0)
    mean = np.nan_to_num(np.array(rows, float)).mean(axis=0)
    return dict(zip(PROPERTIES, mean.tolist()))


def _labels(mask: np.ndarray) -> np.ndarray:
    """Connected components of many masks (image, row, column) at once: each pixel has the first place of its own, others -1.

    Places hand the smallest number on to their neighbours and follow it to where it came from, so long components take few rounds.
    """
    none = mask.size
    at = np.where(mask.ravel(), np.arange(none), none)
    at = np.append(at, none)
    while True:
        wide = np.pad(at[:-1].reshape(mask.shape), ((0, 0), (1, 1), (1, 1)), constant_values=none)
        near = np.minimum(np.minimum(wide[:, :-2, 1:-1], wide[:, 2:, 1:-1]), np.minimum(wide[:, 1:-1, :-2], wide[:, 1:-1, 2:]))
        least = np.where(mask, np.minimum(near, wide[:, 1:-1, 1:-1]), none).ravel()
        now = np.append(least, none)
        np.minimum.at(now, at[:-1], least)  # the place a number came from takes the smaller one as well
        now = now[now]
        now = now[now]
        if (now == at).all():
            return np.where(mask, at[:-1].reshape(mask.shape), -1)
        at = now


def _convex_areas(of: np.ndarray, r: np.ndarray, c: np.ndarray, n: int, rows: int) -> np.ndarray:
    """`convex_area` of n regions from their pixels (region, row, column).

    In a hull of midpoints only each half row's first and last one count; a row of it reaches as far as a line between two
    of them does.
    """
    level = 2 * rows + 1
    low, high = np.full((n, level), np.inf), np.full((n, level), -np.inf)
    for d, e in ((0, 0.0), (1, 0.5), (2, 0.0)):
        np.minimum.at(low, (of, 2 * r + d), c - e)
        np.maximum.at(high, (of, 2 * r + d), c + e)
    count = np.zeros(n)
    for row in range(rows):
        k = 2 * row + 1
        first, last = low[:, k].copy(), high[:, k].copy()
        for a in range(k):
            for b in range(k + 1, level):
                share = (k - a) / (b - a)
                both = np.isfinite(low[:, a]) & np.isfinite(low[:, b])
                np.minimum(first, np.where(both, low[:, a] * (1 - share) + np.where(both, low[:, b], 0) * share, np.inf), out=first, where=both)
                np.maximum(last, np.where(both, high[:, a] * (1 - share) + np.where(both, high[:, b], 0) * share, -np.inf), out=last, where=both)
        some = np.isfinite(first)
        count[some] += np.floor(last[some] + 1e-9) - np.ceil(first[some] - 1e-9) + 1
    return count


def regions(labels: np.ndarray, images: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The image, and PROPERTIES as `region` gives them, of all components (`_labels`) of at least some pixels."""
    place = np.flatnonzero(labels.ravel() >= 0)
    first, of, size = np.unique(labels.ravel()[place], return_inverse=True, return_counts=True)
    number = np.cumsum(size >= least) - 1
    place, of = place[size[of] >= least], number[of[size[of] >= least]]
    first, n = first[size >= least], size[size >= least]
    k = len(n)
    held = np.full(labels.size, -1)
    held[place] = of
    held = held.reshape(labels.shape)
    i, r, c = np.unravel_index(place, labels.shape)
    total = lambda w: np.bincount(of, w, k)
    values = images[i, r, c]
    top, bottom = np.full(k, -np.inf), np.full(k, np.inf)
    np.maximum.at(top, of, values)
    np.minimum.at(bottom, of, values)
    ends = []
    for x in (r, c):
        lo, hi = np.full(k, labels.size), np.full(k, -1)
        np.minimum.at(lo, of, x)
        np.maximum.at(hi, of, x)
        ends.append((lo, hi))
    box = (ends[0][1] - ends[0][0] + 1) * (ends[1][1] - ends[1][0] + 1)
    dr, dc = r - (total(r) / n)[of], c - (total(c) / n)[of]
    mu20, mu02, mu11 = total(dr * dr) / n + 1 / 12, total(dc * dc) / n + 1 / 12, total(dr * dc) / n
    # where nothing but rounding tells which way a region lies, it is rounded as that of one region is
    even = n * (total(r * r) - total(c * c)) == total(r) ** 2 - total(c) ** 2
    straight = n * total(r * c) == total(r) * total(c)
    mu11[straight] = 0.0
    gap = mu20 - mu02
    wide = (ends[0][1] > ends[0][0]) & (ends[1][1] > ends[1][0])
    unsure = np.flatnonzero((even | straight & (gap < 0)) & wide)
    if len(unsure):
        by = np.argsort(of, kind="stable")
        stop = np.cumsum(n)
        for j in unsure:
            mine = by[stop[j] - n[j] : stop[j]]
            mu20[j], mu02[j], mu11[j] = _moments(r[mine], c[mine])
            gap[j] = mu20[j] - mu02[j]
    root = np.sqrt(gap**2 + 4 * mu11**2)
    l1, l2 = (mu20 + mu02 + root) / 2, np.maximum(0.0, (mu20 + mu02 - root) / 2)
    turn = np.where(gap == 0, np.where(mu11 < 0, -math.pi / 4, math.pi / 4), 0.5 * np.arctan2(2 * mu11, gap))
    # neighbours by label, in a frame of no region
    wide = np.pad(held, ((0, 0), (1, 1), (1, 1)), constant_values=-1)
    near8 = {(y, x): wide[i, r + 1 + y, c + 1 + x] == of for y in (-1, 0, 1) for x in (-1, 0, 1)}
    edge = ~(near8[-1, 0] & near8[1, 0] & near8[0, -1] & near8[0, 1])
    border = np.zeros(wide.shape, bool)
    border[i, r + 1, c + 1] = edge
    lies = lambda y, x: near8[y, x] & border[i, r + 1 + y, c + 1 + x]
    side = sum(lies(y, x).astype(int) for y, x in ((-1, 0), (1, 0), (0, -1), (0, 1)))
    corner = sum(lies(y, x).astype(int) for y, x in ((-1, -1), (-1, 1), (1, -1), (1, 1)))
    around = total(_LENGTHS[edge * (1 + 2 * side + 10 * corner)])
    # holes by the squares of four pixels that a region has one, three or two opposite pixels of
    squares = np.zeros(len(of), int)
    for y in (-1, 1):
        for x in (-1, 1):
            others = near8[y, 0].astype(int) + near8[0, x] + near8[y, x]
            squares += np.select([others == 0, others == 2, (others == 1) & near8[y, x]], [3, -1, 3], 0)
    euler = np.rint(total(squares) / 12)
    filled = n.astype(float)
    for j in np.flatnonzero(euler < 1):
        (r0, r1), (c0, c1) = ((int(a[j]), int(b[j]) + 1) for a, b in ends)
        out = label(~np.pad(held[first[j] // (labels.shape[1] * labels.shape[2]), r0:r1, c0:c1] == j, 1), diagonal=True)
        filled[j] = (out != out[0, 0]).sum()
    hull = _convex_areas(of, r, c, k, labels.shape[1])
    return first // (labels.shape[1] * labels.shape[2]), np.stack([
        n, top, n / hull, around, hull, np.sqrt(np.maximum(0.0, 1 - l2 / l1)), turn, bottom, 4 * np.sqrt(l1), 4 * np.sqrt(l2), n / box, filled,
        np.sqrt(4 * n / math.pi), total(values) / n, euler,
    ], 1)


def image_rows(images: np.ndarray, least: int = 10) -> np.ndarray:
    """`image_geometry` of many images of one shape at once: a row each, a column a property."""
    smooth = degrouse(images, "db2", min(2, max_level(images.shape[2], "db2")))
    cuts = np.array([otsu(x) for x in smooth])
    image, found = regions(_labels(smooth > cuts[:, None, None]), smooth, least)
    count = np.bincount(image, minlength=len(images))
    found = np.nan_to_num(found)
    sums = np.stack([np.bincount(image, x, len(images)) for x in found.T], 1)
    return sums / np.maximum(count, 1)[:, None]


def trailing_images(strips: np.ndarray, tops: np.ndarray, which: np.ndarray, rows: int) -> np.ndarray:
    """`image_geometry` of the last rows + 1 strips at each of some places, as shares of the place's top."""
    sizes = np.minimum(which, rows) + 1
    out = np.empty((len(which), len(PROPERTIES)))
    order = np.argsort(sizes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        for low in range(0, len(at), ROWS):
            some = at[low : low + ROWS]
            size = sizes[some[0]]
            taken = strips[which[some, None] + np.arange(1 - size, 1)].transpose(0, 2, 1)
            with np.errstate(invalid="ignore", over="ignore"):
                out[some] = image_rows(np.nan_to_num(taken / np.where(tops[some] == 0, 1.0, tops[some])[:, None, None]))
    return out


def _ricker(points: int, width: float) -> np.ndarray:
    t = np.arange(points) - (points - 1) / 2
    return 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - (t / width) ** 2) * np.exp(-(t**2) / (2 * width**2))


def _floor(x: np.ndarray, window: int, percent: float) -> np.ndarray:
    """A percentile of the `window` values around each place; windows are cut at the ends."""
    n = len(x)
    half, odd = divmod(window, 2)
    out = np.empty(n)
    whole = max(half, n - half - odd + 1)  # places from half up to here have a whole window
    if whole > half:
        out[half:whole] = np.percentile(np.lib.stride_tricks.sliding_window_view(x, window), percent, axis=1)
    for i in (*range(half), *range(whole, n)):
        out[i] = np.percentile(x[max(i - half, 0) : i + half + odd], percent)
    return out


def cwt_peaks(x: np.ndarray, widths: tuple[int, ...] = (1, 2, 3, 4), snr: float = 1.0, noise_percent: float = 10.0) -> np.ndarray:
    """Peaks as ridges of local maxima over the widths of a wavelet transform that stand out of the noise."""
    n = len(x)
    if n < 3:
        return np.zeros(0, int)
    rows = np.array([np.convolve(x, _ricker(min(10 * w, n), w)[::-1], mode="same")[:n] for w in widths])
    left, right = np.roll(rows, 1, 1), np.roll(rows, -1, 1)
    top = (rows > left) & (rows > right)
    top[:, [0, -1]] = False
    lines: list[list] = []  # rows, columns, gap
    gap = math.ceil(widths[0])
    done: list[list] = []
    for i in range(len(widths) - 1, -1, -1):
        reach = widths[i] / 4 if widths[i] >= 4 else 1
        at = np.flatnonzero(top[i])
        for line in lines:
            line[2] += 1
        last = np.array([line[1][-1] for line in lines])
        nearest = np.abs(last - at[:, None]).argmin(1).tolist() if len(last) else [-1] * len(at)
        for c, near in zip(at.tolist(), nearest):
            if near >= 0 and abs(last[near] - c) <= reach:
                lines[near][0].append(i)
                lines[near][1].append(c)
                lines[near][2] = 0
            else:
                lines.append([[i], [c], 0])
        done += [line for line in lines if line[2] > gap]
        lines = [line for line in lines if line[2] <= gap]
    done += lines
    noise = _floor(rows[0], math.ceil(n / 20), noise_percent)
    keep = []
    for r, c, _ in done:
        if len(r) < math.ceil(len(widths) / 4):
            continue
        if abs(rows[r[-1], c[-1]] / noise[c[-1]] if noise[c[-1]] else math.inf) >= snr:
            keep.append(c[-1])
    return np.array(sorted(keep), int)


def _extrema(x: np.ndarray, greater: bool) -> np.ndarray:
    if len(x) < 3:
        return np.zeros(0, int)
    a, b, c = x[:-2], x[1:-1], x[2:]
    return np.flatnonzero((b > a) & (b > c) if greater else (b < a) & (b < c)) + 1


def _running_mean(x: np.ndarray, reach: int) -> np.ndarray:
    if not len(x):
        return x
    ones = np.pad(np.ones(len(x)), reach)
    around = lambda v: np.lib.stride_tricks.sliding_window_view(v, 2 * reach + 1).sum(1)
    return around(np.pad(x, reach)) / around(ones)


def zero_runs(x: np.ndarray) -> np.ndarray:
    """Lengths of the runs of zeros, in order."""
    zero = np.zeros(len(x) + 2, np.int8)
    zero[1:-1] = x == 0
    edges = np.flatnonzero(np.diff(zero))
    return edges[1::2] - edges[::2]


def series_features(x: np.ndarray, cwt: bool = True) -> dict[str, float]:
    """Peaks, jumps and flats of a trailing series of contact counts.

    peak_max_std looks at minima and peak_min_std at maxima, as published. Steps of up to 1e-9 are rounding, not jumps.
    Without `cwt` the feature that takes longest is left out (NaN).
    """
    x = np.asarray(x, float)
    mean = _running_mean(x, 2)
    spread = lambda v: float(np.diff(v).std()) if len(v) > 1 else float("nan")
    peaks = cwt_peaks(mean) if cwt else np.zeros(0, int)
    coeffs = wavedec(x)
    coarse = waverec([c if i < 4 else c * 0 for i, c in enumerate(coeffs)])
    step = np.diff(coarse)
    moved = step[np.abs(step) > 1e-9]
    fine = waverec([c if i == len(coeffs) - 1 else c * 0 for i, c in enumerate(coeffs)])
    flat = zero_runs(fine)[1:-1]  # the first and the last run have no end of their own
    flat = flat[flat > 4]
    return {
        "peak_max_std": spread(mean[_extrema(x, False)]), "peak_min_std": spread(mean[_extrema(x, True)]),
        "smness": float(np.diff(x).std()) if len(x) > 1 else float("nan"), "peak_max_std_cwt": spread(mean[peaks]) if len(peaks) else float("nan"),
        "wt_jump_max": float(np.abs(step).max()) if len(step) else 0.0, "wt_jump_mean": float(np.abs(moved).mean()) if len(moved) else float("nan"),
        "wt_min": float(coarse.min()) if len(coarse) else float("nan"), "wt_max": float(coarse.max()) if len(coarse) else float("nan"),
        "len_max_flat": float(flat.max()) if len(flat) else 0.0, "n_flat": float(len(flat)),
    }


def _ridge_ends(top: np.ndarray) -> np.ndarray:
    """For maxima (width, place, window) the ends of their ridges: those whose last maximum is at a width and place.

    The lines of `cwt_peaks` for reaches and gaps of one place. No two open lines have one last place, so a line is known
    by it; `rank` is the order in which lines began.
    """
    k, n, b = top.shape
    none = np.iinfo(np.int32).max
    rank, gap = np.full((n + 2, b), none, np.int32), np.zeros((n + 2, b), bool)
    ends = np.zeros(top.shape, bool)
    for i in range(k - 1, -1, -1):
        before, here, behind = rank[:-2], rank[1:-1], rank[2:]
        own = top[i] & (here < none)
        free = top[i] & (here == none)
        down, up = free & (before < behind), free & (behind < before)  # of two lines as near the older one
        taken = own.copy()
        taken[:-1] |= down[1:]
        taken[1:] |= up[:-1]
        up[:-2] &= ~down[2:]  # of two maxima of one line the later place counts
        left = (here < none) & ~taken
        if i + 2 < k:
            ends[i + 2] |= left & gap[1:-1]
        left &= ~gap[1:-1]
        began = (k - 1 - i) * n + np.arange(n, dtype=np.int32)[:, None]
        now = np.select([own | left, down, up, free & (before == none) & (behind == none)], [here, before, behind, np.broadcast_to(began, here.shape)], none)
        rank[1:-1], gap[1:-1] = now, left
    open_ = rank[1:-1] < none
    ends[0] |= open_ & ~gap[1:-1]
    if k > 1:
        ends[1] |= open_ & gap[1:-1]
    return ends


def _floors(x: np.ndarray, window: int, percent: float) -> np.ndarray:
    """`_floor` down each column; where the percentile lies at or below the second value of a window, from its two least."""
    n = len(x)
    if (min(window, n) - 1) * (percent / 100) > 1:
        return np.stack([_floor(c, window, percent) for c in x.T], 1)
    half, odd = divmod(window, 2)
    wide = np.full((n + window, x.shape[1]), np.inf)
    wide[half : half + n] = x
    least, second = np.full(x.shape, np.inf), np.full(x.shape, np.inf)
    for o in range(2 * half + odd):
        v = wide[o : o + n]
        second = np.minimum(second, np.maximum(least, v))
        least = np.minimum(least, v)
    i = np.arange(n)
    at = ((np.minimum(i + half + odd, n) - np.maximum(i - half, 0) - 1) * (percent / 100))[:, None]
    step = np.where(at > 0, second - least, 0.0)
    return np.where(at == 0, least, np.where(at >= 0.5, second - step * (1 - at), least + step * at))


def _transformed(x: np.ndarray, width: int) -> np.ndarray:
    """The wavelet transform down each column."""
    n = len(x)
    h = _ricker(min(10 * width, n), width)[::-1]
    m = len(h)
    wide = np.zeros((n + m - 1, x.shape[1]))
    wide[m - 1 - (m - 1) // 2 :][:n] = x
    out, held = np.zeros(x.shape), np.empty(x.shape)
    for k in range(m):
        out += np.multiply(wide[m - 1 - k : m - 1 - k + n], h[k], out=held)
    return out


def _spreads(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Deviation of the steps between the values of each of n rows; NaN without a step. Values of a row stand together."""
    same = row[1:] == row[:-1]
    d, r = np.diff(values)[same], row[1:][same]
    with np.errstate(invalid="ignore"):
        count = np.bincount(r, minlength=n).astype(float)
        mean = np.bincount(r, d, n) / count
        return np.sqrt(np.bincount(r, (d - mean[r]) ** 2, n) / count)


def series_rows(x: np.ndarray, cwt: bool = True, widths: tuple[int, ...] = (1, 2, 3, 4), snr: float = 1.0, noise_percent: float = 10.0) -> np.ndarray:
    """`series_features` of many windows of one length at once: a row each, a column a feature."""
    b, n = x.shape
    if n < 3:
        return np.array([list(series_features(v, cwt).values()) for v in x]).reshape(b, -1)
    wide, ones = np.pad(x, ((0, 0), (2, 2))), np.pad(np.ones(n), 2)
    around = lambda v: sum(v[..., k : k + n] for k in range(5))
    mean = around(wide) / around(ones)
    ridges = np.full(b, np.nan)
    if cwt:
        columns = np.ascontiguousarray(mean.T)
        rows = np.stack([_transformed(columns, w) for w in widths])
        top = np.zeros(rows.shape, bool)
        top[:, 1:-1] = (rows[:, 1:-1] > rows[:, :-2]) & (rows[:, 1:-1] > rows[:, 2:])
        row, place, width = np.nonzero(_ridge_ends(top).transpose(2, 1, 0))
        noise = _floors(rows[0], math.ceil(n / 20), noise_percent)[place, row]
        with np.errstate(divide="ignore", invalid="ignore"):
            loud = (noise == 0) | (np.abs(rows[width, place, row] / noise) >= snr)
        ridges = _spreads(mean[row[loud], place[loud]], row[loud], b)
    extreme = []
    for sign in (-1, 1):
        y = sign * x
        row, place = np.nonzero((y[:, 1:-1] > y[:, :-2]) & (y[:, 1:-1] > y[:, 2:]))
        extreme.append(_spreads(mean[row, place + 1], row, b))
    coeffs = wavedec(x)
    coarse = waverec([c if i < 4 else c * 0 for i, c in enumerate(coeffs)])
    step = np.abs(np.diff(coarse))
    moved = step > 1e-9
    with np.errstate(invalid="ignore"):
        jump = np.where(moved, step, 0.0).sum(1) / moved.sum(1)
    fine = idwt(np.zeros_like(coeffs[-1]), coeffs[-1], "haar")
    zero = np.zeros((b, fine.shape[1] + 2), np.int8)
    zero[:, 1:-1] = fine == 0
    row, edge = np.nonzero(np.diff(zero))
    row, flat = row[::2], edge[1::2] - edge[::2]
    inner = np.zeros(len(row), bool)
    inner[1:-1] = (row[1:-1] == row[:-2]) & (row[1:-1] == row[2:])  # the first and the last run have no end of their own
    row, flat = row[inner & (flat > 4)], flat[inner & (flat > 4)]
    longest = np.zeros(b)
    np.maximum.at(longest, row, flat)
    return np.stack([*extreme, np.diff(x).std(1), ridges, step.max(1), jump, coarse.min(1), coarse.max(1), longest, np.bincount(row, minlength=b)], 1)


def trailing_rows(x: np.ndarray, rows: int, cwt: bool = True) -> np.ndarray:
    """`series_features` of each place's last rows + 1 values; missing ones (None) take a place but give no value."""
    here = np.array([v is not None for v in x], bool) if x.dtype == object else np.ones(len(x), bool)
    values = x[here].astype(float)
    count = np.append(0, np.cumsum(here))
    stop = count[1:]
    start = count[np.maximum(np.arange(len(x)) - rows, 0)]
    out = np.empty((len(x), len(series_features(np.zeros(0)))))
    sizes = stop - start
    order = np.argsort(sizes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        for low in range(0, len(at), ROWS):
            some = at[low : low + ROWS]
            out[some] = series_rows(values[start[some, None] + np.arange(sizes[some[0]])], cwt)
    return out


def piecewise(y: np.ndarray, depth: int = 5) -> np.ndarray:
    """A regression tree over the row number: the means of its pieces."""
    out = np.empty(len(y))
    stack = [(0, len(y), 0)]
    while stack:
        a, b, d = stack.pop()
        part = y[a:b]
        n = b - a
        cut = None
        if d < depth and n > 1:
            s = part.cumsum()
            k = np.arange(1, n)
            gain = s[:-1] ** 2 / k + (s[-1] - s[:-1]) ** 2 / (n - k)
            best = int(gain.argmax())
            if gain[best] - s[-1] ** 2 / n > 1e-12:
                cut = a + best + 1
        if cut is None:
            out[a:b] = part.mean() if n else 0
        else:
            stack += [(a, cut, d + 1), (cut, b, d + 1)]
    return out


def start_and_stop(angle: np.ndarray, window: int = 15, still: float = 1e-4) -> tuple[int, int]:
    """Row before a turning wheel first starts, and row before it first stops; else the first and the last row.

    The steps of the angle's sine (degrees) are smoothed to pieces. A start has `window` still steps before it and
    as many of which none is still after it; a stop has them the other way round.
    """
    if len(angle) < 2:
        return 0, max(0, len(angle) - 1)
    steps = piecewise(np.diff(np.sin(np.radians(angle))))
    calm = np.concatenate(([0], np.cumsum(np.abs(steps) < still)))  # still steps before each place
    at = np.arange(window, len(steps) - window + 1)
    before, after = calm[at] - calm[at - window], calm[at + window] - calm[at]
    starts, stops = at[(before == window) & (after == 0)], at[(before == 0) & (after == window)]
    return int(starts[0]) - 1 if len(starts) else 0, int(stops[0]) - 1 if len(stops) else len(angle) - 1
