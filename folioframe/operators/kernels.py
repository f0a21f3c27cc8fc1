"""Whole-image kernels on numpy rasters: rows of an image are lines of an array, black is 1, gray is 0 (dark) to 255.

They serve the packed form, one row an image, where a page of millions of
pixels never becomes rows.  All work on any size, one-pixel lines and empty
rasters included.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

FAR = 1 << 40


# --- neighbourhoods ---------------------------------------------------------------------------------------------


def _run(a: np.ndarray, lo: int, hi: int, axis: int, best: np.ufunc, outside: int) -> np.ndarray:
    """best over offsets lo..hi along an axis, outside beyond the image; spans double, so a window of n takes log n steps, each over the image as one line."""
    n = hi - lo + 1
    (h, w), before, start = a.shape, max(0, -lo), max(0, lo)
    if not a.size:
        return a.copy()
    room = before + max(0, hi)
    if axis == 0:
        p, step = np.empty((h + room, w), a.dtype), w
        p[:before], p[before : before + h], p[before + h :] = outside, a, outside
    else:
        p, step = np.empty((h + -(-room // (w + room)) + 1, w + room), a.dtype), 1
        p[:h, :before], p[:h, before : before + w], p[:h, before + w :], p[h:] = outside, a, outside, outside
    size, shape = h * p.shape[1], (h, p.shape[1])
    p = p.ravel()
    span = 1
    while span * 2 <= n:
        p = best(p[: -span * step], p[span * step :]) if len(p) > span * step else p
        span *= 2
    return np.ascontiguousarray(best(p[start * step :][:size], p[(start + n - span) * step :][:size]).reshape(shape)[:, :w])


def spread(a: np.ndarray, x: tuple[int, int], y: tuple[int, int], least: bool, outside: int) -> np.ndarray:
    """Least or largest value in the brick of offsets x and y."""
    best = np.minimum if least else np.maximum
    return _run(_run(a, *x, 1, best, outside), *y, 0, best, outside)


def centred(n: int) -> tuple[int, int]:
    """Offsets of a brick of n pixels around its origin."""
    return -(n // 2), n - n // 2 - 1


def dilate(bw: np.ndarray, w: int, h: int, outside: int = 0) -> np.ndarray:
    flip = lambda b: (-b[1], -b[0])
    return spread(bw, flip(centred(w)), flip(centred(h)), False, outside)


def erode(bw: np.ndarray, w: int, h: int, outside: int = 1) -> np.ndarray:
    return spread(bw, centred(w), centred(h), True, outside)


def opened(bw: np.ndarray, w: int, h: int, outside: int = 1) -> np.ndarray:
    core = erode(bw, w, h, outside)
    return dilate(core, w, h) if core.any() else core


def closed(bw: np.ndarray, w: int, h: int, outside: int = 0) -> np.ndarray:
    return erode(dilate(bw, w, h, outside), w, h)


def darker(g: np.ndarray, w: int, h: int, outside: int = 255) -> np.ndarray:
    """Dilation of gray: the darker spreads."""
    return spread(g, centred(w), centred(h), True, outside)


def lighter(g: np.ndarray, w: int, h: int, outside: int = 0) -> np.ndarray:
    return spread(g, centred(w), centred(h), False, outside)


def hit_miss(bw: np.ndarray, pattern: list[str]) -> np.ndarray:
    """bw with the pixels under ``-`` erased and under ``+`` set wherever the pattern matches (X and - black, blank and + white, ? either); white outside."""
    h, w = len(pattern), len(pattern[0])
    p = np.pad(bw, ((h, h), (w, w)))
    match = np.ones((p.shape[0] - h + 1, p.shape[1] - w + 1), bool)
    cells = [(dy, dx, pattern[dy][dx]) for dy in range(h) for dx in range(w)]
    for dy, dx, c in cells:
        if c != "?":
            match &= (p[dy : dy + match.shape[0], dx : dx + match.shape[1]] > 0) == (c in "X-")
    out = p.copy()
    for dy, dx, c in cells:
        if c in "-+":
            out[dy : dy + match.shape[0], dx : dx + match.shape[1]][match] = int(c == "+")
    return out[h : h + bw.shape[0], w : w + bw.shape[1]]


# Patterns that smooth outlines; each is applied in all four directions before the next.
SMOOTHING = [
    ["XXX", " - ", "   "],
    ["X ?", "X  ", "X- ", "X- ", "X  ", "X ?"],
    ["X ?", "X ?", "X  ", "X- ", "X- ", "X- ", "X  ", "X ?", "X ?"],
    ["XX?", "XX?", "XX ", "X+ ", "X+ ", "X+ ", "XX ", "XX?", "XX?"],
    ["XX?", "XX ", "X+ ", "X+ ", "XX ", "XX?"],
    ["   ", "X+X", "XXX"],
]


def _runs(cells: list[tuple[int, int]]) -> list[tuple[int, int, int, bool]]:
    """Cells (line, column) as runs down or along, whichever are fewer, the longest first: line, column, cells, down."""
    ways = []
    for down in (True, False):
        runs: list[list[int]] = []
        for a, b in sorted((x, y) if down else (y, x) for y, x in cells):
            if runs and runs[-1][0] == a and runs[-1][1] + runs[-1][2] == b:
                runs[-1][2] += 1
            else:
                runs.append([a, b, 1])
        ways.append([(b, a, n, True) if down else (a, b, n, False) for a, b, n in runs])
    return sorted(min(ways, key=len), key=lambda r: -r[2])


def _turned() -> Iterator[tuple[list[tuple], ...]]:
    """Of each pattern in its four directions: runs of black and of white cells, and the cells (line, column) erased and set."""
    for pattern in SMOOTHING:
        for _ in range(4):
            black, white, erased, added = ([(dy, dx) for dy, row in enumerate(pattern) for dx, c in enumerate(row) if c in kind] for kind in ("X-", " +", "-", "+"))
            yield _runs(black), _runs(white), erased, added
            pattern = ["".join(row[k] for row in reversed(pattern)) for k in range(len(pattern[0]))]


_TURNED = list(_turned())


def smoothed(bw: np.ndarray) -> np.ndarray:
    """Single bumps and nicks of up to three pixels taken off all sides of outlines; ``hit_miss`` on the page as one number, a bit a pixel, by runs of pixels that the patterns share."""
    h, w = bw.shape
    most = max(max(len(p), len(p[0])) for p in SMOOTHING)
    if not bw.size:
        return bw
    wide = -(-(w + most) // 8) * 8

    def number(a: np.ndarray | int) -> int:
        p = np.zeros((h + 2 * most, wide), np.uint8)
        p[most : most + h, :w] = a
        return int.from_bytes(np.packbits(p, bitorder="little").tobytes(), "little")

    def run(known: dict[tuple[int, bool], int], n: int, down: bool) -> int:
        """Where n pixels down or along begin; known has the single ones."""
        if n == 1:
            return known[1, True]
        if (n, down) not in known:
            half = run(known, (n + 1) // 2, down)
            known[n, down] = half & half >> n // 2 * (wide if down else 1)
        return known[n, down]

    rows = h + 2 * most
    page, inside, every = number(bw > 0), 0, (1 << rows * wide) - 1
    black, white = {(1, True): page}, {(1, True): every ^ page}
    for dark, light, erased, added in _TURNED:
        match = every
        for known, runs in ((black, dark), (white, light)):
            for dy, dx, n, down in runs if match else ():
                match &= run(known, n, down) >> dy * wide + dx
                if not match:
                    break
        if match:
            for dy, dx in erased:
                page &= ~(match << dy * wide + dx)
            for dy, dx in added:
                inside = inside or number(1)
                page |= match << dy * wide + dx & inside
            black, white = {(1, True): page}, {(1, True): every ^ page}
    bits = np.unpackbits(np.frombuffer(page.to_bytes(rows * wide // 8, "little"), np.uint8), bitorder="little").reshape(rows, wide)
    return np.ascontiguousarray(bits[most : most + h, :w]).astype(bw.dtype)


def reduced(bw: np.ndarray, least: int) -> np.ndarray:
    """Half the size, black where at least ``least`` of four pixels are; an odd line is left out.

    A line of one pixel counts twice: of its pairs one black pixel makes two.
    """
    h, w = bw.shape
    if h > 1 and w > 1:
        a = bw[: h // 2 * 2, : w // 2 * 2].astype(np.int32)
        return (a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2] >= least).astype(bw.dtype)
    line = np.repeat(bw.ravel(), 2) if bw.size == 1 else bw.ravel()
    line = line[: len(line) // 2 * 2].reshape(-1, 2).sum(axis=1, dtype=np.int32) * 2 >= least
    return line.astype(bw.dtype).reshape((1, -1) if h == 1 else (-1, 1))


def sheared(bw: np.ndarray, slope: float, origin: float) -> np.ndarray:
    """Columns moved down by slope times their centre's distance from origin, rounded; white comes in."""
    h, w = bw.shape
    out = np.zeros_like(bw)
    shift = np.floor(slope * (np.arange(w) + 0.5 - origin) + 0.5).astype(int)
    for s in np.unique(shift):
        at = np.flatnonzero(shift == s)
        if abs(s) < h:
            out[max(0, s) : h + min(0, s), at] = bw[max(0, -s) : h - max(0, s), at]
    return out


# --- thresholds -------------------------------------------------------------------------------------------------


def histogram(g: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    return np.bincount((g if mask is None else g[mask > 0]).ravel(), minlength=256)


def otsu(h: np.ndarray) -> int:
    """Threshold of the largest variance between classes; ties take the middle of the first and last best; 0 for one level."""
    level = np.arange(256)
    below, total = np.cumsum(h), h.sum()
    s, every = np.cumsum(h * level), (h * level).sum()
    ok = (below > 0) & (below < total)
    if not ok.any():
        return 0
    nb, na = below[ok].astype(float), (total - below[ok]).astype(float)
    v = np.full(256, -1.0)
    v[ok] = np.round(((every - s[ok]) / na - s[ok] / nb) ** 2 * nb * na, 6)
    best = np.flatnonzero(v == v.max())
    return int((best[0] + best[-1]) // 2 + 1)


def _window(size: int) -> tuple[int, int]:
    return -(size >> 1), size - (size >> 1) - 1


def _sums(v: np.ndarray, size: int, step: int, kind: type) -> np.ndarray:
    """Sums of size values, each step apart, of a line of numbers; spans double."""
    span, v, out, at = 1, v.astype(kind, copy=False), None, 0
    n = len(v) - (size - 1) * step
    while True:
        if size & span:
            part = v[at * step : at * step + n]
            out = part.copy() if out is None else np.add(out, part, out=out)
            at += span
        span *= 2
        if span > size:
            return out
        v = v[: -(span // 2) * step] + v[(span // 2) * step :]


def _totals(g: np.ndarray, size: int, squares: bool) -> np.ndarray:
    """Sums of gray values or of their squares in a window, nothing beyond the image: both ways by steps over the page as one line."""
    h, w = g.shape
    lo, _ = _window(size)
    p = np.zeros((h + size, w + size - 1), np.uint32 if squares else np.uint16)
    p[-lo : h - lo, -lo : w - lo] = g
    if squares:
        p *= p
    wide = w + size - 1
    down = _sums(p.ravel(), size, wide, np.uint32 if squares or size > 256 else np.uint16)
    return _sums(down, size, 1, np.uint32)[: h * wide].reshape(h, wide)[:, :w]


@lru_cache(256)
def _spans(n: int, size: int) -> np.ndarray:
    """Points of a line of n in the window of each."""
    lo, hi = _window(size)
    return (np.clip(np.arange(n) + hi + 1, 0, n) - np.clip(np.arange(n) + lo, 0, n)).astype(float)


def _areas(h: int, w: int, size: int) -> np.ndarray:
    """Pixels in the window of each pixel."""
    return _spans(h, size)[:, None] * _spans(w, size)


def mean_only(a: np.ndarray, size: int) -> np.ndarray:
    """The mean of ``local_mean``."""
    return _totals(a, size, False) / _areas(*a.shape, size) if a.dtype == np.uint8 and a.size and size <= 256 else local_mean(a, size)[0]


def _variance(a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance in a window of size pixels a side, clipped to the image; gray by sums of doubled spans, other numbers by differences of running sums."""
    h, w = a.shape
    n = _areas(h, w, size)
    if a.dtype == np.uint8 and a.size and size <= 256:
        mean, var = _totals(a, size, False) / n, _totals(a, size, True) / n
    else:
        lo, hi = _window(size)
        y0, y1 = np.clip(np.arange(h) + lo, 0, h), np.clip(np.arange(h) + hi + 1, 0, h)
        top = max(int(a.max(initial=0)), -int(a.min(initial=0)), 1) ** 2
        kind = np.int32 if top * max(h, min(h, size) * w) < 1 << 31 else np.int64

        def total(v: np.ndarray) -> np.ndarray:
            down = np.zeros((h + 1, w), kind)
            np.cumsum(v, axis=0, out=down[1:])
            across = np.zeros((h, w + 1 + hi - lo), kind)  # carried on to both sides by the window
            np.cumsum(down[y1] - down[y0], axis=1, out=across[:, 1 - lo : 1 - lo + w])
            across[:, 1 - lo + w :] = across[:, w - lo : w - lo + 1]
            return across[:, 1 - lo + hi :][:, :w] - across[:, :w]

        v = a.astype(kind)
        mean, var = total(v) / n, total(v * v) / n
    var -= mean * mean
    return mean, np.abs(var, out=var)


def local_mean(a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation in a window of size pixels a side, clipped to the image."""
    mean, var = _variance(a, size)
    return mean, np.sqrt(var, out=var)


def sauvola(g: np.ndarray, size: int, k: float, delta: float = 0.0) -> np.ndarray:
    mean, dev = local_mean(g, size)
    return (g < np.round(mean * (1 + k * (dev / 128 - 1)) + delta, 6)).astype(np.uint8)


def wolf(g: np.ndarray, size: int, k: float, lower: int = 1, upper: int = 254, delta: float = 0.0) -> np.ndarray:
    mean, var = _variance(g, size)
    top = np.sqrt(var.max(initial=0.0))
    if not top:
        return (g < lower).astype(np.uint8)
    out = (g < lower).astype(np.uint8)
    # a threshold is no higher than the mean, so that the lightest pixels stay white
    some = np.flatnonzero(g < g.max()) if k >= 0 and delta <= 0 else np.arange(g.size)
    v, mean = g.ravel().take(some), mean.ravel().take(some)
    t = np.round(mean - k * (1 - np.sqrt(var.ravel().take(some)) / top) * (mean - float(g.min())) + delta, 6)
    out.ravel()[some[(v <= upper) & (v < t)]] = 1
    return out


def bradley(g: np.ndarray, size: int, k: float, delta: float = 0.0) -> np.ndarray:
    mean, _ = local_mean(g, size)
    return (g < np.round((mean * (1 - k) if k < 1 else 0.0 * mean) + delta, 6)).astype(np.uint8)


def grad(g: np.ndarray, size: int, k: float, delta: float = 0.0) -> np.ndarray:
    mean = np.clip(np.floor(local_mean(g, size)[0] + 0.5), 0, 255)
    weight = np.abs(mean - g)
    level = float((weight * g).sum()) / float(weight.sum()) if weight.any() else 127.5
    return (g < np.round(level * (1 - k) + mean * k + delta, 6)).astype(np.uint8)


def edge_div(g: np.ndarray, size: int, plus: float, blur: float, delta: float = 0.0) -> np.ndarray:
    """Edges strengthened against the local mean before Otsu's threshold; the blur's ratio sees what plus made, and divides the original."""
    mean, _ = local_mean(g, size)
    original = g.astype(float)
    now = original
    if plus > 0:
        now = plus * (original * ((original + 1) / (mean + 1) - 0.5)) + (1 - plus) * original
    if blur > 0:
        norm = blur * ((mean + 1) / (now + 1) - 0.5) + (1 - blur)
        now = np.where(norm > 0, original / np.where(norm > 0, norm, 1.0), original)
    out = np.floor(np.clip(np.round(now, 6), 0, 255)).astype(np.int64)
    return (out < otsu(histogram(out)) + delta).astype(np.uint8)


# --- components, fills, distances -------------------------------------------------------------------------------


def _linked(bw: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Runs of black in raster order (line, first column, one past the last), the component of each from 0, and the number of these.

    Runs are linked with the runs they touch in the line below; pointers to
    runs further up jump until they reach the first run of each component.
    """
    h, w = bw.shape
    p = np.zeros(h * (w + 1) + 1, bool)
    p[1:].reshape(h, w + 1)[:, :w] = bw > 0
    turn = np.flatnonzero(p[1:] != p[:-1])
    y, first = np.divmod(turn[::2], w + 1)
    end = turn[1::2] - y * (w + 1)
    if not len(y):
        return y, first, end, y, 0
    row = np.searchsorted(y, np.arange(h + 1))
    reach = int(diagonal)
    key = y * (w + 2)
    below = np.minimum(y + 1, h)
    base = row[below]
    # of the line below: runs that end after this one's beginning and begin before its end
    ends, begins = key + end, key + first
    at = (y + 1) * (w + 2)
    lo = np.maximum(np.searchsorted(ends, at + first - reach, "right"), base)
    hi = np.minimum(np.searchsorted(begins, at + end + reach, "left"), row[np.minimum(y + 2, h)])
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    # each run to the first one above it, then the roots that a link joins to the lower of both
    root = np.arange(len(y))
    root[b[::-1]] = a[::-1]
    while True:
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            break
        p, q = p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        a, b = a[apart], b[apart]
    number = np.cumsum(root == np.arange(len(y))) - 1
    return y, first, end, number[root], int(number[-1]) + 1


def _painted(shape: tuple[int, int], y: np.ndarray, first: np.ndarray, end: np.ndarray, value: np.ndarray, kind: type = np.int32) -> np.ndarray:
    """Runs filled with their values, 0 elsewhere."""
    h, w = shape
    turn = np.zeros(2 * len(y) + 2, np.int64)
    turn[1:-1:2], turn[2:-1:2], turn[-1] = y * w + first, y * w + end, h * w
    values = np.zeros(2 * len(y) + 1, kind)
    values[1::2] = value
    return np.repeat(values, np.diff(turn)).reshape(h, w)


def _boxes(y: np.ndarray, first: np.ndarray, end: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    """Rows (pixels, x0, y0, x1, y1) of n components from their runs; a component without any has FAR and -1."""
    out = np.empty((n, 5), np.int64)
    out[:, 0], out[:, 1:3], out[:, 3:] = 0, FAR, -1
    if len(k):
        out[:, 0] = np.bincount(k, end - first, n)
        x0, x1 = np.full(n, FAR), np.full(n, -1)
        np.minimum.at(x0, k, first)
        np.maximum.at(x1, k, end - 1)
        out[:, 1], out[:, 3] = x0, x1
        out[k[::-1], 2] = y[::-1]  # runs come in raster order
        out[k, 4] = y
    return out


def components(bw: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, int]:
    """Labels 1.. of the black components, in raster order of their first pixels, and their number."""
    y, first, end, k, n = _linked(bw, diagonal)
    return _painted(bw.shape, y, first, end, k + 1), n


def component_boxes(label: np.ndarray, n: int) -> np.ndarray:
    """Rows (pixels, x0, y0, x1, y1) of the components 1..n."""
    h, w = label.shape
    p = np.zeros((h, w + 1), label.dtype)
    p[:, :w] = label
    p = p.ravel()
    turn = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if p.size else np.zeros(0, np.int64)
    k, end = p[turn], np.append(turn[1:], p.size)
    turn, end, k = turn[k > 0], end[k > 0], k[k > 0]
    y, first = np.divmod(turn, w + 1)
    return _boxes(y, first, end - y * (w + 1), k.astype(np.int64) - 1, n)


def filled(seed: np.ndarray, mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Components of mask that a seed touches; seeds outside of it don't count."""
    if not (seed > 0).any():
        return np.zeros(mask.shape, np.uint8)
    label, n = components(mask, diagonal)
    on = np.zeros(n + 1, bool)
    on[label[seed > 0]] = True
    on[0] = False
    return on[label].astype(np.uint8)


def _sweep(v: np.ndarray, mask: np.ndarray, axis: int) -> np.ndarray:
    """The darker of v spread along an axis in both directions as far as mask lets it: each pixel clamps what reaches it, and clamps compose by doubling."""
    for back in (False, True):
        a, m = (np.flip(x, axis) if back else x for x in (np.moveaxis(v, axis, 0), np.moveaxis(mask, axis, 0))) if axis == 0 else ((np.flip(x.T, 0) if back else x.T) for x in (v, mask))
        top, low = a.copy(), m.copy()  # what comes from before is made min(top, max(low, .))
        step = 1
        while step < len(top):
            new = top.copy()
            new[step:] = np.minimum(top[step:], np.maximum(low[step:], top[:-step]))
            wide = low.copy()
            wide[step:] = np.maximum(low[step:], low[:-step])
            top, low, step = new, wide, step * 2
        out = np.flip(top, 0) if back else top
        v = out if axis == 0 else out.T
    return np.ascontiguousarray(v)


def reconstructed(marker: np.ndarray, mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Gray reconstruction: the darker spreads from the marker, nowhere below the mask, until nothing changes."""
    at = np.maximum(marker, mask)
    while True:
        new = _sweep(_sweep(at, mask, 1), mask, 0)
        if diagonal:
            new = np.maximum(mask, darker(new, 3, 3))
        if (new == at).all():
            return at
        at = new


def _inside(own: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``_beside`` for columns between inked ones: all columns look aside by one step at a time; rows that are done go."""
    n, far = own.shape[1], 1 << 29 - bits
    out, left, rows = own.copy(), np.zeros(len(own), bool), np.arange(len(own))
    best, moved = out.copy(), np.empty_like(own)
    for k in range(1, n + 1):
        if k == n or k > most or int(best.max()) >> bits < k * k:
            break
        if k in (3, 6, 12, 24, 48):
            rest = best.max(axis=1) >> bits >= k * k
            if 4 * np.count_nonzero(rest) < 3 * len(rows):
                out[rows] = best
                rows, own, best = rows[rest], own[rest], best[rest]
                moved = np.empty_like(own)
        np.add(own, min(k * k, far) << bits, out=moved)
        np.minimum(best[:, k:], moved[:, :-k], out=best[:, k:])
        np.minimum(best[:, :-k], moved[:, k:], out=best[:, :-k])
    out[rows] = best
    high = best.max(axis=1) >> bits
    left[rows] = (high >= far) | ((high >= k * k) & (k < n))
    return out, left


def _outside(own: np.ndarray, aside: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``_beside`` for columns that stand so many steps outside of the first of own: they look at it, at the second, and so on."""
    n, far = own.shape[1], 1 << 29 - bits
    step = lambda j: np.minimum((aside + j) ** 2, far).astype(np.int32)
    out, left, rows = own[:, :1] + (step(0) << bits), np.zeros(len(own), bool), np.arange(len(own))
    best, moved = out.copy(), np.empty_like(out)
    for j in range(1, n + 1):
        if j == n or j > most:
            break
        if j in (1, 2, 4, 8, 16, 32):
            rest = (best >> bits >= step(j)).any(axis=1)
            if not rest.any():
                break
            if 4 * np.count_nonzero(rest) < 3 * len(rows):
                out[rows] = best
                rows, own, best = rows[rest], own[rest], best[rest]
                moved = np.empty_like(best)
        np.add(own[:, j, None], step(j) << bits, out=moved)
        np.minimum(best, moved, out=best)
    out[rows] = best
    high = best >> bits
    left[rows] = ((high >= far) | ((high >= step(j)) & (j < n))).any(axis=1)
    return out, left


def _beside(col: np.ndarray, bits: int, most: int = 64, cells: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least of col[x'] + (x - x')^2 in each row, its x' (of several the leftmost), and the rows where looking ``most`` columns aside wasn't enough.

    Distance and column are one number (the column takes its last bits), so that
    a step aside is an addition and two minima; rows go by blocks that stay in
    the cache.
    """
    h, w = col.shape
    key = col << bits | np.arange(w, dtype=np.int32)
    some = np.flatnonzero((col < 1 << 29 - bits).any(axis=0))
    if not len(some):
        return col, np.zeros((h, w), np.int32), np.ones(h, bool)
    x0, x1 = int(some[0]), int(some[-1]) + 1
    out, left = np.empty_like(key), np.zeros(h, bool)
    size = max(1, cells // w)
    narrow = w * (x1 - x0) <= 1 << 16
    if narrow:  # all pairs of columns, for what a few steps leave
        all_ = np.minimum(np.square(np.arange(w)[:, None] - np.arange(x0, x1)), 1 << 29 - bits).astype(np.int32) << bits
    for y in range(0, h, size):
        own, to, open_ = key[y : y + size, x0:x1], out[y : y + size], left[y : y + size]
        to[:, x0:x1], open_[:] = _inside(own, bits, 2 if narrow else most)
        for at, columns, aside in ((slice(0, x0), own, x0 - np.arange(x0)), (slice(x1, w), own[:, ::-1], np.arange(1, w - x1 + 1))):
            if len(aside):
                to[:, at], more = _outside(columns, aside, bits, 3 if narrow else most)
                open_ |= more
        if narrow and open_.any():
            rows = np.flatnonzero(open_)
            for part in np.array_split(rows, -(-len(rows) * all_.size // (1 << 18))):
                to[part] = (own[part][:, None, :] + all_).min(axis=2)
            open_[rows] = (to[rows] >> bits >= 1 << 29 - bits).any(axis=1)
    return out >> bits, out & ((1 << bits) - 1), left


def nearest(on: np.ndarray, scale: int = 1, steps: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance to the nearest pixel that is on (FAR where there is none), and that pixel's flat index, of several the leftmost's, then the topmost's; vertical steps count scale times.

    Columns first (the nearest on pixel above or below).  Then columns one, two
    and more steps aside are looked at: with ``steps``, by the pixels whose
    distance is no shorter than the step, ``steps`` looks a pixel at most;
    otherwise by whole rows.  Where that isn't enough, the lower envelope of the
    columns' parabolas, for all such rows at once.
    """
    h, w = on.shape
    if not w or not h or not on.any():
        return np.full((h, w), FAR), np.full((h, w), -1 if on.size else 0, np.int64)
    rows, none = np.arange(h, dtype=np.int32)[:, None], np.int32(1 << 29)
    above = np.maximum.accumulate(np.where(on, rows, -none), axis=0)
    below = np.minimum.accumulate(np.where(on, rows, none)[::-1], axis=0)[::-1]
    up, down = rows - above, below - rows
    site = np.where(up <= down, above, below)
    d = np.minimum(up, down)
    whole = lambda d: np.where(d < none >> 1, (d.astype(np.int64) * scale) ** 2, FAR)
    if not steps:
        bits = max(1, (w - 1).bit_length())
        far = 1 << 29 - bits
        best, at, left = _beside(np.where(d < far**0.5 / scale, np.square(d * scale), far).astype(np.int32), bits)
        if left.any():
            best, at = best.astype(np.int64), at.astype(np.int64)
            best[left], at[left] = _envelope(whole(d[left]))
        line = rows.astype(np.int64) * w
        return best.astype(np.int64, copy=False), site.take(line + at) * np.int64(w) + at
    col = whole(d)
    best, at = col.ravel().copy(), np.tile(np.arange(w), h)
    flat, left = col.ravel(), steps * h * w
    open_ = np.arange(h * w)
    for k in range(1, w):
        open_ = open_[best[open_] >= k * k]
        left -= len(open_)
        if not len(open_) or left < 0:
            break
        x = open_ % w
        for p, ties in ((open_[x >= k], True), (open_[x < w - k], False)):
            q = p - k if ties else p + k
            d = flat[q] + k * k
            take = (d <= best[p]) if ties else (d < best[p])
            p = p[take]
            best[p], at[p] = d[take], q[take] % w
    best, at = (best.reshape(h, w), at.reshape(h, w)) if left >= 0 else _envelope(col)
    return best, site.ravel()[np.arange(h)[:, None] * w + at].astype(np.int64) * w + at


def _envelope(col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least of col[x'] + (x - x')^2 in each row, and its x', of several the leftmost, by the lower envelope of parabolas; some column of a row isn't FAR."""
    h, w = col.shape
    place = np.zeros((h, w), np.int32)  # column of the k-th parabola of each row's envelope
    start = np.zeros((h, w), np.int64)  # and the first column where it is the lowest
    last = np.zeros(h, np.int64)
    line = np.arange(h)
    for x in range(1, w):
        open_ = np.ones(h, bool)
        begin = np.zeros(h, np.int64)
        while True:
            v = place[line, last]
            num = (col[:, x] + x * x) - (col[line, v] + v.astype(np.int64) ** 2)
            cross = num // (2 * np.maximum(x - v, 1)) + 1  # from here on x is lower
            pop = open_ & (cross <= start[line, last]) & (last > 0)
            gone = open_ & (cross <= start[line, last]) & (last == 0)
            begin = np.where(open_ & ~pop, np.where(gone, 0, cross), begin)
            done = open_ & ~pop
            if gone.any():
                place[gone, 0], start[gone, 0] = x, 0
            push = done & ~gone & (cross < w)
            if push.any():
                r = line[push]
                last[r] += 1
                place[r, last[r]], start[r, last[r]] = x, cross[push]
            open_ = pop
            if not pop.any():
                break
            last[pop] -= 1
    mark = np.zeros((h, w), np.int64)
    keep = np.arange(w)[None, :] <= last[:, None]
    r, k = np.nonzero(keep)
    np.maximum.at(mark, (r, np.minimum(start[r, k], w - 1)), k)
    which = np.maximum.accumulate(mark, axis=1)
    v = place[line[:, None], which]
    return col[line[:, None], v] + (np.arange(w)[None, :] - v) ** 2, v.astype(np.int64)


def distances(bw: np.ndarray, white: bool = True, border: bool = False) -> np.ndarray:
    """Squared distance of each pixel to the nearest white (or black) one, -1 where there is none; border: the outside counts as one."""
    on = (bw == 0) if white else (bw > 0)
    if border:
        on = np.pad(on, 1, constant_values=True)
    d, _ = nearest(on, steps=6 if white else 0)  # strokes are thin, paper is wide
    d = np.where(d >= FAR, -1, d)
    return d[1:-1, 1:-1] if border else d


def zones(label: np.ndarray) -> np.ndarray:
    """Label of the nearest labelled pixel; 0 without any."""
    _, at = nearest(label > 0)
    return np.where(at < 0, 0, label.ravel()[np.maximum(at, 0)])


def eroded_points(bw: np.ndarray) -> np.ndarray:
    """1 on the plateaus of the distance to white that no higher pixel touches."""
    d = distances(np.pad(bw, 1))[1:-1, 1:-1] if bw.size else bw.astype(np.int64)
    around = spread(d, (-1, 1), (-1, 1), False, 0)
    level = (d > 0) & (around == d)
    # a plateau that touches a higher pixel anywhere isn't a peak
    label, n = _plateaus(d)
    low = np.zeros(n + 1, bool)
    np.logical_or.at(low, label[(d > 0) & ~level], True)
    return (level & ~low[label]).astype(np.uint8)


def _plateaus(d: np.ndarray) -> tuple[np.ndarray, int]:
    """Components of equal positive values that touch, corners included."""
    out, n = np.zeros(d.shape, np.int64), 0
    for v in np.unique(d[d > 0]):
        label, k = components((d == v).astype(np.uint8), True)
        out[label > 0] = label[label > 0] + n
        n += k
    return out, n


# Level -> share of a component's pixels that what it hangs on has at least, pixels of distance a pixel of it reaches (squared), side of a big component; at 300 dpi.
DESPECKLE = {"cautious": (0.125, 10.0 * 10.0, 7), "normal": (0.175, 6.5 * 6.5, 12), "aggressive": (0.225, 3.5 * 3.5, 17)}


def despeckled(bw: np.ndarray, dpi: int = 300, level: str = "normal") -> np.ndarray:
    """Big components, and small ones that hang on a kept component by a chain of close and comparable neighbours.

    Neighbours are components whose zones touch, where vertical distances count
    double; a component hangs on a neighbour within its reach (squared distance
    up to its pixels times the level's factor) that has the level's share of its
    pixels at least.  Big components count as one that is larger than any.
    """
    share, reach, side = DESPECKLE[level]
    share, side = share * dpi / 300.0, int(np.floor(side * dpi / 300.0 + 0.5))
    y, first, end, k, n = _linked(bw, True)
    box = _boxes(y, first, end, k, n)
    big = (box[:, 3] - box[:, 1] + 1 >= side) | (box[:, 4] - box[:, 2] + 1 >= side)
    if big.all():
        return (bw > 0).astype(np.uint8) if n else bw.copy()
    kept = np.zeros(n + 1, bool)
    if big.any():
        pixels = np.append(bw.size, np.where(big, bw.size, box[:, 0])).astype(float)  # 0 stands for the big ones
        of = np.where(big, 0, np.arange(1, n + 1)).astype(np.int32)
        w = bw.shape[1]

        def hanging(p: np.ndarray, q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            on, to = [], []
            for a, b in ((p, q), (q, p)):
                m = (a > 0) & (d <= pixels[a] * reach) & (pixels[b] >= pixels[a] * share)
                on.append(b[m])
                to.append(a[m])
            return np.concatenate(on), np.concatenate(to)

        # runs of a line up to three white pixels apart: nothing is nearer to these, so zones touch there
        zone, gap = of[k], first[1:] - end[:-1]
        i = np.flatnonzero((y[1:] == y[:-1]) & (gap <= 3) & (zone[1:] != zone[:-1]))
        ways = hanging(zone[i], zone[i + 1], (gap[i] + 1) ** 2)
        kept = _reached(*ways, n + 1)
        if (big | kept[1:]).all():
            return (bw > 0).astype(np.uint8)
        _, at = nearest(bw > 0, 2)
        at = at.ravel()
        zone = _painted(bw.shape, y, first, end, of[k]).ravel()[at]
        i = np.flatnonzero(zone[:-1] != zone[1:])
        i = i[i % w != w - 1]
        j = np.flatnonzero(zone[:-w] != zone[w:])
        i, j = np.append(i, j), np.append(i + 1, j + w)
        (y0, x0), (y1, x1) = np.divmod(at[i], w), np.divmod(at[j], w)
        kept = _reached(*hanging(zone[i], zone[j], (x0 - x1) ** 2 + 4 * (y0 - y1) ** 2), n + 1)
    return _painted(bw.shape, y, first, end, (big | kept[1:])[k], np.uint8)


def _reached(on: np.ndarray, to: np.ndarray, n: int, rounds: int = 16) -> np.ndarray:
    """Which of n nodes are reached from node 0 over edges: all at once for some rounds, then one by one."""
    kept = np.arange(n) == 0
    for _ in range(rounds):
        step = kept[on]
        if not step.any():
            return kept
        kept[to[step]] = True
        rest = ~kept[to]
        on, to = on[rest], to[rest]
    ways: dict[int, list[int]] = {}
    for a, b in zip(on.tolist(), to.tolist(), strict=True):
        ways.setdefault(a, []).append(b)
    todo = deque(a for a in ways if kept[a])
    while todo:
        for b in ways.get(todo.popleft(), ()):
            if not kept[b]:
                kept[b] = True
                todo.append(b)
    return kept


# --- skew -------------------------------------------------------------------------------------------------------


def skew_score(bw: np.ndarray, degrees: float, ratio: float = 1.0) -> float:
    """Squared steps between the black counts of neighbouring rows once columns are sheared by the angle."""
    h, w = bw.shape
    shift = np.floor(np.tan(np.radians(degrees)) / ratio * (np.arange(w) + 0.5 - 0.5 * w) + 0.5).astype(int)
    y, x = np.nonzero(bw)
    at = y + shift[x]
    at = at[(at >= 0) & (at < h)]
    return float((np.diff(np.bincount(at, minlength=h).astype(np.int64)) ** 2).sum())


def find_skew(bw: np.ndarray, most: float = 7.0, accuracy: float = 0.1, coarse: int = 2, fine: int = 1, low: float = 1000.0) -> tuple[float, float]:
    """Angle that turns lines level, and confidence (the best score over the mean of the coarse ones, less one; accepted from 2.0 on)."""
    images = [bw]
    for k in range(max(coarse, fine)):
        images.append(reduced(images[-1], 1 if k == 0 else 2) if min(images[-1].shape) > 1 else images[-1])
    angles = np.arange(-most, most + 1e-9, 1.0)
    scores = np.array([skew_score(images[coarse], a) for a in angles])
    best = float(angles[int(scores.argmax())]) if scores.max() > 0 else -most
    lo, hi = best - 0.5, best + 0.5
    s_lo, s_hi = skew_score(images[fine], lo), skew_score(images[fine], hi)
    while hi - lo > accuracy and s_lo != s_hi:
        mid = (lo + hi) / 2
        if s_hi > s_lo:
            lo, s_lo = mid, skew_score(images[fine], mid)
        else:
            hi, s_hi = mid, skew_score(images[fine], mid)
    angle, score = (hi, s_hi) if s_hi > s_lo else (lo, s_lo)
    if score <= low or not scores.sum():
        return -angle, 0.0
    return -angle, score / scores.mean() - 1.0


def without_shadows(bw: np.ndarray, dpi: int) -> np.ndarray:
    """bw without what hangs on long horizontal bars (200 x 14 at 150 dpi), found at half sizes below 200 dpi."""
    small, at = bw, dpi
    while at >= 200 and min(small.shape) > 1:
        small, at = reduced(small, 2), at // 2
    brick = (max(1, round(200 * at / 150)), max(1, round(14 * at / 150)))
    bars = opened(small, *brick)
    times = max(1, bw.shape[0] // max(1, small.shape[0]))
    seed = np.zeros_like(bw)
    up = bars.repeat(times, axis=0).repeat(times, axis=1)[: bw.shape[0], : bw.shape[1]]
    seed[: up.shape[0], : up.shape[1]] = up
    return bw & (1 - filled(seed, bw, True))


# --- pictures, backgrounds, boxes -------------------------------------------------------------------------------


def stretched(g: np.ndarray, dark: float, light: float, times: int = 1) -> np.ndarray:
    """Contrast stretch that clips shares of the pixels from both ends; a share of one or more is a level. times: pixels that each stands for."""
    return _stretch(histogram(g) * times, dark, light).take(g)


def _stretch(h: np.ndarray, dark: float, light: float) -> np.ndarray:
    """``stretched`` of each level, from a histogram."""
    n = h.sum()
    up, down = np.cumsum(h), np.cumsum(h[::-1])
    lo = int(dark) if dark >= 1 else int(np.searchsorted(up, n * dark, "right"))
    hi = int(light) if light >= 1 else 255 - int(np.searchsorted(down, n * light, "right"))
    lo, hi = min(lo, 255), max(hi, 0)
    level = np.arange(256)
    if lo >= hi:
        return np.where(level < (lo + hi) // 2, 0, 255).astype(np.uint8)
    return ((255 * (np.clip(level, lo, hi) - lo) + (hi - lo) // 2) // (hi - lo)).astype(np.uint8)


def pictures(g: np.ndarray) -> np.ndarray:
    """Picture map, dark where pictures are: gradients that outlast a 35 pixel opening by reconstruction, with their holes filled."""
    s = stretched(g, 0.01, 0.01)
    dark, light = darker(s, 3, 3), lighter(s, 3, 3)
    gradient = (255 - (255 - dark.astype(np.int64)) * light // 255).astype(np.uint8)
    marker = lighter(gradient, 35, 35)
    kept = reconstructed(marker, gradient)
    inverse = 255 - kept
    frame = np.full_like(inverse, 255)
    frame[[0, -1]], frame[:, [0, -1]] = inverse[[0, -1]], inverse[:, [0, -1]]
    return 255 - reconstructed(frame, inverse)


def resized(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Gray at another size, each pixel the mean of the area it covers."""
    if g.shape == (height, width):
        return g.astype(np.uint8)

    def along(a: np.ndarray, m: int) -> np.ndarray:
        n = len(a)
        s = np.zeros((n + 1, a.shape[1]))
        np.cumsum(a, axis=0, out=s[1:])
        edge = np.arange(m + 1) * n / m
        k = np.minimum(edge.astype(int), n)
        at = s[k] + (edge - k)[:, None] * a[np.minimum(k, n - 1)]  # the last edge has no share of a line
        return np.diff(at, axis=0) / np.diff(edge)[:, None]

    v = along(along(g.astype(float), height).T, width).T
    return np.clip(np.floor(v + 0.5 - 1e-9), 0, 255).astype(np.uint8)


def content_mask(g: np.ndarray, dpi: int, level: int = 48) -> np.ndarray:
    """Binarisation mask, 1 where no picture is: pictures at 300 dpi, back at the size of g, below the level."""
    h, w = g.shape
    if _without_pictures(g, dpi):
        return np.full((h, w), int(255 >= level), np.uint8)
    big = g if dpi == 300 else resized(g, max(1, round(h * 300 / dpi)), max(1, round(w * 300 / dpi)))
    return (resized(pictures(big), h, w) >= level).astype(np.uint8)


def _without_pictures(g: np.ndarray, dpi: int) -> bool:
    """Whether ``pictures`` at 300 dpi surely finds none (255 throughout), seen at the size of g.

    At 300 dpi a pixel is a block of equal ones.  The middle of a block of three
    has no gradient where it is black or white once stretched; where each window
    of 35 pixels (eleven blocks at least) holds such a middle, the opening is
    white everywhere, and so is all that follows.
    """
    if dpi <= 0 or 300 % dpi or 300 // dpi < 3 or not g.size:
        return False
    times = 300 // dpi
    s = _stretch(histogram(g) * (times * times), 0.01, 0.01).astype(np.int64)
    flat = ((255 - s) * s < 255).astype(np.uint8).take(g)
    blocks = 2 * ((17 - times // 2) // times) + 1
    return blocks > 0 and bool(lighter(flat, blocks, blocks).all())


def binarized(g: np.ndarray, method: str, size: int = 51, k: float = 0.34, delta: int = 0, mask: np.ndarray | None = None) -> np.ndarray:
    """One of eight methods by name, white outside of the mask; Otsu's histogram is that of the mask."""
    if method == "otsu":
        t = otsu(histogram(g, None if mask is None or mask.all() else mask))
        out = (g < min(max(t + delta, 30), 225)).astype(np.uint8)
    elif method in BINARIZERS:
        out = BINARIZERS[method](g, size, k, delta)
    else:
        raise ValueError(f"no method {method}")
    return out if mask is None else out & mask


BINARIZERS = {
    "sauvola": lambda g, size, k, delta: sauvola(g, size, k, delta),
    "wolf": lambda g, size, k, delta: wolf(g, size, k, 1, 254, delta),
    "bradley": lambda g, size, k, delta: bradley(g, size, k, delta),
    "grad": lambda g, size, k, delta: grad(g, size, k, delta),
    "edgeplus": lambda g, size, k, delta: edge_div(g, size, k, 0.0, delta),
    "blurdiv": lambda g, size, k, delta: edge_div(g, size, 0.0, k, delta),
    "edgediv": lambda g, size, k, delta: edge_div(g, size, k, k, delta),
}


@lru_cache(64)
def _powers(n: int, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orthonormal polynomials up to a degree over n points from -1 to 1, the products of two of them, and powers up to twice the degree."""
    t = np.linspace(-1, 1, n) if n > 1 else np.zeros(1)
    q = np.linalg.qr(np.vander(t, degree + 1, increasing=True))[0] if n > degree else np.ones((n, 1)) / np.sqrt(n)
    return q, (q[:, :, None] * q[:, None, :]).reshape(n, -1), np.vander(t, 2 * degree + 1, increasing=True)


def fitted_line(values: np.ndarray, on: np.ndarray, degree: int) -> np.ndarray:
    """Least-squares polynomial over the points that are on, at every point; their mean where they are too few."""
    n = len(values)
    t = np.linspace(-1, 1, n) if n > 1 else np.zeros(1)
    if on.sum() <= degree:
        return np.full(n, values[on].mean() if on.any() else 255.0)
    return np.polynomial.polynomial.polyval(t, np.polynomial.polynomial.polyfit(t[on], values[on], degree))


def fitted_lines(lines: np.ndarray, on: np.ndarray, degree: int) -> np.ndarray:
    """``fitted_line`` of each line: whole ones by one projection, those with most points by their normal equations at once, others singly."""
    values, n = lines.astype(float), lines.shape[1]
    if n <= degree:
        return np.stack([fitted_line(v, s, degree) for v, s in zip(values, on, strict=True)])
    q, products, _ = _powers(n, degree)
    fit = values @ q @ q.T
    count = on.sum(axis=1)
    some = np.flatnonzero((count < n) & (2 * count >= n) & (count > 4 * degree))
    if len(some):
        m = (on[some].astype(float) @ products).reshape(len(some), degree + 1, degree + 1)
        sound = np.linalg.eigvalsh(m)[:, 0] > 1e-6
        some, m = some[sound], m[sound]
        fit[some] = np.linalg.solve(m, (np.where(on[some], values[some], 0.0) @ q)[:, :, None])[:, :, 0] @ q.T
    rest = count < n
    rest[some] = False
    for k in np.flatnonzero(rest):
        fit[k] = fitted_line(values[k], on[k], degree)
    return fit


def surface(g: np.ndarray, on: np.ndarray, dx: int, dy: int, ridge: float = 1e-6) -> np.ndarray:
    """Least-squares polynomial surface of degrees dx, dy over the pixels that are on, as gray; its normal equations are moments of the mask."""
    h, w = g.shape
    n = int(np.count_nonzero(on))
    if not n:
        return np.full((h, w), 255, np.uint8)
    py, px = _powers(h, dy)[2], _powers(w, dx)[2]
    weight = on.astype(float)
    moments = py.T @ weight @ px
    i, j = np.arange(dy + 1), np.arange(dx + 1)
    size = (dy + 1) * (dx + 1)
    m = moments[(i[:, None] + i)[:, None, :, None], (j[:, None] + j)[None, :, None, :]].reshape(size, size) + ridge * n * np.eye(size)
    py, px = py[:, : dy + 1], px[:, : dx + 1]
    c = np.linalg.solve(m, (py.T @ (weight * g) @ px).ravel()).reshape(dy + 1, dx + 1)
    return np.clip(np.floor(py @ c @ px.T + 0.5), 0, 255).astype(np.uint8)


@lru_cache(4096)
def _even_surface(h: int, w: int, value: int) -> np.ndarray:
    """The surface through paper of one level."""
    out = surface(np.full((h, w), value, np.uint8), erode(np.ones((h, w), np.uint8), 3, 3) > 0, 5, 5)
    return np.broadcast_to(out[:1, :1], out.shape) if (out == out[0, 0]).all() else out


def background(g: np.ndarray, most: int = 300) -> np.ndarray:
    """Background of a page: text closed over at 300 pixels a side at most, points below their column's and row's polynomial left out, and a surface through the rest."""
    h, w = g.shape
    k = max(1, -(-max(h, w) // most))
    small = resized(g, max(1, h // k), max(1, w // k))
    wide, high = min(15, small.shape[1] | 1), min(15, small.shape[0] | 1)
    paper = lighter(small, 1, high)
    if (paper != paper[0, 0]).any():  # else closed already
        paper = darker(lighter(paper, wide, 1), wide, high)
    if (paper == paper[0, 0]).all():  # each point is on its polynomials
        return resized_up(_even_surface(*paper.shape, int(paper[0, 0])), h, w)
    on = np.ones(paper.shape, bool)
    for axis, degree in ((0, 2), (1, 4)):
        lines = np.moveaxis(paper, axis, 1) if axis == 0 else paper
        keep = np.moveaxis(on, axis, 1) if axis == 0 else on
        good = lines >= fitted_lines(lines, keep, degree) - 10
        on &= np.moveaxis(good, 1, axis) if axis == 0 else good
    sure = erode(on.astype(np.uint8), 3, 3) > 0
    return resized_up(surface(paper, sure if sure.any() else on, 5, 5), h, w)


def resized_up(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Gray at a larger size, linearly between the centres of its pixels."""
    if g.strides == (0, 0):  # of one level
        return np.broadcast_to(g[:1, :1], (height, width))
    if g.shape == (height, width):
        return g
    y = np.clip((np.arange(height) + 0.5) * g.shape[0] / height - 0.5, 0, g.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * g.shape[1] / width - 0.5, 0, g.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, g.shape[0] - 1), np.minimum(x0 + 1, g.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    across = (1 - fx) * g[:, x0] + fx * g[:, x1]
    v = (1 - fy) * across[y0] + fy * across[y1]
    return np.floor(v + 0.5).astype(np.uint8)


@lru_cache(1)
def _evened() -> np.ndarray:
    """Pixel over background, for all pairs: row of the background's level, column of the pixel's."""
    b, v = np.arange(256)[:, None], np.arange(256)[None, :]
    return np.where(b <= v, 255, (255 * v + b // 2) // np.maximum(b, 1)).astype(np.uint8)


def lit(g: np.ndarray) -> np.ndarray:
    """Illumination evened out: pixels divided by the background, white where they reach it."""
    b = background(g)
    if b.strides == (0, 0) and b.size:
        return _evened()[b[0, 0]].take(g)
    return _evened().ravel().take((b.astype(np.uint16) << 8) | g)


def white_rectangles(bw: np.ndarray, most: int, least: tuple[int, int] = (1, 1), rounds: int = 1000, key=None) -> list[tuple[int, int, int, int]]:
    """Up to ``most`` white rectangles (x0, y0, x1, y1; ends left out), best first; each is an obstacle to the next.

    Branch and bound: a region without black or obstacles is a result, any
    other is cut at a black pixel or obstacle near its middle into the four
    parts beside it.  key orders regions by what they could hold (area).
    """
    h, w = bw.shape
    s = np.zeros((h + 1, w + 1), np.int64)
    s[1:, 1:] = bw.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    ys, xs = np.nonzero(bw)
    key = key or (lambda r: (r[2] - r[0]) * (r[3] - r[1]))
    found: list[tuple[int, int, int, int]] = []
    heap: list[tuple[float, tuple[int, int, int, int], int]] = []

    def push(r: tuple[int, int, int, int], known: int) -> None:
        if r[2] - r[0] >= least[0] and r[3] - r[1] >= least[1]:
            heapq.heappush(heap, (-key(r), r, known))

    push((0, 0, w, h), 0)
    seen = set()
    while heap and len(found) < most and rounds > 0:
        rounds -= 1
        _, r, known = heapq.heappop(heap)
        x0, y0, x1, y1 = r
        hit = next((o for o in found if o[0] < x1 and o[2] > x0 and o[1] < y1 and o[3] > y0), None)
        if hit is None and s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0] > 0:
            inside = (xs >= x0) & (xs < x1) & (ys >= y0) & (ys < y1)
            px, py = xs[inside], ys[inside]
            k = int(((2 * px - x0 - x1) ** 2 + (2 * py - y0 - y1) ** 2).argmin())
            hit = (int(px[k]), int(py[k]), int(px[k]) + 1, int(py[k]) + 1)
        if hit is None:
            found.append(r)
            continue
        for part in ((x0, y0, hit[0], y1), (hit[2], y0, x1, y1), (x0, y0, x1, hit[1]), (x0, hit[3], x1, y1)):
            if part not in seen and part[0] < part[2] and part[1] < part[3]:
                seen.add(part)
                push(part, known)
    return found


def rectangles(mask: np.ndarray, overlap: int = 16, sensitivity: int = 100) -> list[tuple[int, int, int, int]]:
    """Rectangles (x0, y0, x1, y1; ends left out) that cover the black of a mask.

    Boxes of its components are joined while they meet or lie within overlap
    pixels; at a sensitivity below 100 a box is cut to the lines that hold that
    share of the box's fullest line.
    """
    label, n = components(mask, True)
    boxes = [(int(a), int(b), int(c) + 1, int(d) + 1) for _, a, b, c, d in component_boxes(label, n)] if n else []
    joined = True
    while joined:
        joined, out = False, []
        for r in boxes:
            k = next((i for i, o in enumerate(out) if r[0] - overlap < o[2] and o[0] - overlap < r[2] and r[1] - overlap < o[3] and o[1] - overlap < r[3]), None)
            if k is None:
                out.append(r)
            else:
                o = out[k]
                out[k], joined = (min(r[0], o[0]), min(r[1], o[1]), max(r[2], o[2]), max(r[3], o[3])), True
        boxes = out
    if sensitivity < 100:
        boxes = [_tight(mask, r, sensitivity) for r in boxes]
    return sorted(boxes, key=lambda r: (r[1], r[0]))


def _tight(mask: np.ndarray, r: tuple[int, int, int, int], sensitivity: int) -> tuple[int, int, int, int]:
    part = mask[r[1] : r[3], r[0] : r[2]]
    out = []
    for axis in (0, 1):
        n = part.sum(axis=axis, dtype=np.int64)
        on = np.flatnonzero(100 * n >= (100 - sensitivity) * n.max())
        out.append((int(on[0]), int(on[-1]) + 1))
    (a, b), (c, d) = out
    return r[0] + a, r[1] + c, r[0] + b, r[1] + d


def line_finder(points: np.ndarray, most: int, least: int, width: float = 1.0, steps: float = 0.05) -> list[tuple[float, float, int]]:
    """Lines (angle in radians, distance from the origin, points) of at least ``least`` points within ``width``, best first.

    Best-first search over ranges of angle and distance: a range's bound is the
    number of points that some line of it comes near; ranges are halved until
    the angle is exact to ``steps`` and the distance to ``width``.  A line's
    points are gone for the next one.
    """
    left = points.astype(float)
    out = []
    while len(out) < most and len(left) >= least:
        far = float(np.hypot(*np.abs(left).max(axis=0))) + 1.0
        heap: list[tuple[int, int, tuple[float, float, float, float], np.ndarray]] = [(-len(left), 0, (0.0, np.pi, -far, far), np.arange(len(left)))]
        count, best = 1, None
        while heap:
            bound, _, (a0, a1, d0, d1), near = heapq.heappop(heap)
            if -bound < least:
                break
            if a1 - a0 <= steps and d1 - d0 <= width:
                best = ((a0 + a1) / 2, (d0 + d1) / 2, near)
                break
            cut = [((a0, (a0 + a1) / 2), (d0, d1)), (((a0 + a1) / 2, a1), (d0, d1))] if a1 - a0 > steps and (a1 - a0) * far >= d1 - d0 else [((a0, a1), (d0, (d0 + d1) / 2)), ((a0, a1), ((d0 + d1) / 2, d1))]
            for (b0, b1), (e0, e1) in cut:
                p = left[near]
                mid, half = (b0 + b1) / 2, (b1 - b0) / 2
                d = p[:, 0] * np.cos(mid) + p[:, 1] * np.sin(mid)
                slack = np.hypot(p[:, 0], p[:, 1]) * min(half, np.pi / 2) + width / 2
                inside = near[(d + slack >= e0) & (d - slack <= e1)]
                heapq.heappush(heap, (-len(inside), count, (b0, b1, e0, e1), inside))
                count += 1
        if best is None:
            break
        out.append((best[0], best[1], len(best[2])))
        left = np.delete(left, best[2], axis=0)
    return out


def fold_lines(g: np.ndarray, dpi: int = 100, most: int = 8) -> list[tuple[float, float]]:
    """Vertical lines of a spread at 100 dpi, as the columns where they cross the top and the bottom, from left to right.

    Dark stripes that are thin across and long down: the difference of lighter
    spreads along x and y, closed along y, votes for lines within 7 degrees of
    the vertical in steps of a quarter; of bins above 5 * 1.8 votes a row of the
    height those of lines that cross or nearly meet a stronger one go with it.
    """
    h, w = g.shape
    across, down = lighter(g, 11, 1, 0).astype(np.int64), lighter(g, 1, 11, 0).astype(np.int64)
    v = np.maximum(across - down, 0)
    v = spread(spread(v, (0, 0), centred(19), False, 0), (0, 0), centred(19), True, 255)
    side = int(np.ceil(3.5 / 25.4 * dpi))
    y, x = np.nonzero(v > 1)
    inside = (x >= side) & (x < w - side)
    y, x, n = y[inside], x[inside], v[y[inside], x[inside]].astype(float)
    if not len(y):
        return []
    angles = np.radians(np.arange(-7, 7.01, 0.25))
    reach = int(np.hypot(h, w)) // 5 + 4
    votes = np.stack([np.bincount(((x * np.cos(a) + (y - h / 2) * np.sin(a)) / 5 + 0.5 + reach // 2).astype(int), n / 25, minlength=2 * reach)[: 2 * reach] for a in angles])
    lines = []
    for k, b in sorted(zip(*np.nonzero(votes > h * 5 * 1.8 / 25), strict=True), key=lambda i: -votes[i]):
        a, d = angles[k], (b - reach // 2) * 5
        top, bottom = (d + h / 2 * np.sin(a)) / np.cos(a), (d - h / 2 * np.sin(a)) / np.cos(a)
        if not any(min(abs(top - p), abs(bottom - q)) <= 15 or (top - p) * (bottom - q) < 0 for p, q in lines):
            lines.append((float(top), float(bottom)))
        if len(lines) == most:
            break
    return sorted(lines, key=sum)


def page_layout_of(lines: list[tuple[float, float]], width: int, two_pages: bool) -> tuple[str, list[tuple[float, float]]]:
    """Kind of layout and its cutters from fold lines, by their centres.

    One page: uncut unless the first line, or the first and last of several, are
    within 0.35 of the half width of an edge.  Two pages: the line nearest the
    middle, if no further than 0.6 of the half width off it; else none.
    """
    middle = width / 2
    centre = lambda c: (c[0] + c[1]) / 2
    if not two_pages:
        near = lambda c: abs(middle - centre(c)) > 0.65 * middle
        if not lines or not (near(lines[0]) or (len(lines) > 1 and near(lines[-1]))):
            return "single_uncut", []
        if len(lines) > 1:
            return "single_cut", [lines[0], lines[-1]]
        only = lines[0]
        return "single_cut", [only, (float(width), float(width))] if centre(only) < middle else [(0.0, 0.0), only]
    if lines:
        best = min(lines, key=lambda c: abs(middle - centre(c)))
        if abs(middle - centre(best)) <= 0.6 * middle:
            return "two_pages", [best]
    return "unknown", []


def page_box(bw: np.ndarray, share: float = 0.95, gap: int = 10) -> tuple[int, int, int, int] | None:
    """The page (x0, y0, x1, y1; ends left out) within a black surround: from each edge inwards along the middle cross, lines that are black enough belong to the surround; more than gap lines of another kind end it."""
    h, w = bw.shape
    if not h or not w:
        return None
    rows = bw[:, w // 4 : max(w // 4 + 1, 3 * w // 4)].mean(axis=1)
    cols = bw[h // 4 : max(h // 4 + 1, 3 * h // 4)].mean(axis=0)

    def edge(v: np.ndarray) -> int:
        at = miss = 0
        for k, x in enumerate(v[: len(v) // 2]):
            if x >= share:
                at, miss = k + 1, 0
            else:
                miss += 1
                if miss > gap:
                    break
        return at

    return edge(cols), edge(rows), w - edge(cols[::-1]), h - edge(rows[::-1])


def content_box(g: np.ndarray, dpi: int = 150) -> tuple[int, int, int, int] | None:
    """Box of a page's content (x0, y0, x1, y1; ends left out) at 150 dpi, none for an empty page.

    Wolf's binarisation, less long shadows and what hangs on them, less
    speckles; white rectangles are carved out of what is left between; of the
    blocks that remain those count that hold text (rows of runs tall enough
    with ends of strokes in them) or enough ink; the box is trimmed to content.
    """
    k = dpi / 150
    bw = wolf(g, max(3, int(51 * k)), 0.3, 50)
    long_ = max(2, int(200 * k)), max(1, int(14 * k))
    if erode(bw, 1, min(long_)).any():
        garbage = filled(opened(bw, *long_) | opened(bw, *long_[::-1]), bw, True)
    else:  # no bar is that high
        garbage = np.zeros_like(bw)
    content = despeckled(bw & (1 - garbage), dpi)
    if not content.any():
        return None
    blocks = closed(content, max(3, int(15 * k)), max(3, int(9 * k)))
    label, n = components(blocks, False)
    box = component_boxes(label, n)
    ink = np.bincount(label[content > 0], minlength=n + 1)[1:]
    tall = box[:, 4] - box[:, 2] + 1 >= 3
    near = distances(garbage, white=False) if garbage.any() else None
    good = tall & (ink >= 6)
    if near is not None:  # a block on the edge that is nearer to a shadow than to other content goes
        rest = distances(content, white=False)
        for i in np.flatnonzero(good):
            _, x0, y0, x1, y1 = box[i]
            edge = x0 == 0 or y0 == 0 or x1 == g.shape[1] - 1 or y1 == g.shape[0] - 1
            if edge and 0 <= near[y0 : y1 + 1, x0 : x1 + 1].min() <= 1 and rest.max() > 0:
                good[i] = False
    if not good.any():
        return None
    x0, y0, x1, y1 = int(box[good, 1].min()), int(box[good, 2].min()), int(box[good, 3].max()) + 1, int(box[good, 4].max()) + 1
    keep = np.append(False, good)[label] & (content > 0)
    y, x = np.nonzero(keep)
    x0, y0, x1, y1 = int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1
    w, h = x1 - x0, y1 - y0
    if w < 8 or h < 8 or (w < 30 and h > 20 * w):
        return None
    return x0, y0, x1, y1


def polarity(g: np.ndarray) -> tuple[str, float]:
    """Whether a gray page is dark on light, with a confidence."""
    h, w = g.shape
    if not g.size:
        return "unknown", 0.0
    hist = histogram(g)
    n = hist.sum()
    dark, light = hist[:128].sum() / n, hist[128:].sum() / n
    b = min(max(5, min(w, h) // 50), min(w, h) // 4)
    parts = [g[:b], g[h - b :], g[b : h - b, :b], g[b : h - b, w - b :]]
    border = float(np.mean([p.mean() if p.size else 128.0 for p in parts])) if b else 128.0
    confidence = (abs(border - 128) / 128 + abs(dark - light)) / 2
    if border >= 128 and light > dark + 0.1:
        return "black_on_white", confidence
    if border < 128 and dark > light + 0.1:
        return "white_on_black", confidence
    lo, hi = peaks(hist)
    if lo is not None:
        if lo < 50 and hi > 200:
            return ("black_on_white" if border >= 128 else "white_on_black"), confidence
        return "mixed", confidence / 2
    mean = float((hist * np.arange(256)).sum() / n)
    if mean > 160 and border >= 128:
        return "black_on_white", confidence
    if mean < 96 and border < 128:
        return "white_on_black", confidence
    return "unknown", 0.3


def peaks(hist: np.ndarray) -> tuple[int | None, int | None]:
    """Dark and light peak of a histogram smoothed over five bins either way, none unless both stand twice as high as the valley between."""
    s = np.convolve(np.pad(hist.astype(float), 5, mode="edge"), np.ones(11) / 11, "valid")
    lo, hi = int(s[:128].argmax()), 128 + int(s[128:].argmax())
    valley = s[lo : hi + 1].min()
    return (lo, hi) if min(s[lo], s[hi]) > 2 * valley and min(s[lo], s[hi]) > 0 else (None, None)


def polarity_binary(bw: np.ndarray) -> tuple[str, float]:
    """The same of a binary page: its border first, then its share of black."""
    h, w = bw.shape
    if not bw.size:
        return "unknown", 0.0
    b = max(5, min(w, h) // 50)
    inner = bw[b : h - b, b : w - b] if h > 2 * b and w > 2 * b else bw[:0]
    total = bw.size - inner.size
    edge = (int(bw.sum()) - int(inner.sum())) / total if total else 0.5
    black = float(bw.mean())
    confidence = max(abs(edge - 0.5), abs(black - 0.5)) * 2
    if edge < 0.3:
        return "black_on_white", confidence
    if edge > 0.7:
        return "white_on_black", confidence
    if 1 - black > 0.6:
        return "black_on_white", confidence
    if black > 0.6:
        return "white_on_black", confidence
    return "mixed", confidence / 2


def needs_inversion(g: np.ndarray, mode: str = "auto", least: float = 0.7) -> bool:
    """Whether a page is to be inverted: forced by mode, else light on dark with that confidence."""
    if mode in ("normal", "inverted"):
        return mode == "inverted"
    kind, confidence = polarity(g)
    return kind == "white_on_black" and confidence >= least
