"""Dewarping: vertical bounds, text lines as curves, a model of two curves, and pages straightened between them.

A page is taken for a cylinder whose rulings run between a top and a bottom
curve: a ruling at share u of the arc length joins the points at that share on
both curves, and a pixel's place on it is linear.  Curves are columns of y over
x, a number for each column of the page.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from folioframe.operators import kernels as K


@lru_cache(1024)
def _tries(n: int, tries: int, seed: int) -> list[np.ndarray]:
    """Two random rows of n, for each try and side."""
    r = np.random.default_rng(seed)
    return [r.integers(0, n, (tries, 2)).T for _ in range(2)]


def vertical_bounds(bw: np.ndarray, tries: int = 64, seed: int = 0) -> tuple[tuple[float, float], tuple[float, float]] | None:
    """Left and right edge of the content as lines x = a + b y, each through two of the rows' first (last) black pixels, with the most rows close by; None for an empty page."""
    rows = np.flatnonzero(bw.any(axis=1))
    if len(rows) < 2:
        return None
    inked = bw[rows]
    first = inked.argmax(axis=1).astype(float)
    last = (bw.shape[1] - 1 - inked[:, ::-1].argmax(axis=1)).astype(float)
    out = []
    for x, outer, (i, j) in zip((first, last), (-1, 1), _tries(len(rows), tries, seed), strict=True):
        apart = rows[i] != rows[j]
        b = (x[j] - x[i]) / np.where(apart, rows[j] - rows[i], 1)
        use = apart & (np.abs(b) <= 0.3)
        a, b = (x[i] - b * rows[i])[use], b[use]
        off = (x - a[:, None] - b[:, None] * rows) * outer
        far = np.count_nonzero(off > 3, axis=1)
        good = np.count_nonzero(off >= -3, axis=1) - 3.0 * far  # close by less twice those beyond
        k = int(good.argmax()) if len(good) else -1
        out.append((float(a[k]), float(b[k])) if k >= 0 and good[k] > -1.0 else (float(np.median(x)), 0.0))
    return out[0], out[1]


def text_lines(g: np.ndarray, least: float = 0.25, edge: int = 2) -> list[np.ndarray]:
    """``text_lines_of`` one page."""
    return text_lines_of([g], least, edge)[0]


def text_lines_of(pages: list[np.ndarray], least: float = 0.25, edge: int = 2) -> list[list[np.ndarray]]:
    """Curves (points x, y) along the bottoms of text lines, top to bottom, of each page; snakes of all pages move together.

    Letters are smeared into lines by a closing along x; each component that is
    wide enough gives the middle of its columns, refined as a snake.  Lines that
    are short or run along the page's edge are left out.
    """
    points = [_middles(g, least, edge) for g in pages]
    some = [k for k, p in enumerate(points) if p]
    curves = snakes([K.mean_only(pages[k], 5) for k in some], [c for k in some for c in points[k]], np.repeat(np.arange(len(some)), [len(points[k]) for k in some])) if some else []
    out, at = [], 0
    for p in points:
        out.append(sorted(curves[at : at + len(p)], key=lambda c: float(np.add.reduce(c[:, 1]) / len(c))))
        at += len(p)
    return out


def _middles(g: np.ndarray, least: float, edge: int) -> list[np.ndarray]:
    """Points in the middle of the columns of each text line."""
    bw = K.wolf(g, 31, 0.3)
    h, w = bw.shape
    smear = K.closed(K.despeckled(bw, 150, "cautious"), max(3, w // 20) | 1, 1)
    y, first, end, k, n = K._linked(smear, True)
    if not n:
        return []
    box = K._boxes(y, first, end, k, n)
    wide = (box[:, 3] - box[:, 1] + 1 >= least * w) & (box[:, 2] >= edge) & (box[:, 4] < h - edge)
    if not wide.any():
        return []
    number = np.where(wide, np.cumsum(wide) - 1, -1)[k]
    on = number >= 0
    size, at = (end - first)[on], np.repeat(number[on] * w + first[on], (end - first)[on])
    at += np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    count = np.bincount(at, minlength=wide.sum() * w)
    total = np.bincount(at, np.repeat(y[on] - box[wide, 2][number[on]], size), minlength=wide.sum() * w)
    place = np.flatnonzero(count)
    of, x = np.divmod(place, w)
    points = np.empty((len(place), 2))
    points[:, 0], points[:, 1] = x, total[place] / count[place] + box[wide, 2][of]
    ends = [*(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    return [points[i : j : max(1, (j - i) // 32)] for i, j in zip([0, *ends[:-1]], ends, strict=True)]


def snake(blur: np.ndarray, points: np.ndarray, rounds: int = 8, stiff: float = 2.0) -> np.ndarray:
    """A curve moved up or down by single pixels towards dark rows of a blurred page while its bends stay small: each point takes the best of three places, all at once by dynamic programming."""
    return snakes([blur], [points], np.zeros(1, np.int64), rounds, stiff)[0]


def snakes(blurs: list[np.ndarray], curves: list[np.ndarray], of: np.ndarray, rounds: int = 8, stiff: float = 2.0) -> list[np.ndarray]:
    """``snake`` of each curve on the page that of names; a step of the programming goes over all curves that still move."""
    order = np.argsort([-len(c) for c in curves], kind="stable")  # those with a point k come first
    size = np.array([len(curves[i]) for i in order])
    x, y = (np.zeros((len(curves), size[0])) for _ in range(2))
    for r, i in enumerate(order):
        x[r, : size[r]], y[r, : size[r]], y[r, size[r] :] = curves[i][:, 0], curves[i][:, 1], curves[i][-1, 1]
    high, wide = np.array([b.shape for b in blurs]).T
    flat, base = np.concatenate([b.ravel() for b in blurs]), np.cumsum(high * wide) - high * wide
    h, w, base = (v[of[order]][:, None, None] for v in (high, wide, base))
    x = base + np.clip(x.astype(int)[:, :, None], 0, w - 1)
    # points first, then places, curves last: a step goes over lines of numbers
    x, y, h, w = x[:, :, 0].T, np.ascontiguousarray(y.T), h[:, 0, 0], w[:, 0, 0]
    moves, moving = np.array([-1.0, 0.0, 1.0])[:, None], np.arange(len(curves))
    for _ in range(rounds):
        at, n = y[: size[moving[0]], moving], size[moving]
        place = np.clip(at[:, None, :] + moves, 0, h[moving] - 1)
        cost = flat.take(np.rint(place).astype(int) * w[moving] + x[: len(at), None, moving])
        bend = np.diff(at, axis=0)
        total = cost[0].copy()
        back = np.zeros((len(at), 3, len(n)), np.int8)
        alive = np.searchsorted(-n, -np.arange(n[0]), "left")  # curves with more than i points
        for i in range(1, n[0]):
            m = alive[i]
            pull = place[i, None, :, :m] - place[i - 1, :, None, :m]  # from a to b
            pull -= bend[i - 1, :m]
            pull *= pull
            pull *= stiff
            pull += total[:, None, :m]
            a, b, c = pull
            low = np.minimum(a, b)
            back[i, :, :m] = np.where(c < low, 2, b < a)
            np.add(np.minimum(low, c, out=low), cost[i, :, :m], out=total[:, :m])
        k = total.argmin(axis=0)
        new, line = at.copy(), np.arange(len(n))
        for i in range(n[0] - 1, -1, -1):
            m = alive[i]
            new[i, :m] = place[i, k[:m], line[:m]]
            if i:
                k[:m] = back[i, k[:m], line[:m]]
        still = (new != at).any(axis=0)
        y[: len(at), moving[still]] = new[:, still]
        moving = moving[still]
        if not len(moving):
            break
    y = y.T
    out = [None] * len(curves)
    for r, i in enumerate(order):
        out[i] = curves[i].astype(float)
        out[i][:, 1] = y[r, : size[r]]
    return out


def shortest_path(cost: np.ndarray) -> np.ndarray:
    """For each column the row of the cheapest path from left to right that goes straight on or one row up or down."""
    h, w = cost.shape
    total, back = cost[:, 0].astype(float), np.zeros((w, h), np.int64)
    for x in range(1, w):
        p = np.pad(total, 1, constant_values=np.inf)
        three = np.stack([p[:-2], p[1:-1], p[2:]])
        k = three.argmin(axis=0)
        back[x] = np.clip(np.arange(h) + k - 1, 0, h - 1)
        total = three[k, np.arange(h)] + cost[:, x]
    out = np.empty(w, np.int64)
    out[-1] = int(total.argmin())
    for x in range(w - 1, 0, -1):
        out[x - 1] = back[x, out[x]]
    return out


def edges(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Top and bottom edge of a page on a darker ground, as a row for each column: cheapest paths along the steepest steps from dark to light in the upper, and from light to dark in the lower half."""
    v = K.mean_only(g, 3)
    step = np.diff(v, axis=0)
    half = max(1, step.shape[0] // 2)
    top = shortest_path(255.0 - np.clip(step[:half], 0, 255))
    bottom = shortest_path(255.0 - np.clip(-step[half:], 0, 255)) + half
    return top, bottom


def toward_line(cost: np.ndarray, start: tuple[int, int], row: int) -> list[tuple[int, int]]:
    """The cheapest path (x, y) from a point to a row, a row at a time, straight on or one column aside."""
    x0, y0 = start
    down = row >= y0
    part = cost[y0 : row + 1] if down else cost[row : y0 + 1][::-1]
    total = np.full(cost.shape[1], np.inf)
    total[x0] = part[0, x0]
    back = []
    for line in part[1:]:
        p = np.pad(total, 1, constant_values=np.inf)
        three = np.stack([p[:-2], p[1:-1], p[2:]])
        k = three.argmin(axis=0)
        back.append(np.clip(np.arange(len(total)) + k - 1, 0, len(total) - 1))
        total = three[k, np.arange(len(total))] + line
    x = int(total.argmin())
    path = [x]
    for b in reversed(back):
        x = int(b[x])
        path.append(x)
    return [(int(x), y0 + k if down else y0 - k) for k, x in enumerate(reversed(path))]


def fitted(points: np.ndarray, width: int, degree: int = 3) -> np.ndarray:
    """y over every column of a page from a curve's points: a least-squares polynomial, no wilder beyond its ends than a line."""
    x, y = points[:, 0], points[:, 1]
    degree = max(0, min(degree, len(x) - 1))
    scale = 2.0 / max(1, width - 1)  # columns from -1 to 1
    lhs = np.vander(-1.0 + scale * x, degree + 1, increasing=True)
    norm = np.sqrt((lhs * lhs).sum(axis=0))
    norm[norm == 0] = 1
    c = np.linalg.lstsq(lhs / norm, y, len(x) * np.finfo(float).eps)[0] / norm
    at = lambda v, c: np.polynomial.polynomial.polyval(-1.0 + scale * v, c)
    out = at(np.arange(width, dtype=float), c)
    slope = np.arange(1, degree + 1) * c[1:] * scale if degree else np.zeros(1)
    lo, hi = int(max(0, x.min())), int(min(width - 1, x.max()))
    out[:lo] = at(lo, c) + at(lo, slope) * (np.arange(lo) - lo)
    out[hi + 1 :] = at(hi, c) + at(hi, slope) * (np.arange(hi + 1, width) - hi)
    return out


def fitted_all(curves: list[np.ndarray], widths: list[int]) -> list[np.ndarray]:
    """``fitted`` of each curve for its page's width, those of one width with four points at least together."""
    out: list[np.ndarray | None] = [None] * len(curves)
    groups: dict[int, list[int]] = {}
    for k, (c, width) in enumerate(zip(curves, widths, strict=True)):
        if len(c) > 3 and width > 1:
            groups.setdefault(width, []).append(k)
        else:
            out[k] = fitted(c, width)
    for width, of in groups.items():
        size = np.array([len(curves[k]) for k in of])
        x, y = np.concatenate([curves[k] for k in of]).T
        start, scale = np.cumsum(size) - size, 2.0 / (width - 1)
        line, point = np.repeat(np.arange(len(of)), size), np.arange(len(x)) - np.repeat(start, size)
        lhs, rhs = np.zeros((len(of), int(size.max()), 4)), np.zeros((len(of), int(size.max()), 1))  # further points weigh nothing
        lhs[line, point], rhs[line, point, 0] = np.vander(-1.0 + scale * x, 4, increasing=True), y
        q, r = np.linalg.qr(lhs)
        low = np.abs(np.diagonal(r, axis1=1, axis2=2)).min(axis=1) < 1e-9
        r[low] = np.eye(4)
        c = np.linalg.solve(r, q.transpose(0, 2, 1) @ rhs)[:, :, 0].T[:, :, None]
        t = -1.0 + scale * np.arange(width, dtype=float)
        lo, hi = (np.clip(f.reduceat(x, start), 0, width - 1).astype(int)[:, None] for f in (np.minimum, np.maximum))
        curve = ((c[3] * t + c[2]) * t + c[1]) * t + c[0]
        for at, beyond in ((lo, np.arange(width) < lo), (hi, np.arange(width) > hi)):
            u = -1.0 + scale * at
            slope = ((3 * c[3] * u + 2 * c[2]) * u + c[1]) * scale
            curve = np.where(beyond, ((c[3] * u + c[2]) * u + c[1]) * u + c[0] + slope * (np.arange(width) - at), curve)
        for k, row, bad in zip(of, curve, low.tolist(), strict=True):
            out[k] = fitted(curves[k], width) if bad else row
    return out


def valid(top: np.ndarray, bottom: np.ndarray, least: float = 10.0) -> bool:
    """Whether two curves can carry a model: finite, apart by least everywhere, and their rulings don't cross."""
    return bool(len(top) == len(bottom) and len(top) > 1 and np.isfinite(top).all() and np.isfinite(bottom).all() and (bottom - top >= least).all())


def residual(curves: list[np.ndarray], top: np.ndarray, bottom: np.ndarray) -> float:
    """Mean distance of the curves from level lines once the page is straightened; 1000 more for a model that isn't valid."""
    return residuals(curves, [(top, bottom)])[0]


def residuals(curves: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """``residual`` of each pair of top and bottom curve: sums over the points of each curve."""
    out = np.full(len(pairs), 1000.0)
    if len({len(c) for p in pairs for c in p}) > 1:
        return [residuals(curves, [p])[0] if len(p[0]) == len(p[1]) else 1000.0 for p in pairs]
    if not pairs or not curves:
        return out.tolist()
    top, bottom = (np.stack([p[side] for p in pairs]) for side in (0, 1))
    gaps = bottom - top
    good = np.flatnonzero(np.isfinite(gaps).all(axis=1) & (gaps >= 10.0).all(axis=1) & (top.shape[1] > 1))  # valid
    top, gaps = top[good], gaps[good]
    if len(good):
        size = np.array([len(c) for c in curves])
        start, of = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        sums = lambda v: np.add.reduceat(v, start, axis=-1)
        x, y = np.concatenate(curves).T
        at = np.clip(np.round(x).astype(int), 0, top.shape[1] - 1)
        v = y - top.take(at, axis=1)
        v /= gaps.take(at, axis=1)
        v *= gaps.mean(axis=1)[:, None]
        off = x - (sums(x) / size).take(of)
        bend = sums(off * off)
        middle = sums(v) / size
        slope = np.where(bend > 0, sums(v * off) / np.where(bend > 0, bend, 1.0), 0.0)
        line = slope.take(of, axis=1)
        line *= off
        line += middle.take(of, axis=1)
        v -= line
        out[good] = (sums(np.abs(v, out=v)) / size).mean(axis=1)
    return out.tolist()


@lru_cache(1024)
def _pairs(n: int, more: int, seed: int) -> list[tuple[int, int]]:
    """Pairs of n lines to try: the first three with the last three, and some at random."""
    pairs = {(i, j) for i in range(min(3, n)) for j in range(max(0, n - 3), n) if i < j}
    r = np.random.default_rng(seed)
    for _ in range(more):
        i, j = sorted(r.integers(0, n, 2).tolist())
        if i < j:
            pairs.add((i, j))
    return sorted(pairs)


def model(g: np.ndarray, more: int = 10, seed: int = 0, curves: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Top and bottom curve of a page, from the pair of its text lines that leaves all lines straightest: the first three with the last three, and some at random; None for fewer than two lines. curves: the text lines, if they are known."""
    return models([g], [text_lines(g) if curves is None else curves], more, seed)[0]


def models(pages: list[np.ndarray], lines: list[list[np.ndarray]], more: int = 10, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """``model`` of each page from its text lines; the curves of all pages are fitted together."""
    tried = [_pairs(len(c), more, seed) if len(c) >= 2 and vertical_bounds(black(g)) is not None else [] for g, c in zip(pages, lines, strict=True)]
    need = [(p, k) for p, some in enumerate(tried) for k in sorted({k for pair in some for k in pair})]
    full = dict(zip(need, fitted_all([lines[p][k] for p, k in need], [pages[p].shape[1] for p, _ in need]), strict=True))
    out: list[tuple[np.ndarray, np.ndarray] | None] = []
    for p, (g, curves, some) in enumerate(zip(pages, lines, tried, strict=True)):
        best = some[int(np.argmin(residuals(curves, [(full[p, i], full[p, j]) for i, j in some])))] if some else None
        if best is None or not valid(full[p, best[0]], full[p, best[1]]):
            out.append(None)
            continue
        top, bottom = full[p, best[0]], full[p, best[1]]
        # the curves carried on to the page's upper and lower edge
        gap = bottom - top
        up, down = float((top / gap).min()), float(((g.shape[0] - 1 - bottom) / gap).min())
        out.append((top - up * gap, bottom + down * gap))
    return out


def black(g: np.ndarray) -> np.ndarray:
    return (g < K.otsu(K.histogram(g))).astype(np.uint8)


def arc(curve: np.ndarray) -> np.ndarray:
    """Share of the arc length at each column."""
    s = np.concatenate([[0.0], np.cumsum(np.hypot(1.0, np.diff(curve)))])
    return s / s[-1] if s[-1] > 0 else s


def to_page(top: np.ndarray, bottom: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Point of the warped page at shares u along and v down the straightened one."""
    at, columns = arc((top + bottom) / 2), np.arange(len(top), dtype=float)
    x = np.interp(u, at, columns)
    t, b = np.interp(x, columns, top), np.interp(x, columns, bottom)
    return x, t + v * (b - t)


def from_page(top: np.ndarray, bottom: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares along and down the straightened page of a point of the warped one."""
    columns = np.arange(len(top), dtype=float)
    t, b = np.interp(x, columns, top), np.interp(x, columns, bottom)
    return np.interp(x, columns, arc((top + bottom) / 2)), (y - t) / (b - t)


def straightened(g: np.ndarray, top: np.ndarray, bottom: np.ndarray, width: int | None = None, height: int | None = None, outside: int = 255) -> np.ndarray:
    """The page between two curves as a rectangle; each pixel is the mean of four points of the area that it comes from. Colour planes go one by one."""
    if g.ndim == 3:
        return np.stack([straightened(g[..., k], top, bottom, width, height, outside) for k in range(g.shape[2])], axis=-1)
    h, w = height or max(1, round(float((bottom - top).mean()))), width or g.shape[1]
    total = np.zeros((h, w), np.uint16)
    kept = np.pad(g, ((1, 1), (0, 0)), constant_values=outside).ravel()  # a line of the outside above and below
    py = np.empty((h, w))
    for dx in (0.25, 0.75):
        u = (np.arange(w) + dx) / w
        x, t = to_page(top, bottom, u, np.zeros(w))
        drop = to_page(top, bottom, u, np.ones(w))[1] - t
        px = np.clip(np.round(x), 0, g.shape[1] - 1) + g.shape[1]
        for dy in (0.25, 0.75):
            np.multiply(((np.arange(h) + dy) / h)[:, None], drop, out=py)
            py += t
            py += 0.5
            np.floor(py, out=py)
            np.clip(py, -1, g.shape[0], out=py)
            py *= g.shape[1]
            py += px
            total += kept.take(py.astype(np.intp))
    return (total + np.uint16(2) >> 2).astype(np.uint8)


def half_corrected(points: list[tuple[float, float]], upper: bool) -> list[tuple[float, float]]:
    """Control points of one half of a page moved to the mirror of the other half's about the middle column, where the half is unsure."""
    n = len(points)
    out = list(points)
    mid = (points[0][0] + points[-1][0]) / 2
    for k in range(n // 2):
        src, dst = (n - 1 - k, k) if upper else (k, n - 1 - k)
        out[dst] = (2 * mid - points[src][0], points[src][1])
    return out


def moved_points(points: list[tuple[float, float]], by: float) -> list[tuple[float, float]]:
    """Curve points moved away from the content by a share of the margin, ends more than the middle."""
    n = len(points)
    return [(x, y + by * (0.5 + abs(k - (n - 1) / 2) / max(1, n - 1))) for k, (x, y) in enumerate(points)]


def spline(points: np.ndarray, samples: int) -> np.ndarray:
    """Points of the natural cubic spline through control points, evenly over its parameter."""
    n = len(points)
    if n < 3:
        t = np.linspace(0, n - 1, samples)
        return np.column_stack([np.interp(t, np.arange(n), points[:, c]) for c in (0, 1)])
    a = np.eye(n)
    rhs = np.zeros((n, 2))
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = 1, 4, 1
        rhs[k] = 6 * (points[k - 1] - 2 * points[k] + points[k + 1])
    m = np.linalg.solve(a, rhs)
    t = np.linspace(0, n - 1, samples)
    k = np.minimum(t.astype(int), n - 2)
    f = (t - k)[:, None]
    p, q = points[k], points[k + 1]
    return (1 - f) * p + f * q + ((1 - f) ** 3 - (1 - f)) / 6 * m[k] + (f**3 - f) / 6 * m[k + 1]


def closest(curve: np.ndarray, x: float, y: float) -> tuple[int, float]:
    """Segment of a polyline that is nearest to a point, and the squared distance."""
    p, q = curve[:-1], curve[1:]
    d = q - p
    n = np.maximum((d**2).sum(axis=1), 1e-12)
    f = np.clip((((x, y) - p) * d).sum(axis=1) / n, 0, 1)
    off = ((p + f[:, None] * d - (x, y)) ** 2).sum(axis=1)
    k = int(off.argmin())
    return k, float(off[k])


def bends(curve: np.ndarray) -> int:
    """Times that a polyline's turning changes its sense."""
    d = np.diff(curve, axis=0)
    turn = np.sign(np.round(d[:-1, 0] * d[1:, 1] - d[:-1, 1] * d[1:, 0], 9))
    turn = turn[turn != 0]
    return int((turn[1:] != turn[:-1]).sum())


def fitted_spline(target: np.ndarray, controls: int, rounds: int = 20, bend: float = 1e-3) -> np.ndarray:
    """Control points of a natural spline close to a polyline: least squares to the nearest points of the target, with its ends held and its second differences small, until nothing moves."""
    at = np.linspace(0, len(target) - 1, controls)
    p = np.column_stack([np.interp(at, np.arange(len(target)), target[:, c]) for c in (0, 1)])
    samples = 4 * controls
    basis = np.column_stack([spline(np.column_stack([np.eye(controls)[k], np.zeros(controls)]), samples)[:, 0] for k in range(controls)])
    second = np.diff(np.eye(controls), 2, axis=0)
    for _ in range(rounds):
        now = basis @ p
        near = np.empty_like(now)
        for i, (x, y) in enumerate(now):
            k, _ = closest(target, float(x), float(y))
            a, b = target[k], target[k + 1]
            d = b - a
            near[i] = a + np.clip(((x, y) - a) @ d / max(d @ d, 1e-12), 0, 1) * d
        m = basis.T @ basis + bend * second.T @ second * samples
        new = np.linalg.solve(m, basis.T @ near)
        new[[0, -1]] = target[[0, -1]]
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p
