"""Peaks, largest white rectangles, hulls, simplification, shape classes, polylines and homographies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.regions import kernel


def peaks(raster: DataFrame, value: str) -> DataFrame:
    """peak (0 or 1): pixels of plateaus that no neighbour (of eight) exceeds."""

    def run(a: np.ndarray) -> np.ndarray:
        around = lambda m, fill: np.stack([np.pad(m, 1, constant_values=fill)[dy : dy + m.shape[0], dx : dx + m.shape[1]] for dy in range(3) for dx in range(3)])
        near = around(a, a.min() - 1)
        good = (near <= a).all(axis=0)
        while True:
            new = good & ~((near == a) & ~around(good, True)).any(axis=0)
            if (new == good).all():
                return good.astype(np.int64)
            good = new

    return kernel(raster, value, "peak", run)


def white_rectangle(bw: DataFrame) -> DataFrame:
    """img_id, x0, y0, x1, y1 (inclusive), area: the largest rectangle without black, ties to the least y0, x0, y1, x1; no row in a black image."""

    def best(a: np.ndarray) -> tuple | None:
        top, run = None, np.zeros(a.shape[1] + 1, np.int64)
        for y in range(a.shape[0]):
            run[:-1] = np.where(a[y] == 0, run[:-1] + 1, 0)
            stack: list[tuple[int, int]] = []
            for x, high in enumerate(run.tolist()):
                left = x
                while stack and stack[-1][1] >= high:
                    left, tall = stack.pop()
                    if tall:
                        found = (-(x - left) * tall, y - tall + 1, left, y, x - 1)
                        top = min(top, found) if top else found
                stack.append((left, high))
        return top

    def one(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        a = np.ones((y.max() + 1, x.max() + 1), np.int64)
        a[y, x] = table.column("bw").to_numpy()
        r = best(a)
        rows = [(table.column("img_id")[0].as_py(), r[2], r[1], r[4], r[3], -r[0])] if r else []
        names = ["img_id", "x0", "y0", "x1", "y1", "area"]
        types = [pa.int64(), *[pa.int32()] * 4, pa.int64()]
        return pa.table([pa.array([v[i] for v in rows], t) for i, t in enumerate(types)], names=names)

    return bw.groupBy("img_id").applyInArrow(one, "img_id long, x0 int, y0 int, x1 int, y1 int, area long")


def line_peaks(votes: DataFrame, least: int, reach: int = 2) -> DataFrame:
    """Votes (img_id, a, bin, weight; a: number of the angle) of at least that weight that no vote within reach exceeds; of equal ones the least (a, bin) stays.

    A vote goes to the cells around it and is compared there: an aggregate, not
    a range join.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    best = F.struct("weight", (-F.col("a")).alias("a"), (-F.col("bin")).alias("bin"))
    strong = votes.where(F.col("weight") >= least)
    sent = strong.select("img_id", best.alias("v"), "a", "bin").select("img_id", "v", "bin", F.explode(F.transform(steps, lambda k: F.col("a") + k)).alias("a"))
    sent = sent.select("img_id", "v", "a", F.explode(F.transform(steps, lambda k: F.col("bin") + k)).alias("bin"))
    top = sent.groupBy("img_id", "a", "bin").agg(F.max("v").alias("v")).where((F.col("v.a") == -F.col("a")) & (F.col("v.bin") == -F.col("bin")))
    return top.select("img_id", "a", "bin", F.col("v.weight").alias("weight"))


def turn(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Positive where o, a, b turn left."""
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def hull_points(points: np.ndarray) -> np.ndarray:
    """Convex hull in order of angle from the least point on, collinear points left out."""
    rows = sorted({tuple(p) for p in points.tolist()})
    if len(rows) < 3:
        return np.array(rows)

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(rows) + chain(rows[::-1]))


def shoelace(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2


def least_box(hull: np.ndarray) -> float:
    """Area of the smallest rectangle around a hull; one of its sides lies on a hull edge."""
    edges = np.roll(hull, -1, axis=0) - hull
    edges = edges[(edges != 0).any(axis=1)]
    if not len(edges):
        return 0.0
    u = edges / np.hypot(edges[:, 0], edges[:, 1])[:, None]
    along, across = hull @ u.T, hull @ np.stack([-u[:, 1], u[:, 0]])
    return float(((along.max(0) - along.min(0)) * (across.max(0) - across.min(0))).min())


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Points kept so that no other is farther than tolerance from its segment; both ends stay."""
    keep, todo = np.zeros(len(points), bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d, inner = points[j] - points[i], points[i + 1 : j] - points[i]
        size = float(np.hypot(*d))
        far = np.abs(inner[:, 0] * d[1] - inner[:, 1] * d[0]) / size if size else np.hypot(inner[:, 0], inner[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def shapes(polygons: DataFrame, tolerance: float, rectangular: float = 0.85, square: float = 0.1) -> DataFrame:
    """id, hull, area, convexity, rectangularity, corners, shape of polygons (id, px, py: arrays of doubles).

    convexity: area by hull area; rectangularity: area by that of the smallest
    rectangle; corners: vertices after simplification.  A polygon without area
    is irregular.
    """

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("id", "hull", "area", "convexity", "rectangularity", "corners", "shape")}
            for i, px, py in zip(*(b.column(c).to_pylist() for c in ("id", "px", "py")), strict=True):
                p = np.stack([px, py], -1) if px else np.zeros((0, 2))
                hull = hull_points(p)
                area, wide = (shoelace(v) if len(v) > 2 else 0.0 for v in (p, hull))
                box = least_box(hull.astype(float)) if wide else 0.0
                convex, rect = area / wide if wide else 0.0, area / box if box else 0.0
                corners = len(simplified(np.vstack([p, p[:1]]), tolerance)) - 1 if len(p) else 0
                sides = np.ptp(p, axis=0) if len(p) else np.zeros(2)
                if rect >= rectangular:
                    shape = "square" if abs(sides[0] - sides[1]) <= square * sides.max() else "rectangle"
                else:
                    shape = "irregular" if not area else "polygon" if convex >= rectangular else "irregular"
                for k, v in zip(out, (i, hull.ravel().tolist(), area, convex, rect, corners, shape), strict=True):
                    out[k].append(round(v, 6) if isinstance(v, float) else v)
            types = [pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return polygons.mapInArrow(run, "id long, hull array<double>, area double, convexity double, rectangularity double, corners int, shape string")


def arc_lengths(points: DataFrame, by: str = "id", order: str = "ord") -> DataFrame:
    """points (by, order, px, py) with at: length of the polyline up to each point, and share of the whole."""
    w = Window.partitionBy(by).orderBy(order)
    step = F.hypot(F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w))
    p = points.select("*", F.coalesce(step, F.lit(0.0)).alias("_s")).select("*", F.sum("_s").over(w).alias("_at"))
    total = F.max("_at").over(Window.partitionBy(by))
    return p.select(*points.columns, F.round("_at", 6).alias("at"), F.round(F.when(total > 0, F.col("_at") / F.when(total > 0, total)).otherwise(0.0), 6).alias("share"))


def nearest_on_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, ((x - ax) * dx + (y - ay) * dy) / F.when(n > 0, n)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.pow(x - ax - t * dx, F.lit(2)) + F.pow(y - ay - t * dy, F.lit(2))


def crossing(a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """Scalars along the lines a and b (each x1, y1, x2, y2) where they meet; null if parallel."""
    dx, dy, ex, ey = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    det = dx * ey - dy * ex
    some = F.when(det != 0, det)
    ox, oy = b[0] - a[0], b[1] - a[1]
    return (ox * ey - oy * ex) / some, (ox * dy - oy * dx) / some


def homographies(quads: DataFrame) -> DataFrame:
    """id, m (nine numbers, the last 1): maps the unit square's corners (0,0), (1,0), (1,1), (0,1) to a quadrilateral's (q: eight numbers); null where none does."""
    unit = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])

    def run(batches):
        for b in batches:
            out = []
            for q in b.column("q").to_pylist():
                to, rows = np.array(q).reshape(4, 2), []
                for (x, y), (u, v) in zip(unit, to, strict=True):
                    rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
                a = np.array(rows)
                out.append([*np.linalg.solve(a, to.ravel()).tolist(), 1.0] if abs(np.linalg.det(a)) > 1e-9 else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float64()))], ["id", "m"])

    return quads.mapInArrow(run, "id long, m array<double>")


def mapped(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a homography."""
    w = m[6] * x + m[7] * y + m[8]
    w = F.when(w != 0, w)
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w
