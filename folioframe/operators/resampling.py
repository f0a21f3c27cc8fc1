"""Resampling and linear filters: area-weighted scaling, affine maps, Gaussian and least-squares smoothing, polynomial surfaces, polygons.

Resampling explodes each pixel only into the cells it overlaps and sums integer
weights, so partial sums are made before the exchange.  A separable linear
filter is a product with one matrix along each axis.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.pixels import KEY
from folioframe.operators.regions import kernel


def sized(gray: DataFrame) -> DataFrame:
    """gray with the width and height of its image."""
    size = Window.partitionBy("img_id")
    return gray.select("*", (F.max("x").over(size) + 1).alias("w"), (F.max("y").over(size) + 1).alias("h"))


def rounded_mean(total: Column, weight: Column) -> Column:
    """Integer mean, halves up."""
    return F.floor((2 * total + weight) / (2 * F.greatest(weight, F.lit(1)))).cast("int")


def scale(gray: DataFrame, width: int, height: int) -> DataFrame:
    """width x height pixels, each the mean of what it covers, weighted by the covered area."""

    def cells(at: str, size: str, to: int) -> Column:
        first = F.expr(f"{at} * {to} div {size}")
        last = F.expr(f"(({at} + 1) * {to} - 1) div {size}")
        left, right = lambda k: F.greatest(k * F.col(size), F.col(at) * to), lambda k: F.least((k + 1) * F.col(size), (F.col(at) + 1) * to)
        return F.transform(F.sequence(first, last), lambda k: F.struct(k.cast("int").alias("at"), (right(k) - left(k)).cast("long").alias("part")))

    parts = sized(gray).select("img_id", "g", (F.col("w") * F.col("h")).alias("area"), F.explode(cells("y", "h", height)).alias("v"), "x", "w")
    parts = parts.select("img_id", "g", "area", "v", F.explode(cells("x", "w", width)).alias("u"))
    sums = parts.groupBy("img_id", F.col("v.at").alias("y"), F.col("u.at").alias("x")).agg(F.sum(F.col("g") * F.col("v.part") * F.col("u.part")).alias("s"), F.max("area").cast("long").alias("area"))
    return sums.select(*KEY, F.expr("(s + area div 2) div area").cast("int").alias("g"))


def affine(gray: DataFrame, inverse: tuple[float, ...], width: int, height: int, outside: int, weak: bool = False, unit: float = 0.9) -> DataFrame:
    """Each cell of a width x height grid is the mean of its image under inverse (a, b, c, d, e, f: x' = ax + by + c, y' = dx + ey + f).

    Lengths are in 32nds of a pixel and a cell's image is a box of at least
    unit pixels a side.  What lies outside counts as the outside colour, or
    not at all if weak; a cell that is wholly outside has the outside colour.
    """
    a, b, c, d, e, f = (32 * v for v in inverse)
    bw, bh = (max(1, math.floor(max(32 * unit, abs(p), abs(q)) + 0.5)) for p, q in ((a, b), (d, e)))
    near = lambda p, q, r, half: F.expr(f"cast(({p!r}D * (dx + 0.5D) + {q!r}D * (dy + 0.5D) + {r!r}D) as long) - {half}")
    grid = gray.select("img_id").distinct().select("img_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("dy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("dx"))
    grid = grid.select("img_id", "dy", "dx", near(a, b, c, bw >> 1).alias("left"), near(d, e, f, bh >> 1).alias("top"))
    touched = lambda at, size: F.sequence(F.floor(F.col(at) / 32), F.floor((F.col(at) + (size - 1)) / 32))
    cells = grid.select("*", F.explode(touched("top", bh)).alias("_y")).select("*", F.explode(touched("left", bw)).alias("_x"))
    overlap = lambda at, k, size: F.least(F.col(at) + size, F.col(k) * 32 + 32) - F.greatest(F.col(at), F.col(k) * 32)
    cells = cells.select("img_id", "dy", "dx", F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x"), (overlap("top", "_y", bh) * overlap("left", "_x", bw)).alias("part"))
    inside = F.when(F.col("g").isNotNull(), F.col("part")).otherwise(0)
    sums = cells.join(gray, KEY, "left").groupBy("img_id", F.col("dy").alias("y"), F.col("dx").alias("x")).agg(F.sum(inside * F.coalesce("g", F.lit(0))).alias("s"), F.sum(inside).alias("n"))
    rest = 0 if weak else bw * bh - F.col("n")
    mean = rounded_mean(F.col("s") + rest * outside, F.col("n") + rest)
    return sums.select(*KEY, F.when(F.col("n") == 0, outside).otherwise(mean).cast("int").alias("g"))


def integral(gray: DataFrame) -> DataFrame:
    """s: sum over all pixels above and to the left, the pixel included."""
    rows = Window.partitionBy("img_id", "y").orderBy("x")
    cols = Window.partitionBy("img_id", "x").orderBy("y")
    return gray.repartition("img_id").select(*KEY, F.sum("g").over(rows).alias("r")).select(*KEY, F.sum("r").over(cols).alias("s"))


def smoothing_matrix(n: int, window: int, degree: int) -> np.ndarray:
    """Row i: weights of the least-squares polynomial over the window around i, moved inwards at the ends, at i."""
    window = min(window, n)
    out = np.zeros((n, n))
    for i in range(n):
        first = min(max(i - window // 2, 0), n - window)
        t = np.arange(first, first + window) - i
        out[i, first : first + window] = np.linalg.pinv(np.vander(t, min(degree, window - 1) + 1, increasing=True))[0]
    return out


# The published exponential approximation of the Gaussian; (cosine weight, sine weight, decay, frequency) by term.
EXPONENTIALS = ((1.6803, 3.735, 1.783, 0.6318), (-0.6803, -0.2598, 1.723, 1.997))


def gauss_matrix(n: int, sigma: float) -> np.ndarray:
    """Row i: weights of the Gaussian's approximation around i; pixels beyond an end repeat the end."""
    if sigma <= 0:
        return np.eye(n)
    reach = int(20 * sigma) + 1
    t = np.abs(np.arange(-reach, reach + 1)) / sigma
    h = sum((p * np.cos(w * t) + q * np.sin(w * t)) * np.exp(-b * t) for p, q, b, w in EXPONENTIALS) / (math.sqrt(2 * math.pi) * sigma)
    out = np.zeros((n, n))
    for i in range(n):
        np.add.at(out[i], np.clip(np.arange(i - reach, i + reach + 1), 0, n - 1), h)
    return out


def separable(gray: DataFrame, across: Callable[[int], np.ndarray], down: Callable[[int], np.ndarray]) -> DataFrame:
    """gray under one matrix along its rows and one along its columns (each made for a length), rounded and clamped once."""

    def run(a: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(np.round(down(a.shape[0]) @ a @ across(a.shape[1]).T, 6) + 0.5), 0, 255).astype(np.int64)

    return kernel(gray, "g", "g", run)


def savitzky_golay(gray: DataFrame, window: tuple[int, int], degree: tuple[int, int]) -> DataFrame:
    """Least-squares polynomial smoothing; windows and degrees by rows (x) and columns (y)."""
    return separable(gray, lambda n: smoothing_matrix(n, window[0], degree[0]), lambda n: smoothing_matrix(n, window[1], degree[1]))


def gauss(gray: DataFrame, sigma_x: float, sigma_y: float) -> DataFrame:
    return separable(gray, lambda n: gauss_matrix(n, sigma_x), lambda n: gauss_matrix(n, sigma_y))


def surface(gray: DataFrame, degree_x: int, degree_y: int) -> DataFrame:
    """gray with fit: the least-squares polynomial surface of the degrees, at each pixel.

    The sums of monomials are aggregates; only they, some dozens of numbers an
    image, go to the solver, and the fit is evaluated in the JVM.
    """
    powers = [(i, j) for j in range(degree_y + 1) for i in range(degree_x + 1)]
    x, y = (2 * F.col("x") + 1) / F.col("w") - 1, (2 * F.col("y") + 1) / F.col("h") - 1
    at = sized(gray).select(*KEY, "g", x.alias("u"), y.alias("v"))
    power = lambda i, j: F.pow("u", F.lit(i)) * F.pow("v", F.lit(j))
    moments = sorted({(i + k, j + m) for i, j in powers for k, m in powers})
    sums = at.groupBy("img_id").agg(*(F.sum(power(i, j)).alias(f"m{i}_{j}") for i, j in moments), *(F.sum(power(i, j) * F.col("g")).alias(f"r{i}_{j}") for i, j in powers))

    def solve(batches):
        for b in batches:
            t = b.to_pandas()
            left = np.stack([np.stack([t[f"m{i + k}_{j + m}"].to_numpy() for k, m in powers], -1) for i, j in powers], -2)
            right = np.stack([t[f"r{i}_{j}"].to_numpy() for i, j in powers], -1)
            c = (np.linalg.pinv(left) @ right[..., None])[..., 0]
            yield pa.RecordBatch.from_arrays([b.column("img_id"), pa.array(list(c), pa.list_(pa.float64()))], ["img_id", "c"])

    fit = sum((F.col("c")[n] * power(i, j) for n, (i, j) in enumerate(powers)), F.lit(0.0))
    return at.join(sums.mapInArrow(solve, "img_id long, c array<double>"), "img_id").select(*KEY, "g", F.round(fit, 6).alias("fit"))


def polygon_mask(raster: DataFrame, polygons: DataFrame, winding: bool = False) -> DataFrame:
    """inside (0 or 1): whether a pixel's centre is in its image's polygon (img_id, px, py arrays), by the odd-even or the winding rule."""
    n = F.size("px")
    edge = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.col("px")[k].alias("ax"), F.col("py")[k].alias("ay"), F.col("px")[(k + 1) % n].alias("bx"), F.col("py")[(k + 1) % n].alias("by")))
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5

    def step(e: Column) -> Column:
        turn = (e["bx"] - e["ax"]) * (cy - e["ay"]) - (cx - e["ax"]) * (e["by"] - e["ay"])
        up, down = (e["ay"] <= cy) & (e["by"] > cy) & (turn > 0), (e["ay"] > cy) & (e["by"] <= cy) & (turn < 0)
        return F.when(up, 1).when(down, -1 if winding else 1).otherwise(0)

    shapes = polygons.select("img_id", edge.alias("edges"))
    count = F.aggregate("edges", F.lit(0), lambda acc, e: acc + step(e))
    return raster.join(shapes, "img_id").select(*KEY, (count != 0 if winding else count % 2 != 0).cast("int").alias("inside"))


def colours(gray: DataFrame, k: int, rounds: int) -> DataFrame:
    """img_id, centre (0..k-1), level: k-means over an image's levels from even starts; each round is an aggregate over its histogram, ties to the darker."""
    h = gray.groupBy("img_id", "g").agg(F.count("*").alias("n"))
    start = [(2 * i + 1) * 255.0 / (2 * k) for i in range(k)]
    centres = h.select("img_id").distinct().select("img_id", F.array(*(F.lit(v) for v in start)).alias("c"))
    for _ in range(rounds):
        near = F.array_min(F.transform("c", lambda v, i: F.struct(F.round(F.abs(F.col("g") - v), 6).alias("d"), i.alias("i"))))["i"]
        sums = h.join(centres, "img_id").groupBy("img_id", "c", near.alias("i")).agg(F.sum(F.col("g") * F.col("n")).alias("s"), F.sum("n").alias("n"))
        means = sums.groupBy("img_id", "c").agg(F.map_from_entries(F.collect_list(F.struct("i", F.col("s") / F.col("n")))).alias("m"))
        centres = means.select("img_id", F.transform("c", lambda v, i: F.coalesce(F.element_at("m", i), v)).alias("c"))
    return centres.select("img_id", F.posexplode("c").alias("centre", "level")).select("img_id", "centre", F.round("level", 6).alias("level"))


def dither(gray: DataFrame, levels: list[int], strength: float = 1.0) -> DataFrame:
    """Nearest level, the error carried on to the right and below in sixteenths 7, 3, 5, 1: sequential, one image at a time."""
    table = np.array(levels, float)

    def run(a: np.ndarray) -> np.ndarray:
        v, out = np.pad(a.astype(float), ((0, 1), (1, 1))), np.zeros(a.shape, np.int64)
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                out[y, x] = table[np.argmin(np.abs(table - v[y, x + 1]))]
                e = strength * (v[y, x + 1] - out[y, x]) / 16
                v[y, x + 2] += 7 * e
                v[y + 1, x : x + 3] += np.array([3, 5, 1]) * e
        return out

    return kernel(gray, "g", "g", run)


def transplant(r: Column, g: Column, b: Column, level: Column, wr: float = 0.299, wb: float = 0.114) -> Column:
    """Struct r, g, b with the given brightness and the old colour differences, halves up, clamped."""
    wg = 1 - wr - wb
    shift = level - (wr * r + wg * g + wb * b)
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(v, 6) + 0.5))).cast("int")
    return F.struct(byte(r + shift).alias("r"), byte(g + shift).alias("g"), byte(b + shift).alias("b"))
