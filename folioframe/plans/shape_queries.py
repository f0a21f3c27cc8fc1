"""Queries on resampling, filters, surfaces, colours, peaks, rectangles and polygons, with SQL twins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import pixels as P
from folioframe.operators import regions as G
from folioframe.operators import resampling as S
from folioframe.operators import shapes as H
from folioframe.plans.raster_queries import OTSU, T as T_ODD, T8 as T, bw8 as bw, gray, gray8
from folioframe.sources import rasters as R

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


# resampling
OVER = "(least(({0}b + 1) * 8, ({0} + 1) * {1}) - greatest({0}b * 8, {0} * {1}))"
for w, h in ((5, 3), (11, 8)):
    oy, ox = OVER.format("y", h), OVER.format("x", w)
    add(f"scale_{w}x{h}", gray8(lambda t, w=w, h=h: S.scale(t, w, h)), f"{T} SELECT img_id, CAST(yb AS INTEGER) AS y, CAST(xb AS INTEGER) AS x, CAST((sum(g * {oy} * {ox}) + 32) // 64 AS INTEGER) AS g FROM tile, range({h}) a(yb), range({w}) b(xb) WHERE {oy} > 0 AND {ox} > 0 GROUP BY ALL")
MAP = (0.9, 0.2, -0.5, -0.15, 1.1, 0.4)
BOX = [max(1, math.floor(max(32 * 0.9, *(abs(32 * v) for v in pair)) + 0.5)) for pair in (MAP[:2], MAP[3:5])]
NEAR = ["CAST(trunc({0!r}::DOUBLE * (dx + 0.5::DOUBLE) + {1!r}::DOUBLE * (dy + 0.5::DOUBLE) + {2!r}::DOUBLE) AS BIGINT) - {3}".format(*(32 * v for v in row), size >> 1) for row, size in ((MAP[:3], BOX[0]), (MAP[3:], BOX[1]))]
PART = f"greatest(0, least(l + {BOX[0]}, x * 32 + 32) - greatest(l, x * 32)) * greatest(0, least(t + {BOX[1]}, y * 32 + 32) - greatest(t, y * 32))"
for name, weak in (("affine", False), ("affine_weak", True)):
    rest = "0" if weak else f"({BOX[0] * BOX[1]} - n)"
    add(name, gray8(lambda t, weak=weak: S.affine(t, MAP, 7, 9, 200, weak)), f"""{T}, d AS (SELECT dy, dx, {NEAR[0]} AS l, {NEAR[1]} AS t FROM range(9) a(dy), range(7) b(dx)), s AS (SELECT img_id, dy, dx, CAST(sum(g * {PART}) AS BIGINT) AS s, CAST(sum({PART}) AS BIGINT) AS n FROM tile, d GROUP BY ALL)
SELECT img_id, CAST(dy AS INTEGER) AS y, CAST(dx AS INTEGER) AS x, CAST(CASE WHEN n = 0 THEN 200 ELSE (2 * (s + {rest} * 200) + n + {rest}) // (2 * greatest(n + {rest}, 1)) END AS INTEGER) AS g FROM s""")
add("integral_image", gray8(S.integral), f"{T} SELECT a.img_id, a.y, a.x, CAST(sum(b.g) AS BIGINT) AS s FROM tile a JOIN tile b ON b.img_id = a.img_id AND b.y <= a.y AND b.x <= a.x GROUP BY ALL")


def columns_dewarped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles straightened between two curves: top x // 4 pixels and bottom (7 - x) // 4 pixels from the edges, in six rows."""
    cells = R.tiles(spark, sf_dir).select("img_id", "x", "y", "g", F.expr("x div 4").alias("a"), F.expr("8 - (7 - x) div 4").alias("b"))
    parts = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("v"))
    size = F.col("b") - F.col("a")
    over = F.least((F.col("y") + 1 - F.col("a")) * 6, (F.col("v") + 1) * size) - F.greatest((F.col("y") - F.col("a")) * 6, F.col("v") * size)
    sums = parts.select("*", over.alias("part"), size.alias("size")).where("part > 0").groupBy("img_id", F.col("v").alias("y"), "x").agg(F.sum(F.col("g") * F.col("part")).alias("s"), F.max("size").alias("n"))
    return sums.select(*P.KEY, S.rounded_mean(F.col("s"), F.col("n")).alias("g"))


DE = "(least((y + 1 - a) * 6, (v + 1) * (b - a)) - greatest((y - a) * 6, v * (b - a)))"
add("dewarp_columns", columns_dewarped, f"{T}, c AS (SELECT *, x // 4 AS a, 8 - (7 - x) // 4 AS b FROM tile) SELECT img_id, CAST(v AS INTEGER) AS y, x, CAST((2 * sum(g * {DE}) + max(b - a)) // (2 * max(b - a)) AS INTEGER) AS g FROM c, range(6) r(v) WHERE {DE} > 0 GROUP BY img_id, v, x")


# linear filters and surfaces
def matrix_sql(m: np.ndarray) -> str:
    return "(VALUES " + ", ".join(f"({i}, {j}, {v!r}::DOUBLE)" for (i, j), v in ((k, float(m[k])) for k in np.ndindex(m.shape)) if v) + ")"


for name, f, across, down in (("savitzky_golay", lambda t: S.savitzky_golay(t, (5, 3), (2, 1)), S.smoothing_matrix(8, 5, 2), S.smoothing_matrix(8, 3, 1)), ("gauss_blur", lambda t: S.gauss(t, 1.5, 0.8), S.gauss_matrix(8, 1.5), S.gauss_matrix(8, 0.8))):
    add(name, gray8(f), f"""{T} SELECT img_id, CAST(d.i AS INTEGER) AS y, CAST(a.i AS INTEGER) AS x, CAST(least(255, greatest(0, floor(round(sum(g * d.v * a.v), 6) + 0.5))) AS INTEGER) AS g
FROM tile JOIN {matrix_sql(across)} a(i, j, v) ON a.j = tile.x JOIN {matrix_sql(down)} d(i, j, v) ON d.j = tile.y GROUP BY img_id, d.i, a.i""")
FIT = f"""{T}, p AS (SELECT *, (2 * x + 1) / 8.0::DOUBLE - 1 AS u, (2 * y + 1) / 8.0::DOUBLE - 1 AS v FROM tile),
f AS (SELECT img_id, y, x, g, round(avg(g) OVER w + u * sum(g * u) OVER w / sum(u * u) OVER w + v * sum(g * v) OVER w / sum(v * v) OVER w + u * v * sum(g * u * v) OVER w / sum(u * u * v * v) OVER w, 6) AS fit FROM p WINDOW w AS (PARTITION BY img_id))"""
add("polynomial_surface", gray8(lambda t: S.surface(t, 1, 1)), f"{FIT} SELECT * FROM f")
LIGHT = "CASE WHEN b <= g THEN 255 ELSE (255 * g + b // 2) // greatest(b, 1) END"
add("normalise_light", gray8(lambda t: S.surface(t, 1, 1).select(*P.KEY, "g", F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("fit") + 0.5))).alias("b")).select(*P.KEY, F.expr(LIGHT.replace("//", "div")).cast("int").alias("g"))), f"{FIT}, b AS (SELECT *, CAST(greatest(0, least(255, floor(fit + 0.5))) AS INTEGER) AS b FROM f) SELECT img_id, y, x, CAST({LIGHT} AS INTEGER) AS g FROM b")
# points of colours
add("gradient_combine", gray8(lambda t: P.combine(P.spread(t, True, (-1, 1), (-1, 1)), t, F.expr("255 - (255 - a) * b div 255"), "g")), f"{T} SELECT a.img_id, a.y, a.x, CAST(255 - (255 - min(b.g)) * a.g // 255 AS INTEGER) AS g FROM tile a JOIN tile b ON b.img_id = a.img_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.img_id, a.y, a.x, a.g")
add("brightness_transplant", gray8(lambda t: t.select(*P.KEY, S.transplant(F.col("g"), 255 - F.col("g"), F.expr("g div 2"), F.expr("(g + 100) div 2")).alias("c")).select(*P.KEY, "c.r", "c.g", "c.b")), f"""{T}, s AS (SELECT img_id, y, x, g AS r, 255 - g AS g, g // 2 AS b, (g + 100) // 2 AS l FROM tile), d AS (SELECT *, l - (0.299::DOUBLE * r + (1 - 0.299::DOUBLE - 0.114::DOUBLE) * g + 0.114::DOUBLE * b) AS d FROM s)
SELECT img_id, y, x, {", ".join(f"CAST(greatest(0, least(255, floor(round({c} + d, 6) + 0.5))) AS INTEGER) AS {c}" for c in "rgb")} FROM d""")
add("mono_to_gray", bw(lambda b: b.select(*P.KEY, (255 * (1 - F.col("bw"))).alias("g"))), f"{T} SELECT img_id, y, x, 255 * (1 - bw) AS g FROM bw")
add("alpha_mask", bw(lambda b: b.select(*P.KEY, F.when(F.col("bw") == 1, "#FF336699").otherwise("#00000000").alias("argb"))), f"{T} SELECT img_id, y, x, CASE WHEN bw = 1 THEN '#FF336699' ELSE '#00000000' END AS argb FROM bw")
add("framed", gray(lambda t: P.framed(t, 255, 0)), f"{T_ODD} SELECT img_id, y, x, CASE WHEN x IN (0, max(x) OVER (PARTITION BY img_id)) OR y IN (0, max(y) OVER (PARTITION BY img_id)) THEN 0 ELSE 255 END AS g FROM tile")
add("draw_over", gray8(lambda t: t.join(t.where("x < 3 and y < 3").select("img_id", (F.col("y") + 4).alias("y"), (F.col("x") + 2).alias("x"), F.col("g").alias("o")), P.KEY, "left").select(*P.KEY, F.coalesce("o", "g").alias("g"))), f"{T} SELECT a.img_id, a.y, a.x, coalesce(b.g, a.g) AS g FROM tile a LEFT JOIN tile b ON b.img_id = a.img_id AND b.y + 4 = a.y AND b.x + 2 = a.x AND b.x < 3 AND b.y < 3")
add("colour_blend", gray8(lambda t: t.select(*P.KEY, F.floor((F.col("g") * 3 + 200) / 4 + 0.5).cast("int").alias("g"))), f"{T} SELECT img_id, y, x, CAST(floor((g * 3 + 200) / 4.0 + 0.5) AS INTEGER) AS g FROM tile")
add("threshold_adjusted", gray(lambda t: P.otsu(t).select("img_id", F.greatest(F.lit(30), F.least(F.lit(225), F.col("threshold") - 20)).alias("threshold"))), f"{OTSU} SELECT img_id, greatest(30, least(225, threshold - 20)) AS threshold FROM o")
KM = f"{T}, h AS (SELECT img_id, g, count(*) AS n FROM tile GROUP BY ALL), k0 AS (SELECT DISTINCT img_id, i AS c, (2 * i + 1) * 255.0::DOUBLE / 8 AS v FROM tile, range(4) r(i))"
for r in (1, 2, 3):
    KM += f", n{r} AS (SELECT h.img_id, g, n, arg_min(c, (round(abs(g - v), 6), c)) AS c FROM h JOIN k{r - 1} k ON k.img_id = h.img_id GROUP BY ALL), m{r} AS (SELECT img_id, c, CAST(sum(g * n) AS DOUBLE) / sum(n) AS v FROM n{r} GROUP BY ALL), k{r} AS (SELECT k.img_id, k.c, coalesce(m.v, k.v) AS v FROM k{r - 1} k LEFT JOIN m{r} m ON m.img_id = k.img_id AND m.c = k.c)"
add("kmeans_palette", gray8(lambda t: S.colours(t, 4, 3)), f"{KM} SELECT img_id, CAST(c AS INTEGER) AS centre, round(v, 6) AS level FROM k3")
add("dither", gray8(lambda t: S.dither(t, [0, 85, 170, 255])), None)
# sets of black pixels
BLACK, MOVED = "SELECT img_id, y, x FROM bw WHERE bw = 1", "SELECT img_id, y + 1 AS y, x FROM bw WHERE bw = 1"
for name, method in (("union", "union"), ("intersect", "intersect"), ("except", "exceptAll")):
    add(f"set_{name}", bw(lambda b, m=method: (lambda s: getattr(s, m)(s.select("img_id", (F.col("y") + 1).alias("y"), "x")).distinct())(b.where("bw = 1").select(*P.KEY))), f"{T} {BLACK} {name.upper()} {MOVED}")
# peaks and rectangles
PEAK = """low AS (SELECT a.img_id, a.y, a.x FROM r a JOIN r b ON b.img_id = a.img_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND b.v > a.v UNION SELECT b.img_id, b.y, b.x FROM low JOIN r a ON a.img_id = low.img_id AND a.y = low.y AND a.x = low.x JOIN r b ON b.img_id = a.img_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND b.v = a.v),
pk AS (SELECT r.img_id, r.y, r.x, r.v, CAST(low.y IS NULL AS INTEGER) AS peak FROM r LEFT JOIN low ON low.img_id = r.img_id AND low.y = r.y AND low.x = r.x)"""
REC = T.replace("WITH", "WITH RECURSIVE", 1)
add("gray_peaks", gray8(lambda t: H.peaks(t, "g")), f"{REC}, r AS (SELECT img_id, y, x, g AS v FROM tile), {PEAK} SELECT img_id, y, x, peak FROM pk")
add("ultimate_eroded", bw(lambda b: (lambda d: H.peaks(d, "d2").where("peak = 1").join(d.where("d2 > 0"), P.KEY).select(*P.KEY, "d2"))(G.distance_map(b))), f"{REC}, r AS (SELECT a.img_id, a.y, a.x, CAST(coalesce(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)), -1) AS BIGINT) AS v FROM bw a LEFT JOIN bw b ON b.img_id = a.img_id AND b.bw = 0 GROUP BY ALL), {PEAK} SELECT img_id, y, x, v AS d2 FROM pk WHERE peak = 1 AND v > 0")
add("white_rectangle", bw(H.white_rectangle), f"""{T}, i AS (SELECT img_id, y, x, sum(s) OVER (PARTITION BY img_id, x ORDER BY y) AS s FROM (SELECT img_id, y, x, sum(bw) OVER (PARTITION BY img_id, y ORDER BY x) AS s FROM bw)),
q AS (SELECT d.img_id, CAST(t.y0 AS INTEGER) AS y0, CAST(l.x0 AS INTEGER) AS x0, d.y AS y1, d.x AS x1, d.s - coalesce(u.s, 0) - coalesce(v.s, 0) + coalesce(k.s, 0) AS n FROM i d JOIN range(8) t(y0) ON t.y0 <= d.y JOIN range(8) l(x0) ON l.x0 <= d.x
LEFT JOIN i u ON u.img_id = d.img_id AND u.y = t.y0 - 1 AND u.x = d.x LEFT JOIN i v ON v.img_id = d.img_id AND v.y = d.y AND v.x = l.x0 - 1 LEFT JOIN i k ON k.img_id = d.img_id AND k.y = t.y0 - 1 AND k.x = l.x0 - 1)
SELECT img_id, x0, y0, x1, y1, CAST((x1 - x0 + 1) * (y1 - y0 + 1) AS BIGINT) AS area FROM q WHERE n = 0 QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY (x1 - x0 + 1) * (y1 - y0 + 1) DESC, y0, x0, y1, x1) = 1""")
STEP = list(range(0, 180, 15))
add("hough_lines", gray8(lambda t: H.line_peaks(G.hough(t, STEP).select("img_id", F.expr("degree div 15").cast("int").alias("a"), "bin", "weight"), 300)), f"""{T}, v AS (SELECT img_id, CAST(a.d // 15 AS INTEGER) AS a, CAST(floor(round(x * cos(radians(a.d::DOUBLE)) + y * sin(radians(a.d::DOUBLE)), 6) + 0.5) AS INTEGER) AS bin, CAST(sum(128 - g) AS BIGINT) AS weight FROM tile, (SELECT unnest({STEP}) AS d) a WHERE g < 128 GROUP BY ALL)
SELECT * FROM v WHERE weight >= 300 AND NOT EXISTS (SELECT 1 FROM v o WHERE o.img_id = v.img_id AND abs(o.a - v.a) <= 2 AND abs(o.bin - v.bin) <= 2 AND (o.weight, -o.a, -o.bin) > (v.weight, -v.a, -v.bin))""")


# polygons
def outlines(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """img_id, px, py: polygons of n vertices on the tile's grid, from the first numbers of each embedding."""
    at = lambda k: (F.floor(F.abs(F.col("embedding")[k].cast("double")) * 4096) % 9).cast("int")
    return R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.array(*(at(2 * k) for k in range(n))).alias("px"), F.array(*(at(2 * k + 1) for k in range(n))).alias("py"))


EDGES = "v AS (SELECT vec_id AS img_id, k, CAST(floor(abs(embedding[2 * k + 1]::DOUBLE) * 4096) AS BIGINT) % 9 AS px, CAST(floor(abs(embedding[2 * k + 2]::DOUBLE) * 4096) AS BIGINT) % 9 AS py FROM embeddings, range(5) r(k)), e AS (SELECT a.img_id, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS ey FROM v a JOIN v b ON b.img_id = a.img_id AND b.k = (a.k + 1) % 5)"
SIDE = "((bx - ax) * (y + 0.5::DOUBLE - ay) - (x + 0.5::DOUBLE - ax) * (ey - ay))"
for name, winding in (("polygon_odd_even", False), ("polygon_winding", True)):
    down, test = ("-1", "<> 0") if winding else ("1", "% 2 <> 0")
    inside = f"SELECT tile.img_id, y, x, CAST(sum(CASE WHEN ay <= y + 0.5 AND ey > y + 0.5 AND {SIDE} > 0 THEN 1 WHEN ay > y + 0.5 AND ey <= y + 0.5 AND {SIDE} < 0 THEN {down} ELSE 0 END) {test} AS INTEGER) AS inside FROM tile JOIN e ON e.img_id = tile.img_id GROUP BY ALL"
    add(name, lambda s, d, w=winding: S.polygon_mask(R.tiles(s, d), outlines(s, d), w), f"{T}, {EDGES} {inside}")
    add(f"fill_{name}", lambda s, d, w=winding: P.combine(R.bitmaps(R.tiles(s, d)), S.polygon_mask(R.tiles(s, d), outlines(s, d), w), F.greatest("a", "b"), "bw"), f"{T}, {EDGES}, i AS ({inside}) SELECT bw.img_id, bw.y, bw.x, greatest(bw, inside) AS bw FROM bw JOIN i ON i.img_id = bw.img_id AND i.y = bw.y AND i.x = bw.x")
add("polygon_shapes", lambda s, d: H.shapes(outlines(s, d).select(F.col("img_id").alias("id"), F.col("px").cast("array<double>").alias("px"), F.col("py").cast("array<double>").alias("py")), 0.75), None)


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ord, px, py: the outlines' vertices as open polylines."""
    return outlines(spark, sf_dir).select(F.col("img_id").alias("id"), F.posexplode(F.arrays_zip("px", "py")).alias("ord", "p")).select("id", "ord", F.col("p.px").cast("double").alias("px"), F.col("p.py").cast("double").alias("py"))


add("arc_lengths", lambda s, d: H.arc_lengths(path(s, d)), f"""WITH {EDGES}, l AS (SELECT a.img_id, a.k, a.px, a.py, (SELECT sum(sqrt((b.px - c.px) * (b.px - c.px) + (b.py - c.py) * (b.py - c.py))) FROM v b JOIN v c ON c.img_id = b.img_id AND c.k = b.k - 1 WHERE b.img_id = a.img_id AND b.k <= a.k) AS t FROM v a)
SELECT img_id AS id, CAST(k AS INTEGER) AS ord, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, round(coalesce(t, 0.0), 6) AS at, round(CASE WHEN max(t) OVER w > 0 THEN coalesce(t, 0.0) / max(t) OVER w ELSE 0.0 END, 6) AS share FROM l WINDOW w AS (PARTITION BY img_id)""")
_c = lambda c, k: F.col(c)[k].cast("double")
_line = lambda i, j: [_c("px", i), _c("py", i), _c("px", j), _c("py", j)]


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lines through vertices 0, 1 and 2, 3 meet, as scalars along each; and the squared distance of vertex 4 from the first segment."""
    s, t = H.crossing(_line(0, 1), _line(2, 3))
    return outlines(spark, sf_dir).select("img_id", F.round(s, 6).alias("s"), F.round(t, 6).alias("t"), F.round(H.nearest_on_segment(_c("px", 4), _c("py", 4), *_line(0, 1)), 6).alias("d2"))


add("line_crossings", crossings, f"""WITH {EDGES}, w AS (SELECT img_id, list(px::DOUBLE ORDER BY k) AS p, list(py::DOUBLE ORDER BY k) AS q FROM v GROUP BY img_id), d AS (SELECT *, (p[2] - p[1]) * (q[4] - q[3]) - (q[2] - q[1]) * (p[4] - p[3]) AS det, (p[2] - p[1]) * (p[2] - p[1]) + (q[2] - q[1]) * (q[2] - q[1]) AS n FROM w),
k AS (SELECT *, CASE WHEN n > 0 THEN greatest(0.0, least(1.0, ((p[5] - p[1]) * (p[2] - p[1]) + (q[5] - q[1]) * (q[2] - q[1])) / n)) ELSE 0.0 END AS f FROM d)
SELECT img_id, round(CASE WHEN det <> 0 THEN ((p[3] - p[1]) * (q[4] - q[3]) - (q[3] - q[1]) * (p[4] - p[3])) / det END, 6) AS s, round(CASE WHEN det <> 0 THEN ((p[3] - p[1]) * (q[2] - q[1]) - (q[3] - q[1]) * (p[2] - p[1])) / det END, 6) AS t, round(pow(p[5] - p[1] - f * (p[2] - p[1]), 2) + pow(q[5] - q[1] - f * (q[2] - q[1]), 2), 6) AS d2 FROM k""")


def homography_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the homography from the unit square takes its centre: the crossing of the quadrilateral's diagonals."""
    quads = outlines(spark, sf_dir, 4).select(F.col("img_id").alias("id"), F.flatten(F.transform(F.arrays_zip("px", "py"), lambda p: F.array(p["px"].cast("double"), p["py"].cast("double")))).alias("q"))
    x, y = H.mapped(F.col("m"), F.lit(0.5), F.lit(0.5))
    return H.homographies(quads).select("id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


add("homography_centres", homography_centres, None)
