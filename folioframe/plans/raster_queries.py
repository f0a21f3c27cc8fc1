"""Raster queries over the tile and text-page views, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import pixels as P
from folioframe.sources import rasters as R
from folioframe.sources.rasters import ODD_SQL, TILE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
T, T8 = f"WITH {ODD_SQL}", f"WITH {TILE_SQL}"  # rasters of odd sizes, and tiles of 8 x 8 for queries that need one size
S, HOLE = (-1, 1), ["X?", "? "]


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def gray(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(R.odd_tiles(spark, d))


def bw(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(R.bitmaps(R.odd_tiles(spark, d)))


def gray8(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(R.tiles(spark, d))


def bw8(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(R.bitmaps(R.tiles(spark, d)))


def _rows(lo: int, hi: int) -> str:
    side = lambda k: f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING" if k else "CURRENT ROW"
    return f"ROWS BETWEEN {side(lo)} AND {side(hi)}"


def sql_pass(src: str, agg: str, col: str, x: tuple[int, int], y: tuple[int, int], out: str, keep: str = "") -> str:
    return f"""SELECT img_id, y, x{keep}, {agg}(a_) OVER (PARTITION BY img_id, x ORDER BY y {_rows(*y)}) AS {out}
      FROM (SELECT *, {agg}({col}) OVER (PARTITION BY img_id, y ORDER BY x {_rows(*x)}) AS a_ FROM {src})"""


def _stats(size: int) -> str:
    f = _rows(*P.frame(size))
    over = lambda c, by, o: f"sum({c}) OVER (PARTITION BY img_id, {by} ORDER BY {o} {f})"
    return f"""p AS (SELECT *, {over("g", "y", "x")} AS s, {over("g * g", "y", "x")} AS q, {over("1", "y", "x")} AS a FROM tile),
  r AS (SELECT img_id, y, x, g, CAST({over("s", "x", "y")} AS DOUBLE) AS s, CAST({over("q", "x", "y")} AS DOUBLE) AS q, CAST({over("a", "x", "y")} AS DOUBLE) AS a FROM p),
  st AS (SELECT img_id, y, x, g, s / a AS mean, sqrt(abs(q / a - (s / a) * (s / a))) AS dev FROM r)"""


# histograms and reductions
HIST = "SELECT img_id, g, count(*) AS n FROM tile GROUP BY img_id, g"
add("gray_histogram", gray(P.histogram), f"{T} {HIST}")
OTSU = f"""{T}, h AS ({HIST}), c AS (
  SELECT img_id, g, sum(n) OVER w AS nb, sum(n * g) OVER w AS sb, sum(n) OVER e AS n, sum(n * g) OVER e AS s, lead(g) OVER w AS nx FROM h WINDOW w AS (PARTITION BY img_id ORDER BY g), e AS (PARTITION BY img_id)),
v AS (SELECT img_id, g, nx, round(pow(CAST(s - sb AS DOUBLE) / (n - nb) - CAST(sb AS DOUBLE) / nb, 2) * nb * (n - nb), 6) AS v FROM c WHERE nb < n),
b AS (SELECT img_id, (min(g) + max(nx) - 1) // 2 + 1 AS t FROM (SELECT *, max(v) OVER (PARTITION BY img_id) AS m FROM v) WHERE v = m AND v > 0 GROUP BY img_id),
o AS (SELECT i.img_id, CAST(coalesce(t, 0) AS INTEGER) AS threshold FROM (SELECT DISTINCT img_id FROM tile) i LEFT JOIN b ON b.img_id = i.img_id)"""
add("otsu_threshold", gray(P.otsu), f"{OTSU} SELECT * FROM o")
add("otsu_binarize", gray(lambda t: P.binarized_count(t, P.otsu(t))), f"{OTSU} SELECT o.img_id, threshold, CAST(sum(CAST(g < threshold AS INTEGER)) AS BIGINT) AS black FROM tile JOIN o ON o.img_id = tile.img_id GROUP BY ALL")
add("darkest_level", gray(lambda t: t.groupBy("img_id").agg(F.min("g").alias("g"))), f"{T} SELECT img_id, min(g) AS g FROM tile GROUP BY img_id")
add("gray_histogram_masked", gray(lambda t: P.histogram(t.join(P.erode(R.bitmaps(t), S, S).where("bw = 1"), P.KEY, "left_semi"))), f"{T}, m AS ({sql_pass('bw', 'min', 'bw', S, S, 'bw')}) SELECT t.img_id, t.g, count(*) AS n FROM tile t JOIN m ON m.img_id = t.img_id AND m.y = t.y AND m.x = t.x AND m.bw = 1 GROUP BY ALL")
add("black_count", bw(lambda b: b.groupBy("img_id").agg(F.sum("bw").cast("long").alias("black"), F.sum(1 - F.col("bw")).cast("long").alias("white"))), f"{T} SELECT img_id, CAST(sum(bw) AS BIGINT) AS black, CAST(sum(1 - bw) AS BIGINT) AS white FROM bw GROUP BY img_id")
add("content_bbox", bw(P.bounding_box), f"{T} SELECT img_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM bw WHERE bw = 1 GROUP BY img_id")
for axis, name in (("y", "row_profile"), ("x", "col_profile")):
    add(name, bw(lambda b, axis=axis: P.profile(b, axis)), f"{T} SELECT img_id, {axis} AS pos, CAST(sum(bw) AS BIGINT) AS n FROM bw GROUP BY ALL")
SIZED = "z AS (SELECT *, max(y) OVER (PARTITION BY img_id) + 1 AS h, max(x) OVER (PARTITION BY img_id) + 1 AS w FROM bw)"
HALF = """SELECT img_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST(sum(bw) * CASE WHEN max(h) = 1 THEN 2 ELSE 1 END * CASE WHEN max(w) = 1 THEN 2 ELSE 1 END >= {0} AS INTEGER) AS bw
FROM z WHERE (h = 1 OR y + 1 < h OR h % 2 = 0) AND (w = 1 OR x + 1 < w OR w % 2 = 0) GROUP BY img_id, y // 2, x // 2"""
for t in (1, 2, 3, 4):
    add(f"reduce2x_t{t}", bw(lambda b, t=t: P.reduce2x(b, t)), f"{T}, {SIZED} {HALF.format(t)}")
add("contrast_stretch", gray(lambda t: P.stretch(t, 0.05, 0.05)), f"""{T}, h AS ({HIST}), c AS (SELECT img_id, g, sum(n) OVER (PARTITION BY img_id ORDER BY g) AS up, sum(n) OVER (PARTITION BY img_id ORDER BY g DESC) AS down, sum(n) OVER (PARTITION BY img_id) AS al FROM h),
e AS (SELECT img_id, min(CASE WHEN up > al * 0.05 THEN g END) AS lo, max(CASE WHEN down > al * 0.05 THEN g END) AS hi FROM c GROUP BY img_id)
SELECT t.img_id, y, x, CAST(CASE WHEN hi <= lo THEN CASE WHEN g < (lo + hi) // 2 THEN 0 ELSE 255 END WHEN g <= lo THEN 0 WHEN g >= hi THEN 255 ELSE (255 * (g - lo) + (hi - lo) // 2) // greatest(hi - lo, 1) END AS INTEGER) AS g FROM tile t JOIN e ON e.img_id = t.img_id""")
# binarisation with local statistics
add("bin_sauvola", gray(lambda t: P.sauvola(t, 5, 0.34)), f"{T}, {_stats(5)} SELECT img_id, y, x, CAST(g < round(mean * (1 + 0.34 * (dev / 128 - 1)) + 0.0, 6) AS INTEGER) AS bw FROM st")
add("bin_bradley", gray(lambda t: P.bradley(t, 4, 0.1)), f"{T}, {_stats(4)} SELECT img_id, y, x, CAST(g < round(mean * (1 - 0.1::DOUBLE) + 0.0, 6) AS INTEGER) AS bw FROM st")
add("bin_wolf", gray(lambda t: P.wolf(t, 5, 0.3)), f"""{T}, {_stats(5)}, e AS (SELECT *, max(dev) OVER (PARTITION BY img_id) AS top, min(g) OVER (PARTITION BY img_id) AS dark FROM st)
SELECT img_id, y, x, CAST(coalesce(g < 1 OR (g <= 254 AND g < round(CASE WHEN top > 0 THEN mean - 0.3::DOUBLE * (1 - dev / top) * (mean - dark) + 0.0 END, 6)), g < 1) AS INTEGER) AS bw FROM e""")
add("bin_grad", gray(lambda t: P.grad(t, 5, 0.3)), f"""{T}, {_stats(5)}, m AS (SELECT *, CAST(floor(mean + 0.5) AS BIGINT) AS m FROM st), e AS (SELECT *, CAST(sum(abs(m - g) * g) OVER (PARTITION BY img_id) AS DOUBLE) AS up, CAST(sum(abs(m - g)) OVER (PARTITION BY img_id) AS DOUBLE) AS down FROM m)
SELECT img_id, y, x, CAST(g < round((CASE WHEN down > 0 THEN up / down ELSE 127.5 END) * (1 - 0.3::DOUBLE) + m * 0.3::DOUBLE + 0.0, 6) AS INTEGER) AS bw FROM e""")
# morphology
BRICK = ((-1, 1), (-2, 1))
FLIP = ((-1, 1), (-1, 2))
add("dilate_bw", bw(lambda b: P.dilate(b, *BRICK)), f"{T} {sql_pass('bw', 'max', 'bw', *FLIP, 'bw')}")
add("erode_bw", bw(lambda b: P.erode(b, *BRICK)), f"{T} {sql_pass('bw', 'min', 'bw', *BRICK, 'bw')}")
WHITE_OUT = f"SELECT img_id, y, x, CAST(o = 9 AS INTEGER) AS bw FROM ({sql_pass('bw', 'sum', 'bw', S, S, 'o')})"
add("erode_bw_white_outside", bw(lambda b: P.erode(b, S, S, P.WHITE)), f"{T} {WHITE_OUT}")
add("open_bw", bw(lambda b: P.open_(b, S, S)), f"{T}, e AS ({WHITE_OUT}) {sql_pass('e', 'max', 'bw', S, S, 'bw')}")
add("close_bw", bw(lambda b: P.close(b, S, S)), f"{T}, e AS ({sql_pass('bw', 'max', 'bw', S, S, 'bw')}) {sql_pass('e', 'min', 'bw', S, S, 'bw')}")
add("dilate_gray", gray(lambda t: P.spread(t, True, S, S)), f"{T} {sql_pass('tile', 'min', 'g', S, S, 'g')}")
add("erode_gray", gray(lambda t: P.spread(t, False, S, S)), f"{T} {sql_pass('tile', 'max', 'g', S, S, 'g')}")
add("open_gray", gray(lambda t: P.spread(P.spread(t, False, S, S), True, S, S)), f"{T}, e AS ({sql_pass('tile', 'max', 'g', S, S, 'g')}) {sql_pass('e', 'min', 'g', S, S, 'g')}")
add("close_gray", gray(lambda t: P.spread(P.spread(t, True, S, S), False, S, S)), f"{T}, e AS ({sql_pass('tile', 'min', 'g', S, S, 'g')}) {sql_pass('e', 'max', 'g', S, S, 'g')}")
for side, name in (("min", "gradient_dark"), ("max", "gradient_light")):
    add(name, gray(lambda t, side=side: P.combine(t, P.spread(t, side == "min", S, S), F.abs(F.col("a") - F.col("b")), "g")), f"{T}, e AS ({sql_pass('tile', side, 'g', S, S, 'o', ', g')}) SELECT img_id, y, x, CAST(abs(g - o) AS INTEGER) AS g FROM e")
for name, a, c in (("sobel_h", "x", "y"), ("sobel_v", "y", "x")):
    near = lambda f, v, p, o: f"coalesce({f}({v}) OVER (PARTITION BY img_id, {p} ORDER BY {o}), {v})"
    add(name, gray(lambda t, a=a: P.sobel(t, a)), f"{T}, s AS (SELECT *, {near('lag', 'g', a, c)} + 2 * g + {near('lead', 'g', a, c)} AS s FROM tile) SELECT img_id, y, x, CAST({near('lead', 's', c, a)} - {near('lag', 's', c, a)} AS INTEGER) AS d FROM s")
at = lambda dx, dy: f"LEFT JOIN bw o{dx}{dy} ON o{dx}{dy}.img_id = b.img_id AND o{dx}{dy}.x = b.x + {dx} AND o{dx}{dy}.y = b.y + {dy}"
MATCH = f"SELECT b.img_id, b.y, b.x, b.bw AS was, CAST(b.bw = 1 AND coalesce(o11.bw, 0) = 0 AND coalesce(o10.bw, 0) = 0 AS INTEGER) AS bw FROM bw b {at(1, 0)} {at(1, 1)}"
add("hitmiss_match", bw(lambda b: P.hit_miss(b, ["X ", "? "], (0, 0))), f"{T} SELECT img_id, y, x, bw FROM ({MATCH})")
add("hitmiss_replace", bw(lambda b: P.hit_miss(b, ["- ", "? "], (0, 0), replace=True)), f"{T} SELECT img_id, y, x, CASE WHEN bw = 1 THEN 0 ELSE was END AS bw FROM ({MATCH})")
# raster algebra with the raster itself, moved by one pixel
MOVED = "JOIN {0} b ON b.img_id = a.img_id AND b.y + 1 = a.y AND b.x + 1 = a.x"
for name, e in {"and": "a.bw & b.bw", "or": "a.bw | b.bw", "xor": "xor(a.bw, b.bw)", "subtract": "a.bw * (1 - b.bw)", "subtract_white": "1 - (1 - a.bw) * b.bw"}.items():
    add(f"rop_{name}", bw(lambda b, name=name: P.combine(b, b, P.binary_op(name), "bw", 1, 1)), f"{T} SELECT a.img_id, a.y, a.x, CAST({e} AS INTEGER) AS bw FROM bw a {MOVED.format('bw')}")
for name, e in {"subtract_clipped": "greatest(a.g - b.g, 0)", "add_clipped": "least(a.g + b.g, 255)", "subtract": "(a.g - b.g + 256) % 256", "add": "(a.g + b.g) % 256", "darkest": "least(a.g, b.g)", "lightest": "greatest(a.g, b.g)", "divide_light": "CASE WHEN b.g <= a.g THEN 255 ELSE (255 * a.g + b.g // 2) // greatest(b.g, 1) END"}.items():
    add(f"grop_{name}", gray(lambda t, name=name: P.combine(t, t, P.gray_op(name), "g", 1, 1)), f"{T} SELECT a.img_id, a.y, a.x, CAST({e} AS INTEGER) AS g FROM tile a {MOVED.format('tile')}")
add("invert_bw", bw(lambda b: b.select(*P.KEY, (1 - F.col("bw")).alias("bw"))), f"{T} SELECT img_id, y, x, 1 - bw AS bw FROM bw")
add("invert_gray", gray(lambda t: t.select(*P.KEY, (255 - F.col("g")).alias("g"))), f"{T} SELECT img_id, y, x, 255 - g AS g FROM tile")
add("rgb_to_gray", gray(lambda t: t.select(*P.KEY, P.gray_of(F.col("g"), 255 - F.col("g"), F.expr("g div 2")).alias("g"))), f"{T} SELECT img_id, y, x, (11 * g + 16 * (255 - g) + 5 * (g // 2)) >> 5 AS g FROM tile")
add("reserve_bw", gray(lambda t: t.select(*P.KEY, F.greatest(F.lit(1), F.least(F.lit(254), "g")).alias("g"))), f"{T} SELECT img_id, y, x, greatest(1, least(254, g)) AS g FROM tile")
add("layer_split", gray(lambda t: t.select(*P.KEY, F.when(F.col("g").isin(0, 255), "foreground").otherwise("background").alias("layer")).groupBy("img_id", "layer").agg(F.count("*").alias("n"))), f"{T} SELECT img_id, CASE WHEN g IN (0, 255) THEN 'foreground' ELSE 'background' END AS layer, count(*) AS n FROM tile GROUP BY ALL")
add("combine_mixed", gray(lambda t: P.combine(t, R.bitmaps(P.spread(t, True, S, S), 100), F.when(F.col("b") == 1, F.when(F.col("a") < 128, 0).otherwise(255)).otherwise(F.greatest(F.lit(1), F.least(F.lit(254), "a"))), "g")), f"{T}, m AS ({sql_pass('tile', 'min', 'g', S, S, 'o', ', g')}) SELECT img_id, y, x, CASE WHEN o < 100 THEN CASE WHEN g < 128 THEN 0 ELSE 255 END ELSE greatest(1, least(254, g)) END AS g FROM m")
# geometry
for degrees, (y, x) in {90: ("x", "h - y"), 180: ("h - y", "w - x"), 270: ("w - x", "y")}.items():
    add(f"rotate{degrees}", gray(lambda t, degrees=degrees: P.rotate(t, degrees)), f"{T}, z AS (SELECT *, max(y) OVER (PARTITION BY img_id) AS h, max(x) OVER (PARTITION BY img_id) AS w FROM tile) SELECT img_id, {y} AS y, {x} AS x, g FROM z")
for axis, a, c in (("hshear", "x", "y"), ("vshear", "y", "x")):
    add(axis, bw(lambda b, a=a: P.shear(b, 0.5, 4.0, a)), f"{T}, m AS (SELECT img_id, {c}, {a} + CAST(floor(0.5 * ({c} + 0.5 - 4.0) + 0.5) AS INTEGER) AS {a}, bw FROM bw) SELECT b.img_id, b.y, b.x, coalesce(m.bw, 0) AS bw FROM bw b LEFT JOIN m ON m.img_id = b.img_id AND m.y = b.y AND m.x = b.x")
add("upscale3", bw(lambda b: P.upscale(b, 3)), f"{T} SELECT img_id, CAST(y * 3 + dy AS INTEGER) AS y, CAST(x * 3 + dx AS INTEGER) AS x, bw FROM bw, range(3) a(dy), range(3) b(dx)")
add("crop", gray(lambda t: t.where("x between 2 and 5 and y between 1 and 6").select("img_id", (F.col("y") - 1).alias("y"), (F.col("x") - 2).alias("x"), "g")), f"{T} SELECT img_id, y - 1 AS y, x - 2 AS x, g FROM tile WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6")
for name, inside in (("fill_rect", True), ("fill_except", False)):
    add(name, bw(lambda b, inside=inside: P.fill(b, 1, (2, 4), (1, 5), inside)), f"{T} SELECT img_id, y, x, CASE WHEN {'' if inside else 'NOT '}(x BETWEEN 2 AND 4 AND y BETWEEN 1 AND 5) THEN 1 ELSE bw END AS bw FROM bw")
# runs
SPANS = """, p AS (SELECT img_id, x AS pos, CAST(sum(bw) AS BIGINT) AS n FROM bw GROUP BY ALL), o AS (SELECT img_id, pos, coalesce(CAST(pos - lag(pos) OVER (PARTITION BY img_id ORDER BY pos) > 2 AS INTEGER), 0) AS nw FROM p WHERE n > 2),
r AS (SELECT img_id, pos, sum(nw) OVER (PARTITION BY img_id ORDER BY pos) AS run FROM o) SELECT img_id, min(pos) AS first, max(pos) AS last FROM r GROUP BY img_id, run HAVING max(pos) - min(pos) + 1 >= 2"""
add("content_spans", bw(lambda b: P.content_spans(P.profile(b, "x").select("img_id", "pos", (F.col("n") - 2).alias("n")), 2, 2)), f"{T}{SPANS}")


def text_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a text page that hold ink, with their extent, taken whole."""
    lines = R.text_lines(spark, sf_dir).withColumn("ink", F.length(F.regexp_replace("line", " ", "")))
    return lines.where("ink > 0").select("img_id", "y", F.length("line").cast("long").alias("width"), F.col("ink").cast("long").alias("ink"))


add("text_line_rows", text_line_rows, "SELECT img_id, CAST(y AS INTEGER) AS y, CAST(length(line) AS BIGINT) AS width, CAST(length(replace(line, ' ', '')) AS BIGINT) AS ink FROM (SELECT doc_id AS img_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS y FROM documents) WHERE length(replace(line, ' ', '')) > 0")


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of inked rows of each text page."""
    rows = text_line_rows(spark, sf_dir).select("img_id", F.col("y").alias("pos"), F.col("ink").alias("n"))
    return P.content_spans(rows, 1, 1)


add("text_blocks", text_blocks, """WITH l AS (SELECT img_id, CAST(y AS INTEGER) AS y FROM (SELECT doc_id AS img_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS y FROM documents) WHERE length(replace(line, ' ', '')) > 0),
o AS (SELECT *, y - row_number() OVER (PARTITION BY img_id ORDER BY y) AS k FROM l) SELECT img_id, min(y) AS first, max(y) AS last FROM o GROUP BY img_id, k""")
add("packed_round_trip", gray(lambda t: R.to_long(R.to_packed(t))), f"{T} SELECT * FROM tile")
