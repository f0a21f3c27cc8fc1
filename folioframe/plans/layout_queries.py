"""Queries on page geometry, split positions, project edits and the remaining orders, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import layout as L
from folioframe.operators import pages as A
from folioframe.operators import pixels as P
from folioframe.plans.page_queries import KEY, PAGE, pages
from folioframe.plans.raster_queries import T8 as T
from folioframe.sources import rasters as R
from folioframe.sources.rasters import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda spark, d: f(pages(spark, d))
    ORACLE[name] = f"{PAGE} {sql}"


def raw(name: str, f, sql: str) -> None:
    QUERIES[name], ORACLE[name] = f, sql


def margins(p: DataFrame) -> DataFrame:
    """Left and right of a page whose content starts margin pixels in and ends half as far from the other edge."""
    left, right = L.hard_margins(F.col("margin").cast("double"), F.expr("margin div 2").cast("double"), F.col("width") / 10)
    return p.select(*KEY, F.round(left, 6).alias("left"), F.round(right, 6).alias("right"))


SHARE = "round(CASE WHEN margin + margin // 2 >= 1 THEN {0} * (width / 10.0::DOUBLE) / (margin + margin // 2) ELSE 0.0 END, 6)"
add("hard_margins", margins, f'SELECT img, page, {SHARE.format("margin")} AS "left", {SHARE.format("(margin // 2)")} AS "right" FROM page')
add("output_rect", lambda p: A.soft_margins(p).select(*KEY, (-(F.col("margin") + F.col("left"))).alias("x0"), (-(F.col("margin") + F.col("top"))).alias("y0"), (F.col("width") + F.col("margin") + F.col("right")).alias("x1"), (F.col("height") + F.col("margin") + F.col("bottom")).alias("y1")), """, m AS (SELECT *, CASE WHEN aligned THEN max(CASE WHEN aligned THEN width END) OVER w - width ELSE 0 END AS dw, CASE WHEN aligned THEN max(CASE WHEN aligned THEN height END) OVER w - height ELSE 0 END AS dh FROM page WINDOW w AS (PARTITION BY project)),
s AS (SELECT *, CAST(dw * halign / 2.0 AS DOUBLE) AS l, CAST(dh * valign / 2.0 AS DOUBLE) AS t FROM m) SELECT img, page, -(margin + l) AS x0, -(margin + t) AS y0, CAST(width + margin + dw - l AS DOUBLE) AS x1, CAST(height + margin + dh - t AS DOUBLE) AS y1 FROM s""")
add("content_size_mm", lambda p: p.select(*KEY, F.round(L.millimetres(F.col("width") * 10, F.lit(300)), 6).alias("w"), F.round(L.millimetres(F.col("height") * 10, F.lit(150)), 6).alias("h")), "SELECT img, page, round(width * 10 * 25.4::DOUBLE / 300, 6) AS w, round(height * 10 * 25.4::DOUBLE / 150, 6) AS h FROM page")
add("rescale_dpi", lambda p: p.select(*KEY, L.at_dpi(F.col("width"), F.col("height")).alias("w")), "SELECT img, page, CAST(greatest(1, floor(width * 300 / CAST(height AS DOUBLE) + 0.5)) AS BIGINT) AS w FROM page")
add("transform_chain", lambda p: L.transformed_size(p, 1.5, F.col("halign") * 90).select(*KEY, "out_w", "out_h"), """, q AS (SELECT *, floor(width * 1.5 + 0.5)::DOUBLE AS w, floor(height * 1.5 + 0.5)::DOUBLE AS h, abs(cos(radians(angle::DOUBLE))) AS c, abs(sin(radians(angle::DOUBLE))) AS s FROM page)
SELECT img, page, round(CASE WHEN halign = 1 THEN h * c + w * s ELSE w * c + h * s END, 6) AS out_w, round(CASE WHEN halign = 1 THEN h * s + w * c ELSE w * s + h * c END, 6) AS out_h FROM q""")
add("page_outlines", lambda p: p.select(*KEY, F.explode(F.when(F.col("width") > F.col("height"), F.array(F.struct(F.lit("left").alias("part"), F.lit(0).cast("long").alias("x0"), F.expr("width div 2").alias("x1")), F.struct(F.lit("right").alias("part"), F.expr("width div 2").alias("x0"), F.col("width").alias("x1")))).otherwise(F.array(F.struct(F.lit("single").alias("part"), F.lit(0).cast("long").alias("x0"), F.col("width").alias("x1"))))).alias("o")).select(*KEY, "o.*"), "SELECT img, page, 'single' AS part, 0 AS x0, width AS x1 FROM page WHERE width <= height UNION ALL SELECT img, page, 'left', 0, width // 2 FROM page WHERE width > height UNION ALL SELECT img, page, 'right', width // 2, width FROM page WHERE width > height")
add("page_number_lookup", lambda p: (lambda d: d.select(*KEY).distinct().join(A.numbered(d.where("aligned").select(*KEY).distinct(), [F.col("page")], "img", KEY), KEY, "left").select(*KEY, F.coalesce("rank", F.lit(-1).cast("long")).alias("number")))(p), ", r AS (SELECT img, page, row_number() OVER (PARTITION BY img ORDER BY page) - 1 AS rank FROM (SELECT DISTINCT img, page FROM page WHERE aligned)) SELECT page.img, page.page, coalesce(rank, -1) AS number FROM (SELECT DISTINCT img, page FROM page) page LEFT JOIN r ON r.img = page.img AND r.page = page.page")
add("insert_before", lambda p: L.inserted(p.select("img", "page", (F.col("page") * 10).cast("long").alias("id")), p.where("aligned").select("img", "page", (F.col("page") * 10 + 5).cast("long").alias("id")), "img", "page"), ", b AS (SELECT img, page, page * 10 AS id, 1 AS k FROM page UNION ALL SELECT img, page, page * 10 + 5, 0 FROM page WHERE aligned) SELECT img, id, row_number() OVER (PARTITION BY img ORDER BY page, k, id) AS number FROM b")
add("metadata_refresh", lambda p: L.updated(p.select(*KEY, F.concat_ws("-", "img", "page").alias("id"), "width", "height"), p.where("aligned").groupBy(F.concat_ws("-", "img", "page").alias("id")).agg((F.max("width") + 1).alias("width")), "id", ["width"]).select(*KEY, "width", "height"), "SELECT img, page, coalesce(max(CASE WHEN aligned THEN width + 1 END) OVER (PARTITION BY img, page), width) AS width, height FROM page")
add("zones_equal", lambda p: (lambda z: z.alias("a").join(z.select((F.col("img") + 1).alias("img"), F.col("zones").alias("before")), "img").select("img", (F.col("zones") == F.col("before")).alias("equal")))(p.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("page", F.col("halign").alias("kind")))).alias("zones"))), ", z AS (SELECT img, list({'p': page, 'k': halign} ORDER BY page, halign) AS z FROM page GROUP BY img) SELECT a.img, a.z = b.z AS equal FROM z a JOIN z b ON b.img + 1 = a.img")
add("images_for_pages", lambda p: p.groupBy("project").agg(F.sum(F.when(F.col("width") > F.col("height"), 2).otherwise(1)).cast("long").alias("pages"), F.count_distinct("img").alias("images")), "SELECT project, CAST(sum(CASE WHEN width > height THEN 2 ELSE 1 END) AS BIGINT) AS pages, count(DISTINCT img) AS images FROM page GROUP BY project")
ORDERS = {
    "rotation": (lambda: [F.col("halign") * 90], "halign * 90"),
    "split_type": (lambda: [F.when(F.col("side") == 1, 100).otherwise(F.col("valign"))], "CASE WHEN side = 1 THEN 100 ELSE valign END"),
    "page_size": (lambda: [F.greatest("width", "height")], "greatest(width, height)"),
    "mode": (lambda: [F.col("valign"), F.col("aligned"), F.col("angle")], "valign, aligned, angle"),
    "dewarping_mode": (lambda: [F.col("halign")], "halign"),
    "source_colour": (lambda: [(F.col("side") == 2)], "side = 2"),
    "processed_first": (lambda: [~F.col("aligned"), F.col("width")], "NOT aligned, width"),
    "reverse_width": (lambda: [F.desc("width")], "width DESC"),
}
for name, (order, sql) in ORDERS.items():
    add(f"order_by_{name}", lambda p, o=order: A.numbered(p, [*o(), F.col("img"), F.col("page")], "project", KEY), f"SELECT img, page, row_number() OVER (PARTITION BY project ORDER BY {sql}, img, page) - 1 AS rank FROM page")


def relinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers' folders after some nations' folders moved."""
    files = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/in/"), "c_nationkey").alias("dir"))
    moves = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("/in/"), "n_nationkey").alias("old"), F.concat(F.lit("/moved/"), "n_nationkey").alias("new"))
    return L.relinked(files, moves, "dir")


raw("relink_paths", relinked, "SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN '/moved/' ELSE '/in/' END || c_nationkey AS dir FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")


def split_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tiles' columns part: columns of more than four black pixels are content."""
    b = R.bitmaps(R.tiles(spark, sf_dir))
    spans = P.content_spans(P.profile(b, "x").select("img_id", "pos", (F.col("n") - 4).alias("n")))
    return L.split_position(spans, b.groupBy("img_id").agg((F.max("x") + 1).alias("width")), clear=1)


raw("split_position", split_positions, f"""{T}, p AS (SELECT img_id, x FROM bw GROUP BY ALL HAVING sum(bw) > 4), r AS (SELECT img_id, x, x - row_number() OVER (PARTITION BY img_id ORDER BY x) AS k FROM p), s AS (SELECT img_id, min(x) AS f, max(x) + 1 AS e FROM r GROUP BY img_id, k),
g AS (SELECT l.img_id, l.e AS g0, min(n.f) AS g1, (SELECT min(f) FROM s z WHERE z.img_id = l.img_id) AS a, (SELECT max(e) FROM s z WHERE z.img_id = l.img_id) AS b FROM s l JOIN s n ON n.img_id = l.img_id AND n.f > l.f GROUP BY l.img_id, l.f, l.e),
q AS (SELECT *, round(least(g0 - a, b - g1) / CAST(greatest(g0 - a, b - g1) AS DOUBLE), 9) AS bal FROM g), t AS (SELECT img_id, arg_min(g0, (-bal, g0)) AS top, max(bal) AS best FROM q GROUP BY img_id),
c AS (SELECT q.* FROM q JOIN t ON t.img_id = q.img_id WHERE best >= 0.25 AND NOT EXISTS (SELECT 1 FROM q w WHERE w.img_id = q.img_id AND w.bal < 0.9::DOUBLE * t.best AND w.g0 BETWEEN least(q.g0, t.top) AND greatest(q.g0, t.top))),
m AS (SELECT img_id, arg_min((g0 + g1) / 2.0::DOUBLE, (g0 - g1, g0)) AS mid FROM c GROUP BY img_id), o AS (SELECT img_id, min(f) AS a, max(e) AS b FROM s GROUP BY img_id)
SELECT i.img_id, CAST(CASE WHEN mid IS NOT NULL THEN mid WHEN a IS NULL OR abs(8 - a - b) / 2.0 - (b - a) / 2.0 > 1 THEN 4.0 WHEN a > 8 - b THEN greatest(0, a - 1) ELSE least(8, b + 1) END AS DOUBLE) AS at FROM (SELECT DISTINCT img_id FROM tile) i LEFT JOIN o ON o.img_id = i.img_id LEFT JOIN m ON m.img_id = i.img_id""")
