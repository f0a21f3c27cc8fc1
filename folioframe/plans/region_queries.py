"""Queries on regions, shapes, colours and polarity, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.operators import pixels as P
from folioframe.operators import regions as G
from folioframe.plans.raster_queries import T, bw, gray
from folioframe.sources import rasters as R

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _labels(diagonal: bool) -> str:
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if diagonal else "abs(a.y - b.y) + abs(a.x - b.x) = 1"
    return f"""{T.replace("WITH", "WITH RECURSIVE", 1)}, k AS (SELECT img_id, y, x, y * 100 + x AS p FROM bw WHERE bw = 1), e AS (SELECT a.img_id, a.p AS p, b.p AS q FROM k a JOIN k b ON a.img_id = b.img_id AND {near}),
c AS (SELECT img_id, p, p AS q FROM k UNION SELECT c.img_id, c.p, e.q FROM c JOIN e ON e.img_id = c.img_id AND e.p = c.q),
l AS (SELECT img_id, p, min(q) AS root FROM c GROUP BY ALL), n AS (SELECT img_id, p, dense_rank() OVER (PARTITION BY img_id ORDER BY root) AS label FROM l),
lab AS (SELECT b.img_id, b.y, b.x, b.bw, CAST(coalesce(n.label, 0) AS INTEGER) AS label FROM bw b LEFT JOIN n ON n.img_id = b.img_id AND n.p = b.y * 100 + b.x)"""


STAT = "st AS (SELECT img_id, label, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM lab WHERE label > 0 GROUP BY ALL)"
for diagonal, k in ((False, 4), (True, 8)):
    add(f"components{k}", bw(lambda b, d=diagonal: G.components(b, d)), f"{_labels(diagonal)} SELECT img_id, y, x, label FROM lab")
    add(f"component_stats{k}", bw(lambda b, d=diagonal: G.component_stats(G.components(b, d))), f"{_labels(diagonal)}, {STAT} SELECT * FROM st")
    add(f"seed_fill{k}", bw(lambda b, d=diagonal: G.seed_fill(G.components(b, d), b.where("y = 0"))), f"{_labels(diagonal)} SELECT img_id, y, x, CAST(label > 0 AND EXISTS (SELECT 1 FROM lab s WHERE s.img_id = lab.img_id AND s.label = lab.label AND s.y = 0) AS INTEGER) AS bw FROM lab")
add("big_components", bw(lambda b: G.big_components(b, 3)), f"{_labels(True)}, {STAT} SELECT lab.img_id, y, x, CAST(coalesce(greatest(x1 - x0, y1 - y0) + 1 >= 3, FALSE) AS INTEGER) AS bw FROM lab LEFT JOIN st ON st.img_id = lab.img_id AND st.label = lab.label")
add("despeckle", bw(lambda b: G.despeckle(b, 75)), None)
add("distance_map", bw(G.distance_map), f"{T} SELECT a.img_id, a.y, a.x, CAST(coalesce(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)), -1) AS BIGINT) AS d2 FROM bw a LEFT JOIN bw b ON b.img_id = a.img_id AND b.bw = 0 GROUP BY ALL")
add("influence_zones", bw(lambda b: G.influence(G.components(b))), f"""{_labels(False)} SELECT a.img_id, a.y, a.x, CAST(coalesce(arg_min(b.label, ((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x), b.x, b.y)), 0) AS INTEGER) AS zone
FROM lab a LEFT JOIN lab b ON b.img_id = a.img_id AND b.label > 0 GROUP BY a.img_id, a.y, a.x""")
for diagonal, k in ((False, 4), (True, 8)):
    add(f"gray_reconstruction{k}", gray(lambda t, d=diagonal: G.reconstruct(t, np_erode, d)), None)
SLOPES = [-0.5, -0.25, 0.0, 0.25, 0.5]
SCORE = f"""{T}, r AS (SELECT img_id, CAST(s.slope AS DOUBLE) AS slope, y + CAST(floor(x * s.slope + 0.5) AS INTEGER) AS r, sum(bw) AS n FROM bw, (SELECT unnest([-0.5::DOUBLE, -0.25, 0.0, 0.25, 0.5]) AS slope) s GROUP BY ALL),
d AS (SELECT img_id, slope, n - lag(n) OVER (PARTITION BY img_id, slope ORDER BY r) AS d FROM r), sc AS (SELECT img_id, slope, CAST(coalesce(sum(d * d), 0) AS BIGINT) AS score FROM d GROUP BY ALL)"""
add("skew_score_by_angle", bw(lambda b: G.skew_scores(b, SLOPES)), f"{SCORE} SELECT * FROM sc")
add("find_skew", bw(lambda b: G.skew_scores(b, SLOPES).groupBy("img_id").agg(F.max(F.struct("score", (-F.abs("slope")).alias("near"), "slope")).alias("m"), F.avg("score").alias("mean")).select("img_id", F.col("m.slope").alias("slope"), F.round(F.when(F.col("mean") > 0, F.col("m.score") / F.when(F.col("mean") > 0, F.col("mean")) - 1).otherwise(0.0), 6).alias("confidence"))), f"{SCORE} SELECT img_id, arg_max(slope, (score, -abs(slope), slope)) AS slope, round(CASE WHEN avg(score) > 0 THEN max(score) / avg(score) - 1 ELSE 0.0 END, 6) AS confidence FROM sc GROUP BY img_id")
DEG = [0, 30, 45, 60, 90, 135]
add("hough_votes", gray(lambda t: G.hough(t, DEG)), f"{T} SELECT img_id, CAST(a.d AS INTEGER) AS degree, CAST(floor(round(x * cos(radians(a.d::DOUBLE)) + y * sin(radians(a.d::DOUBLE)), 6) + 0.5) AS INTEGER) AS bin, CAST(sum(128 - g) AS BIGINT) AS weight FROM tile, (SELECT unnest({DEG}) AS d) a WHERE g < 128 GROUP BY ALL")


def np_erode(a):
    """The lighter spreads one pixel: the marker of a reconstruction."""
    import numpy as np

    p = np.pad(a, 1, mode="edge")
    return np.maximum.reduce([p[dy : dy + a.shape[0], dx : dx + a.shape[1]] for dy in range(3) for dx in range(3)])


def polarity(t: DataFrame) -> DataFrame:
    """Whether an image is dark on light, from its border mean and its share of dark pixels, with a confidence (kernels.polarity has the whole ladder)."""
    s = t.withColumn("edge", P.near_border(t, F.lit(1))).groupBy("img_id").agg(F.avg(F.when(F.col("edge"), F.col("g"))).alias("border"), F.avg((F.col("g") < 128).cast("double")).alias("dark"))
    conf = (F.abs(F.col("border") - 128) / 128 + F.abs(2 * F.col("dark") - 1)) / 2
    return s.select("img_id", F.when((F.col("border") < 128) & (F.col("dark") > 0.5), "white_on_black").otherwise("black_on_white").alias("polarity"), F.round(conf, 6).alias("confidence"))


EDGE = "x < {0} OR y < {0} OR x > max(x) OVER (PARTITION BY img_id) - {0} OR y > max(y) OVER (PARTITION BY img_id) - {0}"
add("border_tone", gray(polarity), f"""{T}, e AS (SELECT *, {EDGE.format(1)} AS edge FROM tile), s AS (SELECT img_id, avg(CASE WHEN edge THEN g END) AS border, avg(CASE WHEN g < 128 THEN 1.0::DOUBLE ELSE 0.0 END) AS dark FROM e GROUP BY img_id)
SELECT img_id, CASE WHEN border < 128 AND dark > 0.5 THEN 'white_on_black' ELSE 'black_on_white' END AS polarity, round((abs(border - 128) / 128 + abs(2 * dark - 1)) / 2, 6) AS confidence FROM s""")


def polarity_bw(b: DataFrame) -> DataFrame:
    """Polarity of binary images: the border's share of black below 0.3 or above 0.7 decides, else a share above 0.6 of either colour."""
    s = b.withColumn("edge", P.near_border(b)).groupBy("img_id").agg(F.round(F.avg("bw"), 6).alias("black"), F.round(F.coalesce(F.avg(F.when(F.col("edge"), F.col("bw"))), F.lit(0.5)), 6).alias("border"))
    kind = F.when(F.col("border") < 0.3, "black_on_white").when(F.col("border") > 0.7, "white_on_black").when(1 - F.col("black") > 0.6, "black_on_white").when(F.col("black") > 0.6, "white_on_black").otherwise("mixed")
    sure = F.greatest(F.abs(F.col("border") - 0.5), F.abs(F.col("black") - 0.5)) * 2
    return s.select("img_id", kind.alias("polarity"), F.round(F.when(kind == "mixed", sure / 2).otherwise(sure), 6).alias("confidence"))


add("polarity_bw", bw(polarity_bw), f"""{T}, e AS (SELECT *, {EDGE.format("greatest(5, (least(max(y) OVER (PARTITION BY img_id), max(x) OVER (PARTITION BY img_id)) + 1) // 50)")} AS edge FROM bw),
s AS (SELECT img_id, round(avg(bw), 6) AS black, round(coalesce(avg(CASE WHEN edge THEN bw END), 0.5), 6) AS border FROM e GROUP BY img_id),
k AS (SELECT *, CASE WHEN border < 0.3 THEN 'black_on_white' WHEN border > 0.7 THEN 'white_on_black' WHEN 1 - black > 0.6 THEN 'black_on_white' WHEN black > 0.6 THEN 'white_on_black' ELSE 'mixed' END AS polarity, greatest(abs(border - 0.5), abs(black - 0.5)) * 2 AS sure FROM s)
SELECT img_id, polarity, round(CASE WHEN polarity = 'mixed' THEN sure / 2 ELSE sure END, 6) AS confidence FROM k""")
PALETTE = [0, 85, 128, 170, 255]


def nearest(t: DataFrame) -> DataFrame:
    """Each pixel's nearest palette level, ties to the darker."""
    best = F.array_min(F.array(*(F.struct(F.abs(F.col("g") - p).alias("d"), F.lit(p).alias("p")) for p in PALETTE)))
    return t.select(*P.KEY, best["p"].alias("g"))


NEAR = f"SELECT img_id, y, x, (SELECT arg_min(p, (abs(g - p), p)) FROM (SELECT unnest({PALETTE}) AS p)) AS g FROM tile"
add("posterize", gray(nearest), f"{T} {NEAR}")
add("colour_segments", gray(lambda t: nearest(t).groupBy("img_id", "g").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))), f"{T}, n AS ({NEAR}) SELECT img_id, g, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM n GROUP BY ALL")
add("palette", gray(lambda t: t.select("g").distinct()), f"{T} SELECT DISTINCT g FROM tile")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of four vertices from the first eight numbers of each embedding, in integers."""
    v = lambda k: F.floor(F.get("embedding", F.lit(k)).cast("double") * 1024).cast("long")
    points = F.array(*(F.struct(F.lit(k).alias("ord"), v(2 * k).alias("px"), v(2 * k + 1).alias("py")) for k in range(4)))
    return R.table(spark, sf_dir, "embeddings").select("vec_id", F.explode(points).alias("p")).select("vec_id", "p.*")


def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shoelace area, box area and their ratio."""
    w = Window.partitionBy("vec_id").orderBy("ord")
    p = polygons(spark, sf_dir).select("*", F.lead("px").over(w).alias("qx"), F.lead("py").over(w).alias("qy"), F.first("px").over(w).alias("fx"), F.first("py").over(w).alias("fy"))
    cross = F.col("px") * F.coalesce("qy", "fy") - F.coalesce("qx", "fx") * F.col("py")
    a = p.groupBy("vec_id").agg(F.abs(F.sum(cross)).alias("twice"), ((F.max("px") - F.min("px")) * (F.max("py") - F.min("py"))).alias("box"))
    return a.select("vec_id", "twice", "box", F.round(F.when(F.col("box") > 0, F.col("twice") / 2 / F.when(F.col("box") > 0, F.col("box"))).otherwise(0.0), 6).alias("rectangularity"))


add("polygon_area", polygon_area, """WITH p AS (SELECT vec_id, k AS ord, CAST(floor(embedding[2 * k + 1]::DOUBLE * 1024) AS BIGINT) AS px, CAST(floor(embedding[2 * k + 2]::DOUBLE * 1024) AS BIGINT) AS py FROM embeddings, range(4) r(k)),
q AS (SELECT a.vec_id, a.px, a.py, b.px AS qx, b.py AS qy FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.ord = (a.ord + 1) % 4),
s AS (SELECT vec_id, CAST(abs(sum(px * qy - qx * py)) AS BIGINT) AS twice, CAST((max(px) - min(px)) * (max(py) - min(py)) AS BIGINT) AS box FROM q GROUP BY vec_id)
SELECT vec_id, twice, box, round(CASE WHEN box > 0 THEN twice / 2.0::DOUBLE / box ELSE 0.0 END, 6) AS rectangularity FROM s""")
