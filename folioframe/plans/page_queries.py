"""Queries on page tables: orders stand for images, order lines for pages, suppliers for projects; with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import pages as A
from folioframe.sources.rasters import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KEY = ["img", "page"]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, img, page, width, height (mm), angle (hundredths), margin, aligned, side, halign, valign; all integers."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("project"),
        c("l_orderkey").alias("img"),
        c("l_linenumber").alias("page"),
        (F.floor("l_quantity") * 4 + 10).cast("long").alias("width"),
        (F.floor(c("l_extendedprice") / 500) + 10).cast("long").alias("height"),
        (F.round(c("l_discount") * 100) - 5).cast("long").alias("angle"),
        F.round(c("l_tax") * 100).cast("long").alias("margin"),
        (c("l_returnflag") != "N").alias("aligned"),
        F.when(c("l_linestatus") == "O", 1).otherwise(2).alias("side"),
        (c("l_partkey") % 3).cast("int").alias("halign"),
        (c("l_orderkey") % 3).cast("int").alias("valign"),
    )


PAGE = """WITH page AS (SELECT l_suppkey AS project, l_orderkey AS img, l_linenumber AS page, CAST(floor(l_quantity) * 4 + 10 AS BIGINT) AS width, CAST(floor(l_extendedprice / 500) + 10 AS BIGINT) AS height,
  CAST(round(l_discount * 100) - 5 AS BIGINT) AS angle, CAST(round(l_tax * 100) AS BIGINT) AS margin, l_returnflag <> 'N' AS aligned, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS side, CAST(l_partkey % 3 AS INTEGER) AS halign, CAST(l_orderkey % 3 AS INTEGER) AS valign FROM lineitem)"""


def add(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda spark, d: f(pages(spark, d))
    ORACLE[name] = f"{PAGE} {sql}"


def raw(name: str, f, sql: str) -> None:
    QUERIES[name], ORACLE[name] = f, sql


MEAN = "CAST(sum({0}) AS DOUBLE) / count({0})"
SIGMA = "sqrt(greatest(CAST(sum({0} * {0}) AS DOUBLE) / count({0}) - (CAST(sum({0}) AS DOUBLE) / count({0})) * (CAST(sum({0}) AS DOUBLE) / count({0})), 0.0))"
DEV = "SELECT *, round(CAST(sum({0}) OVER w AS DOUBLE) / count({0}) OVER w, 6) AS mean, round(sqrt(greatest(CAST(sum({0} * {0}) OVER w AS DOUBLE) / count({0}) OVER w - (CAST(sum({0}) OVER w AS DOUBLE) / count({0}) OVER w) * (CAST(sum({0}) OVER w AS DOUBLE) / count({0}) OVER w), 0.0)), 6) AS sigma FROM page WINDOW w AS (PARTITION BY project)"
for name, value in (("skew_stats", "angle"), ("content_stats", "width")):
    add(name, lambda p, v=value: A.stats(p, v), f"SELECT project, count({value}) AS n, round({MEAN.format(value)}, 6) AS mean, round({SIGMA.format(value)}, 6) AS sigma FROM page GROUP BY project")
add("skew_outliers", lambda p: A.deviations(p, "angle").where(F.greatest(1.5 * F.col("sigma"), F.lit(4.0)) < F.abs(F.col("mean") - F.col("angle"))).select(*KEY, "angle", "mean"), f", d AS ({DEV.format('angle')}) SELECT img, page, angle, mean FROM d WHERE greatest(1.5 * sigma, 4.0) < abs(mean - angle)")
add("content_outliers", lambda p: A.deviations(p, "width").where(F.col("sigma") * 1.6 < F.abs(F.col("mean") - F.col("width"))).select(*KEY, "width"), f", d AS ({DEV.format('width')}) SELECT img, page, width FROM d WHERE sigma * 1.6 < abs(mean - width)")
add(
    "deviation_flags",
    lambda p: A.deviations(A.deviations(p, "angle").select("*", F.col("mean").alias("am")).drop("mean", "sigma"), "width").select(*KEY, (F.when(F.abs(F.col("angle") - F.col("am")) > 3, 1).otherwise(0) + F.when(F.abs(F.col("width") - F.col("mean")) > 0.2 * F.col("mean"), 2).otherwise(0) + F.when(F.col("margin") > 5, 4).otherwise(0)).cast("int").alias("flags")),
    """, a AS (SELECT *, round(CAST(sum(angle) OVER w AS DOUBLE) / count(*) OVER w, 6) AS am, round(CAST(sum(width) OVER w AS DOUBLE) / count(*) OVER w, 6) AS wm FROM page WINDOW w AS (PARTITION BY project))
SELECT img, page, CAST(CASE WHEN abs(angle - am) > 3 THEN 1 ELSE 0 END + CASE WHEN abs(width - wm) > 0.2 * wm THEN 2 ELSE 0 END + CASE WHEN margin > 5 THEN 4 ELSE 0 END AS INTEGER) AS flags FROM a""",
)
add("aggregate_hard_size", A.aggregate_hard_size, "SELECT project, coalesce(max(CASE WHEN aligned THEN width END), 0) AS width, coalesce(max(CASE WHEN aligned THEN height END), 0) AS height FROM page GROUP BY project")
add("whatif_hard_size", lambda p: A.hard_size_without(p, KEY), "SELECT img, page, coalesce(max(CASE WHEN aligned THEN width END) OVER (PARTITION BY project ORDER BY img, page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0) AS width FROM page")
add("soft_margins", lambda p: A.soft_margins(p).select(*KEY, "left", "right", "top", "bottom"), """, m AS (SELECT *, CASE WHEN aligned THEN max(CASE WHEN aligned THEN width END) OVER w - width ELSE 0 END AS dw, CASE WHEN aligned THEN max(CASE WHEN aligned THEN height END) OVER w - height ELSE 0 END AS dh FROM page WINDOW w AS (PARTITION BY project)),
s AS (SELECT *, CAST(dw * halign / 2.0 AS DOUBLE) AS l, CAST(dh * valign / 2.0 AS DOUBLE) AS t FROM m) SELECT img, page, l AS "left", CAST(dw - l AS DOUBLE) AS "right", t AS top, CAST(dh - t AS DOUBLE) AS bottom FROM s""")
add("dpi_status", lambda p: p.select(*KEY, A.dpi_status(F.col("width") * 20, F.col("height") * 2).alias("status")), "SELECT img, page, CASE WHEN height * 2 <= 1 THEN 'undefined' WHEN height * 2 < 150 THEN 'too_small' WHEN height * 2 > 9999 THEN 'too_large' WHEN 25.4 * (width * 20) / (height * 2) > 500 THEN 'too_small_for_size' ELSE 'ok' END AS status FROM page")
add("logical_pages", lambda p: p.select(*KEY, F.when(F.col("width") > F.col("height"), 2).otherwise(1).alias("n")), "SELECT img, page, CASE WHEN width > height THEN 2 ELSE 1 END AS n FROM page")
add("page_view", lambda p: p.select(*KEY, F.explode(F.when(F.col("width") > F.col("height"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))).alias("sub")), "SELECT img, page, CAST(unnest(CASE WHEN width > height THEN [1, 2] ELSE [0] END) AS INTEGER) AS sub FROM page")
add("max_page_number", lambda p: p.groupBy("img").agg(F.max("page").alias("last")), "SELECT img, max(page) AS last FROM page GROUP BY img")
add("images_by_project", lambda p: p.groupBy("project", "img").agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("page")), lambda x: x.cast("string"))).alias("pages")), "SELECT project, img, count(*) AS n, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM page GROUP BY project, img")
add("everything_defined", lambda p: p.groupBy("project").agg(F.every(F.col("margin") > 0).alias("ok")), "SELECT project, bool_and(margin > 0) AS ok FROM page GROUP BY project")
add("aspect_majority", lambda p: A.alike_share(p, KEY, "width", 40), "SELECT img, page, (SELECT count(*) FROM page b WHERE b.project = a.project AND abs(a.width - b.width) > 40) > (count(*) OVER (PARTITION BY project) - 1) // 2 AS odd FROM page a")
add("every_other_page", lambda p: A.numbered(p, [F.col("img"), F.col("page")], "project", ["project", *KEY]).where("rank % 2 = 0"), ", r AS (SELECT project, img, page, row_number() OVER (PARTITION BY project ORDER BY img, page) - 1 AS rank FROM page) SELECT * FROM r WHERE rank % 2 = 0")
add("page_ranges", lambda p: A.runs(p.where("aligned"), "img", "page"), ", k AS (SELECT img, page, page - row_number() OVER (PARTITION BY img ORDER BY page) AS k FROM page WHERE aligned) SELECT img, min(page) AS first, max(page) AS last, count(*) AS n FROM k GROUP BY img, k")
add("pages_of_removed_images", lambda p: p.join(p.where("page = 1 and not aligned").select("img").distinct(), "img", "left_anti").select(*KEY), "SELECT img, page FROM page WHERE img NOT IN (SELECT img FROM page WHERE page = 1 AND NOT aligned)")
add("pages_of_kept_images", lambda p: p.join(p.where("page = 1 and not aligned").select("img").distinct(), "img", "left_semi").select(*KEY), "SELECT img, page FROM page WHERE img IN (SELECT img FROM page WHERE page = 1 AND NOT aligned)")
add("result_fingerprint", lambda p: p.select(*KEY, A.fingerprint("width", "height", "angle", "margin").alias("print")), "SELECT img, page, sha256(concat_ws('|', width, height, angle, margin)) AS print FROM page")
ORDERS = {
    "angle": (lambda: [F.desc("angle")], "angle DESC"),
    "abs_angle": (lambda: [F.desc(F.abs("angle"))], "abs(angle) DESC"),
    "width": (lambda: [F.col("width")], "width"),
    "height": (lambda: [F.col("height")], "height"),
    "alignment": (lambda: [F.col("aligned"), F.desc("valign"), F.desc("halign")], "aligned, valign DESC, halign DESC"),
    "hard_width": (lambda: [F.col("width") + 2 * F.col("margin")], "width + 2 * margin"),
    "hard_height": (lambda: [F.col("height") + 2 * F.col("margin")], "height + 2 * margin"),
    "readiness": (lambda: [F.col("margin") == 0], "margin = 0"),
    "side": (lambda: [F.col("side")], "side"),
}
for name, (order, sql) in ORDERS.items():
    add(f"order_by_{name}", lambda p, o=order: A.numbered(p, [*o(), F.col("img"), F.col("page")], "project", KEY), f"SELECT img, page, row_number() OVER (PARTITION BY project ORDER BY {sql}, img, page) - 1 AS rank FROM page")


def default_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of each image, or the default where none are stored: a left join."""
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("img"))
    stored = pages(spark, sf_dir).where("page = 1 and aligned").select("img", F.col("halign").alias("layout"))
    return images.join(stored, "img", "left").select("img", F.coalesce("layout", F.lit(-1)).alias("layout"))


raw("default_layout", default_layout, f"{PAGE} SELECT o_orderkey AS img, coalesce(p.halign, -1) AS layout FROM orders LEFT JOIN page p ON p.img = o_orderkey AND p.page = 1 AND p.aligned")


def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in natural order of their names; the rank counts from the name's first letter, so that no task sees all files."""
    files = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("scan"), F.col("c_custkey") % 97, F.lit("_"), F.col("c_custkey")).alias("name"), F.col("c_nationkey").alias("dir"))
    return A.numbered(files, [A.natural_key(F.col("name")), F.col("c_custkey")], "dir", ["c_custkey", "name"])


raw("order_by_file_name", file_order, "SELECT c_custkey, name, row_number() OVER (PARTITION BY dir ORDER BY c_custkey % 97, c_custkey) - 1 AS rank FROM (SELECT c_custkey, 'scan' || (c_custkey % 97) || '_' || c_custkey AS name, c_nationkey AS dir FROM customer)")


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of output files, disambiguated where several images share a base name."""
    files = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.regexp_replace("p_name", " ", "_")).alias("base"), (F.col("p_size") % 4).alias("page"), (F.col("p_partkey") % 3).alias("sub"))
    files = A.disambiguated(files, "base", [F.col("p_partkey")])
    return files.select("p_partkey", A.output_name(F.col("base"), F.col("label"), F.col("page"), F.col("sub")).alias("name"))


raw("output_file_name", output_names, """WITH f AS (SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS base, p_size % 4 AS page, p_partkey % 3 AS sub FROM part), d AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) - 1 AS label FROM f)
SELECT p_partkey, base || CASE WHEN label > 0 THEN '(' || label || ')' ELSE '' END || CASE WHEN page > 0 THEN '_page' || lpad(CAST(page AS VARCHAR), 4, '0') ELSE '' END || CASE sub WHEN 1 THEN '_1L' WHEN 2 THEN '_2R' ELSE '' END || '.tif' AS name FROM d""")


def normalized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with dots, doubled slashes and backslashes brought to one form."""
    urls = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/a/./b//"), F.col("page_id"), F.lit("\\..\\c/")).alias("p"))
    return urls.select("page_id", A.normalize_path(F.col("p")).alias("path"))


raw("normalize_path", normalized_urls, "SELECT page_id, '/a/b/c' AS path FROM pages")


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, total, least, greatest and mean time of each operation."""
    from folioframe.streaming.stats import running

    return running(table(spark, sf_dir, "events"))


raw("perf_stats", performance, "SELECT event_type, count(*) AS n, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS total, CAST(min(floor(value * 1000)) AS BIGINT) AS least, CAST(max(floor(value * 1000)) AS BIGINT) AS most FROM events WHERE value IS NOT NULL GROUP BY event_type")
